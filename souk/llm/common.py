"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir

# Largest table (rows) the operators broadcast; larger ones are shuffle-joined.
BROADCAST_ROWS = 200_000


_SCRATCH: list[list[str]] = []      # paths made inside each open ``scratch``


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share.  What is written
    there stays until ``remove`` is called, or ``scratch`` ends if the path was made inside."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder made at a ``shared_path``; no DataFrame over it can be read any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end: for jobs whose result has
    been written by then, to a path made outside."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            remove(spark, path)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, and a lost executor costs only the tasks that were running."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250",
            "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Python workers get texts in batches of bounded size; by default a batch is
    10,000 rows, however long they are.  Holds for the session: for results that
    run only after the operator has returned."""
    for name, value in _BATCHES.items():
        spark.conf.set(name, value)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for the jobs that run inside; the session's own settings come back."""
    own = {name: spark.conf.get(name) for name in _BATCHES}
    small_batches(spark)
    try:
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: idle Python workers
    live on for a while beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count was measured; none above the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

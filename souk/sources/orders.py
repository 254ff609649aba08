"""Order-file readers (CSV, TSV, JSON, Parquet) with dispatch by file suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.schema import RAW_ORDER_SCHEMA

SUPPORTED = ("csv", "tsv", "json", "parquet")


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema=RAW_ORDER_SCHEMA) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("mode", "PERMISSIVE").csv(path))


def read_json(spark: SparkSession, path: str, schema=RAW_ORDER_SCHEMA) -> DataFrame:
    """JSON lines or one JSON array, decided for each file by its first
    character that isn't white space."""
    arrays, lines = _json_files(spark, path)
    reader = lambda multi: spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi)
    if not arrays:
        return reader(False).json(path)
    whole = reader(True).json(arrays)
    return whole.unionByName(reader(False).json(lines)) if lines else whole


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_orders(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read an order table choosing the reader from the suffix (or ``fmt``).

    Unknown suffixes raise ``ValueError`` naming the supported formats.
    The result is the raw table; pass it to ``souk.operators.features.prepare``
    for cleaning and derived columns.
    """
    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ext == "csv":
        return read_csv(spark, path)
    if ext == "tsv":
        return read_csv(spark, path, sep="\t")
    if ext == "json":
        return read_json(spark, path)
    if ext == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"Unsupported format: .{ext}. Supported: {', '.join(SUPPORTED)}")


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Data files below ``path``: those that hold an array, and the others.

    A Spark job over the lines of the files: each file's first line that isn't blank
    tells.  A line's place in its split and whether it opens an array are one whole
    number, so that the smallest of each split is told by a hash aggregate, without
    sorting lines.  The driver gets one row per file, no content."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    first = F.substring(F.regexp_replace("value", "^[\\s\ufeff]+", ""), 1, 1)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("line"), first.alias("first"))
    at = F.col("line").bitwiseAND(F.lit((1 << 33) - 1)) * 2 + (F.col("first") == "[").cast("long")
    splits = lines.groupBy("file", "block").agg(F.min(F.when(F.col("first") != "", at)).alias("at"))
    told = splits.groupBy("file").agg(F.min_by(F.col("at") % 2, F.when(F.col("at").isNotNull(), F.col("block"))).alias("array")).collect()
    return [r["file"] for r in told if r["array"] == 1], [r["file"] for r in told if r["array"] != 1]


def row_count(df: DataFrame) -> DataFrame:
    """Health probe as a one-row aggregate query (not an action)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))

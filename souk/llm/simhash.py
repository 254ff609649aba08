"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 (seed 42) of each word shingle; a bit is 1 if set in over
half of the hashes.  Distinct fingerprints are dealt into tiles by the population
counts of four 16-bit segments.  Flipping a bit changes one segment's count by
one, so fingerprints within ``radius`` bits lie in tiles whose counts differ by
``radius`` at most in sum; all other tile pairs are skipped.  The rest are
compared in full with exclusive-or and bit counts in numpy.  Large tiles are
split into blocks, so no task holds more than ``TILE`` + ``NEIGHBOURS``
fingerprints; equal fingerprints count once, however many documents share them.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; repeated rows share a
component, rows that only share an id do not; a null id has a row and takes no
part in the smallest id of its component (null if all are); empty tables give an
empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import give_back, materialize, small_batches

TILE = 8_192
NEIGHBOURS = 65_536
_SEGMENTS = 4
_BITS = 16


def fingerprint(text: str | None, shingle: int = 3, block: int = 1 << 16) -> int:
    words = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    words = words.split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones, n, seed42 = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    grams = iter(grams)
    while True:
        h = np.array([seed42(g, 42) for g in itertools.islice(grams, block)], dtype=np.uint64)
        if not len(h):
            break
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def row_key(doc_id, text) -> F.Column:
    """Names a row by its id and text."""
    return F.xxhash64(doc_id.cast("long"), text)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "key": b["key"], "fp": fp})
        give_back()
    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text")).mapInPandas(run, "id long, key long, fp long")


def _near_offsets(radius: int) -> list[tuple[int, ...]]:
    steps = range(-radius, radius + 1)
    return [d for d in itertools.product(steps, repeat=_SEGMENTS) if sum(map(abs, d)) <= radius]


def _tile_key(counts: list[F.Column]) -> F.Column:
    out = F.lit(0)
    for c in counts:
        out = out * (_BITS + 1) + c
    return out.cast("int")


def links(fps: DataFrame, radius: int = 2, tile: int = TILE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(a, b), a < b: distinct fingerprints at most ``radius`` bits apart.  ``fps``: distinct fp."""
    spark = fps.sparkSession
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {_BITS * i}) & {(1 << _BITS) - 1}")).cast("int")
              for i in range(_SEGMENTS)]
    dealt = fps.select("fp", F.array(*counts).alias("c"))
    ok = lambda t: F.forall(t, lambda x: (x >= 0) & (x <= _BITS))
    around = F.array(*[F.array(*[F.col("c")[i] + d for i, d in enumerate(o)]) for o in _near_offsets(radius)])
    key = lambda t: _tile_key([t[i] for i in range(_SEGMENTS)])
    # at most 17 ** 4 tiles: their sizes fit a broadcast for any input
    sizes = materialize(spark, dealt.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "simhash-tiles")
    near = sizes.select(F.explode(F.filter(around, ok)).alias("t"), "n").select(key(F.col("t")).alias("tile"), "n") \
        .groupBy("tile").agg(F.sum("n").alias("n_near"))
    plan = sizes.select(key(F.col("c")).alias("tile"), "n").join(F.broadcast(near), "tile").select(
        "tile", F.ceil(F.col("n") / tile).cast("int").alias("own_blocks"),
        F.ceil(F.col("n_near") / neighbours).cast("int").alias("near_blocks"))
    plan = F.broadcast(materialize(spark, plan, "simhash-plan"))
    block = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = dealt.select("fp", key(F.col("c")).alias("tile")).join(plan, "tile").select(
        "fp", "tile", block(F.col("own_blocks")).alias("i"), F.explode(every(F.col("near_blocks"))).alias("j"),
        F.lit(True).alias("own"))
    other = dealt.select("fp", F.explode(F.filter(around, ok)).alias("t")).select("fp", key(F.col("t")).alias("tile")) \
        .join(plan, "tile").select("fp", "tile", F.explode(every(F.col("own_blocks"))).alias("i"),
                                   block(F.col("near_blocks")).alias("j"), F.lit(False).alias("own"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["own"].to_numpy()
        fp = group["fp"].to_numpy().view(np.uint64)
        a, b = fp[mine], fp[~mine]
        found = []
        step = max(1, (1 << 21) // max(1, len(b)))
        for lo in range(0, len(a), step):
            rows = a[lo:lo + step, None]
            hit = (np.bitwise_count(rows ^ b[None, :]) <= radius) & (rows.view(np.int64) < b.view(np.int64)[None, :])
            i, j = np.nonzero(hit)
            found.append((a[lo + i], b[j]))
        left = np.concatenate([x for x, _ in found]) if found else a[:0]
        right = np.concatenate([y for _, y in found]) if found else a[:0]
        return pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})

    return own.unionByName(other).groupBy("tile", "i", "j").applyInPandas(compare, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(fp, label) of every linked fingerprint: the smallest fingerprint reachable.  edges: (a, b).

    Each round every node takes the smallest label among itself, its neighbours
    and all nodes that bear the same label (pointer jumping), so long chains need
    few rounds.  Each round is written to the shared folder."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct()
    both = materialize(spark, both, "simhash-edges")
    state = both.groupBy(F.col("x").alias("fp")).agg(F.least(F.min("x"), F.min("y")).alias("label"))
    state = materialize(spark, state, "simhash-labels")
    while not state.isEmpty():
        near = both.join(state.withColumnRenamed("fp", "y"), "y").groupBy(F.col("x").alias("fp")).agg(F.min("label").alias("m"))
        step = state.join(near, "fp", "left").select("fp", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        jump = step.groupBy("old").agg(F.min("new").alias("best"))
        step = step.join(jump, "old").select("fp", "old", F.least("new", "best").alias("label"))
        step = materialize(spark, step, "simhash-labels")
        state = step.select("fp", "label")
        if step.where(F.col("label") < F.col("old")).isEmpty():
            break
    return state


def classes(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (id, key, fp) of every document row, key a hash of id
    and text; nodes (fp, label, first) of every distinct fingerprint: its
    component and the component's smallest (null id last) row."""
    rows = materialize(spark, fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    nodes = materialize(spark, rows.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    found = components(spark, materialize(spark, links(nodes.select("fp"), radius), "simhash-links"))
    linked = nodes.join(found, "fp")
    best = linked.groupBy("label").agg(F.min("first").alias("best"))
    best = linked.select("fp", "label").join(best, "label").select("fp", "label", "best")
    nodes = nodes.join(materialize(spark, best, "simhash-linked"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("best", "first").alias("first"))
    return rows, nodes


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``."""
    rows, nodes = classes(spark, docs, shingle, radius, id_col, text_col)
    return rows.join(nodes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"))


def first_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 3, radius: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first (smallest id) in their component, each once."""
    rows, nodes = classes(spark, docs, shingle, radius, id_col, text_col)
    keep = nodes.where(F.col("first").isNotNull()).select("first.id", "first.key").distinct()
    times = rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    times = materialize(spark, times, "simhash-repeated")
    keyed = docs.withColumn("_key", row_key(F.col(id_col), F.col(text_col)))

    def only(picked: DataFrame) -> DataFrame:
        return keyed.join(picked, (keyed["_key"] == picked["key"]) & keyed[id_col].cast("long").eqNullSafe(picked["id"]),
                          "left_semi").drop("_key")
    if times.isEmpty():
        return only(keep)
    same = (F.col("k.key") == F.col("t.key")) & F.col("k.id").eqNullSafe(F.col("t.id"))
    once = keep.alias("k").join(times.alias("t"), same, "left_anti")
    repeated = keep.alias("k").join(times.alias("t"), same, "left_semi")
    return only(once).unionByName(only(repeated).dropDuplicates([id_col, text_col]))

"""Exact top-k search by integer inner product.

Queries and candidates are dealt into tiles of ``TILE_BYTES``; each pair of tiles
is one matrix product with a partial selection, and the per-tile lists are
merged in a tree (groups of ``FAN`` lists of at most k) until one list per query
is left.  Nothing is broadcast, and no task holds more than one tile pair.  Rows
are dealt by number, so equal rows spread over all tiles.

Defined cases: null vectors and vectors with a null or non-finite component take
no part; vectors of different length never meet; repeated rows are candidates each,
and a query row that is there twice has two lists, each with ranks from 1; a row
never matches a row of its own id; equal scores go to the smaller id; scores are exact
integers, ranked as such and returned clipped to the range of a long; a null id takes
no part; a query without candidates has no rows; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import materialize

TILE_BYTES = 8 << 20
FAN = 16
_LONG = (-(2 ** 63), 2 ** 63 - 1)
_NINES = str.maketrans("0123456789", "9876543210")


def usable(vec: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vec.isNotNull() & F.forall(vec, ok)


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as doubles that hold integers."""
    return F.transform(vec, lambda x: _floor(x.cast("double") * scale))


def _floor(x: Column) -> Column:
    # floor() of a double is a long, which large components overflow
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0 ** 53:
        return q @ c.T
    exact = [[int(x) for x in row] for row in c]
    out = np.empty((len(q), len(c)), dtype=object)
    for i, row in enumerate(q):
        a = [int(x) for x in row]
        out[i] = [sum(x * y for x, y in zip(a, b)) for b in exact]
    return out


def _tile(k: int):
    def search(_key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(shard):
            shard = shard.sort_values("id", kind="stable")
            q_len, c_len = queries["vec"].map(len).to_numpy(), shard["vec"].map(len).to_numpy()
            for n in np.unique(q_len):
                qs, cs = queries[q_len == n], shard[c_len == n]
                if not len(cs):
                    continue
                q, c = np.concatenate(qs["vec"].tolist()).reshape(len(qs), n), np.concatenate(cs["vec"].tolist()).reshape(len(cs), n)
                ids = cs["id"].to_numpy()
                for lo in range(0, len(qs), 256):
                    scores = _products(q[lo:lo + 256], c)
                    for i, (qid, row) in enumerate(zip(qs["id"].iloc[lo:lo + 256], qs["row"].iloc[lo:lo + 256])):
                        rows.append(_select(qid, row, scores[i], ids, k))
        return pd.DataFrame(rows, columns=["query_id", "row", "scores", "beyond", "ids"])
    return search


def _select(qid, row, s, ids, k):
    other = ids != qid
    s, ids = s[other], ids[other]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        keep = s >= least
        s, ids = s[keep], ids[keep]
    # ids ascend, so a stable sort by falling score leaves ties in id order
    order = np.argsort(-s, kind="stable")[:k]
    best = [int(x) for x in s[order]]
    return qid, row, [min(max(x, _LONG[0]), _LONG[1]) for x in best], [_beyond(x) for x in best], [int(x) for x in ids[order]]


def _beyond(score: int) -> str:
    """Orders scores that a long can't tell apart, larger ones first: by sign, length and digits; else empty."""
    if _LONG[0] < score < _LONG[1]:
        return ""
    digits = str(abs(score))
    if score < 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(_NINES)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_tile: int | None = None,
          shard_tile: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best candidates.

    Both inputs: (id long, vec array<double> of integers).  Tiles are given in rows;
    by default ``TILE_BYTES`` of the longest vector make one."""
    spark = queries.sparkSession
    rows = lambda df: df.where(F.col("id").isNotNull()).select("id", "vec", F.monotonically_increasing_id().alias("row"))
    queries, candidates = materialize(spark, rows(queries), "topk-queries"), materialize(spark, rows(candidates), "topk-shards")

    def tiles(df: DataFrame, tile: int | None) -> int:
        told = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
        return max(1, math.ceil(told["n"] / (tile or max(1, TILE_BYTES // (8 * max(1, told["dim"]))))))
    q_tiles, c_tiles = tiles(queries, query_tile), tiles(candidates, shard_tile)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    q = queries.select("id", "row", "vec", dealt(q_tiles).alias("qt"), every(c_tiles).alias("ct"))
    c = candidates.select("id", "vec", dealt(c_tiles).alias("ct"), every(q_tiles).alias("qt"))
    lists = q.groupBy("qt", "ct").cogroup(c.groupBy("qt", "ct")).applyInPandas(
        _with_shard(_tile(k)), "query_id long, row long, part int, scores array<long>, beyond array<string>, ids array<long>")
    top = F.transform(F.arrays_zip("scores", "beyond", "ids"),
                      lambda e: F.struct((-e["scores"].cast("decimal(20,0)")).alias("less"), e["beyond"].alias("beyond"),
                                         e["ids"].alias("id"), e["scores"].alias("score")))
    lists = lists.select("query_id", "row", "part", top.alias("top"))
    parts = c_tiles
    while True:
        parts = math.ceil(parts / FAN)
        lists = lists.groupBy("query_id", "row", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if parts <= 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))


def _with_shard(fn):
    def run(key, queries, shard):
        out = fn(key, queries, shard)
        out.insert(2, "part", np.int32(key[1]))
        return out
    return run

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=20):
    vecs = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in vecs:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in vecs if c != q and len(cv) == len(qv))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def run(spark, sf, rows):
    path = sf(embeddings=spark.createDataFrame([(i, v, 0, "own") for i, v in rows], SCHEMA))
    return sorted(tuple(r) for r in queries.op1_exact_topk(spark, path).collect())


def test_against_brute_force_with_ties_and_bad_vectors(spark, sf):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(120)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf")] * 4),
             (None, [1.0] * 4), (280, [0.5, 0.5]), (281, [0.25, 0.5]), (300, []), rows[5], rows[20], (20, [1.0] * 4),
             (340, [1e30, -1e30, 1e30, 1.0]), (341, [3e30, 1e30, 1e30, 1.0])]
    got, exp = run(spark, sf, rows), brute(rows)
    clip = lambda x: min(max(x, -2 ** 63), 2 ** 63 - 1)
    exp = sorted((q, r, c, clip(s)) for q, r, c, s in exp)
    assert got == exp


def test_scores_beyond_a_long_are_ranked_exactly(spark, sf):
    rows = [(i, [float(x), 1.0]) for i, x in enumerate([1e25, 1e30, 3e30, -1e30, -3e30, 2.5, 3e30])]
    got = run(spark, sf, rows)
    assert [r[2] for r in sorted(got)] == [2, 6, 1, 5, 3, 4]
    big = [10 ** 40, 10 ** 30, 2 ** 63, 2 ** 63 - 1, 0, -2 ** 63, -2 ** 63 - 1, -10 ** 30, -10 ** 40]
    key = [(-min(max(x, -2 ** 63), 2 ** 63 - 1), topk._beyond(x)) for x in big]
    assert [x for _, x in sorted(zip(key, big))] == big


def test_small_tiles_merge_in_a_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = topk.top_k(df.where("id % 20 = 0"), df, 5, query_tile=2, shard_tile=2).collect()
    vecs = [(i, [x / 64 for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got) == brute(vecs, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]])
def test_no_rows(spark, sf, rows):
    assert run(spark, sf, rows) == []


def test_floor_of_large_and_negative(spark):
    df = spark.createDataFrame([([-0.01, 0.99, 1e300],)], "v array<double>").select(topk.quantised(F.col("v")).alias("v"))
    assert df.first()["v"] == [-1.0, 63.0, 64e300]

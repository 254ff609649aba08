import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, dim int, component string"


def run(spark, sf, rows):
    path = sf(embeddings=spark.createDataFrame([(i, v, 0, "own") for i, v in rows], SCHEMA))
    return queries.op11_embedding_whitening(spark, path).collect()


def brute(vecs):
    """Whole numbers, exact deviations and the covariance's eigenvalues of vectors of one length."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vecs]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    y = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, dev, y, e[::-1], u[:, ::-1]


def check(rows, ids, vecs, k=32):
    n, dev, y, e, u = brute(vecs)
    r = int((e > 1e-10 * e[0]).sum())
    k = min(k, r)
    assert len(rows) == len(ids) * k
    got = {}
    for row in rows:
        got.setdefault(row["vec_id"], {})[row["component"]] = row
    for c in range(1, k + 1):
        want = y @ u[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([got[i][c]["whitened"] for i in ids])
        assert np.allclose(have, want, atol=1e-9) or np.allclose(have, -want, atol=1e-9), c
    for i, v in zip(ids, dev):
        assert {x["deviation"] for x in got[i].values()} == {v}
        assert all(x["n"] == n and abs(x["explained"] - e[x["component"] - 1] / e.sum()) < 1e-9 for x in got[i].values())
        assert all(x["identity_error"] < 1e-9 for x in got[i].values())


def test_against_eigenvectors_and_bad_vectors(spark, sf):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 40)) @ np.diag(np.linspace(5, 0.5, 40)) / 8
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [])]
    check(run(spark, sf, rows + bad), [i for i, _ in rows], [v for _, v in rows])


def test_fewer_components_than_asked_and_dependent_dimensions(spark, sf):
    rng = np.random.default_rng(2)
    v = rng.integers(-40, 40, (50, 3)) / 64
    rows = [(i, [float(a), float(b), float(c), float(a) + 1 / 64, 0.5]) for i, (a, b, c) in enumerate(v)]
    check(run(spark, sf, rows), [i for i, _ in rows], [v for _, v in rows])


def test_each_length_is_a_list_of_its_own_and_repeats_count(spark, sf):
    rng = np.random.default_rng(3)
    a = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(20)]
    b = [(100 + i, [float(c) for c in rng.normal(size=2)]) for i in range(20)]
    got = run(spark, sf, a + b)
    check([r for r in got if r["vec_id"] < 100], [i for i, _ in a], [v for _, v in a])
    check([r for r in got if r["vec_id"] >= 100], [i for i, _ in b], [v for _, v in b])


def test_repeated_rows_and_null_ids(spark, sf):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (3, [1.0, 5.0])]
    got = run(spark, sf, rows)
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (3, 1), (3, 2)]
    assert {r["n"] for r in got} == {4}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]])
def test_no_variance_no_rows(spark, sf, rows):
    assert run(spark, sf, rows) == []


def test_large_entries_are_exact(spark, sf):
    rows = [(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [3e38, 0.0]), (4, [0.0, 0.5])]
    got = run(spark, sf, rows)
    held = [[min(max(math.floor(64 * float(np.float32(c))), -2 ** 52), 2 ** 52) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*held)]
    want = {i: min(sum((4 * c - t) ** 2 for c, t in zip(v, s)), 2 ** 63 - 1) for (i, _), v in zip(rows, held)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want


def test_lengths_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [int(c) for c in rng.integers(0, 50, 2 + i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<long>")
    want = sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in whitening.whiten(spark, df).collect())
    monkeypatch.setattr(whitening, "MODEL_CELLS", 1)
    got = sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in whitening.whiten(spark, df).collect())
    assert got == want and len({r[0] for r in got}) == 60


def test_quantised(spark):
    df = spark.createDataFrame([([-0.01, 0.99, 1e300, -1e300],)], "v array<double>").select(whitening.quantised(F.col("v")).alias("v"))
    assert df.first()["v"] == [999_999, 1_000_063, 2 ** 52 + 1_000_000, -2 ** 52 + 1_000_000]


def test_jacobi_resolves_small_eigenvalues():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    e = np.logspace(0, -9, 30)
    got, comps = whitening.one_sided_jacobi(whitening.pivoted_cholesky(q * e @ q.T))
    assert np.allclose(got / e, 1, atol=1e-6) and np.allclose(comps.T @ comps, np.eye(30), atol=1e-12)

"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the factor.

Entries become whole numbers x.  Their sums S and number n are exact; with
m = S div n and r = S mod n a centred entry is (x - m) - r / n, so nothing is
lost to the large offset.  The scatter of the centred vectors is summed from one
partial matrix per task.  Its pivoted Cholesky factor L (scatter = L L') is
rotated by one-sided Jacobi until its columns are orthogonal: their squared norms
are the eigenvalues of the scatter, the normalised columns the components.

Whitened rows are written once; the covariance of what was written, centred on
its own mean, gives ``identity_error``.

Scale: no row is shuffled.  A task emits one partial sum and one partial scatter
per vector length (d (d + 1) / 2 numbers, d at most ``MAX_DIM``), which Spark adds
up; factorising is a task per length, and what reaches the driver is ``k``
components per length.  Lengths are taken in batches of ``MODEL_CELLS`` numbers,
so models held by tasks stay bounded however many lengths there are.

Defined cases: null vectors and those with a null or non-finite entry are
dropped; empty vectors have no components and no rows; vectors of different
length never meet: each length is a fit list of its own (with its own n);
repeated rows count and appear as often as they are there; a null id has rows;
components whose variance is below ``LEAST`` of the largest (equal rows, a single
row, dependent dimensions) can't be scaled to one and have no rows; entries are
held within +-2 ** 52 before the offset, a deviation within the range of a long;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import bounded_batches, materialize, small

COMPONENTS = 32
MAX_DIM = 4_096
MODEL_CELLS = 8_000_000
LEAST = 1e-11
_LIMIT = 1 << 52
_LONG = 2 ** 63 - 1


def quantised(vec: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * x) + offset of each entry, as longs."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(float(-_LIMIT)))
    return F.transform(vec, lambda x: F.floor(held(x)) + offset)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of full column rank with L L' = ``a`` up to rounding (rows in the order of ``a``)."""
    a, d = a.copy(), len(a)
    left, cols = np.diag(a).copy(), []
    floor = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    done = np.zeros(d, bool)
    for _ in range(d):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if not left[p] > floor:
            break
        col = a[:, p].copy()
        for c in cols:
            col -= c * c[p]
        col[done] = 0.0
        col /= np.sqrt(left[p])
        col[p] = np.sqrt(left[p])
        done[p] = True
        left -= col * col
        cols.append(col)
    return np.array(cols).T.reshape(d, len(cols))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n (even) columns once, as n - 1 rounds of disjoint pairs."""
    ring = list(range(n))
    for _ in range(n - 1):
        half = n // 2
        yield np.array(ring[:half]), np.array(ring[:half - 1:-1])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of factor factor', unit eigenvectors as columns), by falling eigenvalue."""
    d, r = factor.shape
    if not r:
        return np.zeros(0), np.zeros((d, 0))
    u = np.concatenate([factor, np.zeros((d, r % 2))], axis=1)
    rounds, tol = list(_rounds(u.shape[1])), np.sqrt(d) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            x, y = u[:, p], u[:, q]
            a, b, g = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(g) > tol * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            g1 = np.where(turn, g, 1.0)
            z = (b - a) / (2 * g1)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = np.where(turn, c * t, 0.0)
            c = np.where(turn, c, 1.0)
            u[:, p], u[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:r]
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of each length of the list column ``vec``."""
    vec = b.column(b.schema.get_field_index("vec"))
    dims = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(dims)
    for n in np.unique(dims):
        rows = np.flatnonzero(dims == n)
        yield int(n), rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if float(np.abs(x).max(initial=0)) * len(x) < 2.0 ** 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def _sums(vecs: DataFrame, exact: bool) -> DataFrame:
    """(dim, pos, n, s): number of vectors and sum of every position."""
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = {}, {}
        for b in batches:
            for d, rows, x in _by_length(b):
                part = _exact_sum(x) if exact else x.sum(axis=0)
                n[d], s[d] = n.get(d, 0) + len(rows), s.get(d, 0) + part
        for d in n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()),
                 pa.array([Decimal(int(v)) for v in s[d]] if exact else s[d], kind)], names=["dim", "pos", "n", "s"])

    number = "decimal(38,0)" if exact else "double"
    found = vecs.select("vec").mapInArrow(run, f"dim int, pos int, n long, s {number}")
    return found.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast(number).alias("s"))


def _scatter(vecs: DataFrame, centred, dims: list[int]) -> DataFrame:
    """(dim, i, j, v), i <= j: sums of the products of ``centred(dim, matrix)``'s columns."""
    wanted = set(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = {}
        for b in batches:
            for d, _, x in _by_length(b):
                if d in wanted:
                    c = centred(d, x)
                    m[d] = m.get(d, 0) + c.T @ c
        for d, s in m.items():
            i, j = np.triu_indices(d)
            for lo in range(0, len(i), 65_536):
                cut = slice(lo, lo + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i[cut]), d, np.int32)), pa.array(i[cut].astype(np.int32)),
                     pa.array(j[cut].astype(np.int32)), pa.array(s[i[cut], j[cut]])], names=["dim", "i", "j", "v"])

    return vecs.select("vec").mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))


def _full(pdf: pd.DataFrame, d: int) -> np.ndarray:
    a = np.zeros((d, d))
    a[pdf["i"], pdf["j"]] = pdf["v"]
    return a + np.triu(a, 1).T


def _decompose(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["dim"].iloc[0])
        a = _full(pdf, d)
        e, comps = one_sided_jacobi(pivoted_cholesky(a))
        use = np.flatnonzero(e > LEAST * e.max(initial=0.0))[:k]
        rows = [(d, c + 1, e[i], e[i] / np.trace(a), comps[:, i].tolist()) for c, i in enumerate(use)]
        return pd.DataFrame(rows, columns=["dim", "component", "eigenvalue", "explained", "vector"])
    return run


def fit(vecs: DataFrame, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], dims: list[int], k: int) -> pd.DataFrame:
    """dim, component, eigenvalue (of the scatter), explained and vector of the lengths ``dims``."""
    def centred(d: int, x: np.ndarray) -> np.ndarray:
        n, m, r = sums[d]
        return (x - m) - r / n

    parts = _scatter(vecs, centred, dims).groupBy("dim").applyInPandas(
        _decompose(k), "dim int, component int, eigenvalue double, explained double, vector array<double>")
    return parts.toPandas().sort_values(["dim", "component"])


def _deviation(x: np.ndarray, n: int, m: np.ndarray, r: np.ndarray) -> list[int]:
    y = x - m
    if (float(np.abs(y).max(initial=0)) + 1) * n < 2.0 ** 31 / max(1, x.shape[1]) ** 0.5:
        z = n * y - r
        return (z * z).sum(axis=1).tolist()
    z = n * y.astype(object) - r.astype(object)
    return [min(int(v), _LONG) for v in (z * z).sum(axis=1)]


def _whitened(vecs: DataFrame, sums: dict, models: dict[int, np.ndarray]) -> DataFrame:
    """(id, dim, deviation, vec): ``vec`` holds the whitened components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in _by_length(b):
                if d not in models:
                    continue
                n, m, r = sums[d]
                w = ((x - m) - r / n) @ models[d]
                ends = np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("id")).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)),
                     pa.array(_deviation(x, n, m, r), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], names=["id", "dim", "deviation", "vec"])
    return vecs.select("id", "vec").mapInArrow(run, "id long, dim int, deviation long, vec array<double>")


def _identity_errors(whitened: DataFrame) -> dict[int, float]:
    """Number of components -> largest entry of |covariance - identity| (rows of one number belong together)."""
    mean, n = {}, {}
    for d, part in _sums(whitened, exact=False).toPandas().sort_values("pos").groupby("dim"):
        n[d] = int(part["n"].iloc[0])
        mean[d] = part["s"].to_numpy() / n[d]
    if not n:
        return {}
    cov = _scatter(whitened, lambda d, x: x - mean[d], list(n)).toPandas()
    return {d: float(np.abs(_full(part, d) / n[d] - np.eye(d)).max()) for d, part in cov.groupby("dim")}


def whiten(spark: SparkSession, vecs: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    ``vecs``: (id long, vec array<long> of ``quantised`` entries)."""
    with bounded_batches(spark):
        return _whiten(spark, vecs, k)


def _whiten(spark: SparkSession, vecs: DataFrame, k: int) -> DataFrame:
    sums = {}
    for d, part in _sums(vecs, exact=True).toPandas().sort_values("pos").groupby("dim"):
        n, s = int(part["n"].iloc[0]), [int(v) for v in part["s"]]
        if d > MAX_DIM:
            raise ValueError(f"vectors of {d} entries; at most {MAX_DIM} are handled")
        sums[int(d)] = n, np.array([v // n for v in s], np.int64), np.array([v % n for v in s], np.int64)
    batches, cells = [[]], 0
    for d in sorted(sums):
        if cells + d * k > MODEL_CELLS and batches[-1]:
            batches.append([])
            cells = 0
        batches[-1].append(d)
        cells += d * k
    out = None
    for dims in batches:
        part = _whiten_lengths(spark, vecs, sums, dims, k)
        out = part if out is None else out.unionByName(part)
    return out


def _whiten_lengths(spark: SparkSession, vecs: DataFrame, sums: dict, dims: list[int], k: int) -> DataFrame:
    vecs = vecs.where(F.size("vec").isin(dims)) if dims else vecs.limit(0)
    sums = {d: sums[d] for d in dims}
    models, facts = {}, []
    for d, m in (fit(vecs, sums, dims, k).groupby("dim") if dims else ()):
        scale = 1 / np.sqrt(m["eigenvalue"].to_numpy() / sums[d][0])
        models[int(d)] = np.array(m["vector"].tolist()).T * scale
        facts += [(int(d), sums[d][0], int(c), float(x)) for c, x in zip(m["component"], m["explained"])]
    rows = materialize(spark, _whitened(vecs, sums, models), "whitened")
    errors = {}
    for d in models:
        own = rows.where(F.col("dim") == d) if len(models) > 1 else rows
        errors[d] = max(_identity_errors(own).values())
    table = spark.createDataFrame([(*f, errors[f[0]]) for f in facts],
                                  "dim int, n long, component int, explained double, identity_error double")
    each = rows.select(F.col("id").alias("vec_id"), "dim", "deviation", F.posexplode("vec").alias("pos", "whitened"))
    each = each.withColumn("component", F.col("pos") + 1)
    return each.join(small(table, len(facts)), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

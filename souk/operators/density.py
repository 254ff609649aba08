"""DBSCAN (AN4) as Spark jobs.

Equal rows are one point with a weight.  A micro-cell (side eps / sqrt(d), so of
diameter eps at most) that holds ``min_samples`` rows is all core without any
pair test.  All other points are compared with the points around them: points
are dealt to blocks over the first features (over more of them the fewer the
queries), every query to all blocks it comes within eps of, every data point to
its own block, and a block's queries and data are split into chunks of
bounded size; data of blocks without queries stay where they are.  A point near a
query is met in the point's block alone, so the counts of the blocks add up.  Queries that reach ``min_samples`` within the first data chunk are
settled; only the rest meet the other chunks.  No neighbour is left out: a
count is cut off only after it has reached ``min_samples``.

A task holds one chunk of queries and one of data; it halves its queries into small
boxes and looks only at the data near each.  Core points are linked by cells, not
by points: a task returns a spanning forest of its cells, pairs of cells are settled
by their boxes or by one pair of points, and pairs already connected are skipped.
Components of core cells are found by smallest-label rounds, each written to the
checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators.ordered import BROADCAST_ROWS, materialize, small

QUERY_CHUNK = 8_192
DATA_CHUNK = 65_536
BLOCK_DIMS = 3
LEAF = 256


def _normalised(cols: Sequence[str]) -> list:
    """The features as doubles; a missing value counts as 0."""
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) + 0.0 for c in cols]


def _cell(names: Sequence[str], eps: float):
    side = eps / math.sqrt(len(names)) * (1 - 1e-9)
    return F.xxhash64(*[F.floor(F.col(n) / side) for n in names])


def _points(df: DataFrame, cols: Sequence[str], eps: float) -> DataFrame:
    """(id, x0.., w, cell) of the distinct rows; a missing value counts as 0."""
    names = [f"x{i}" for i in range(len(cols))]
    pts = df.select(*[x.alias(n) for x, n in zip(_normalised(cols), names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
    return materialize(pts.select(F.monotonically_increasing_id().alias("id"), *names, "w", _cell(names, eps).alias("cell")))


def _with(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined to ``facts``; written only if they are too many to be broadcast."""
    n = facts.count()
    out = df.join(small(facts, n), key, "left")
    return out if n <= BROADCAST_ROWS else materialize(out)


def _block_dims(d: int, queries: int, points: int) -> int:
    """Features that the blocks are cut over: ``BLOCK_DIMS``, and more as long as the queries'
    copies, about two for each feature, are fewer than the points."""
    dims = min(d, BLOCK_DIMS)
    while dims < d and queries << (dims + 1) <= points:
        dims += 1
    return dims


def _blocks(pts: DataFrame, dims: int, eps: float, halo: bool) -> DataFrame:
    """``pts`` with their block over ``dims`` features, or with every block within eps of them."""
    side, reach = 2 * eps, eps * (1 + 1e-9)
    keys = []
    for i in range(dims):
        x = F.col(f"x{i}")
        if halo:
            pts = pts.withColumn(f"_b{i}", F.explode(F.sequence(F.floor((x - reach) / side), F.floor((x + reach) / side))))
        else:
            pts = pts.withColumn(f"_b{i}", F.floor(x / side))
        keys.append(f"_b{i}")
    return pts.withColumn("block", F.xxhash64(*keys)).drop(*keys)


def _chunked(side: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with their chunk ``own`` and a copy for every chunk of the other side."""
    at = F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int").alias(own)
    every = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
    return side.join(sizes, "block").select(*[side[c] for c in side.columns], at, every)


def _compare(queries: DataFrame, data: DataFrame, d: int, test, schema: str, first_only: bool | None = None) -> DataFrame:
    """Runs ``test`` on every pair of query and data chunk of a block.

    ``first_only``: only the first data chunk (True) or all others (False)."""
    n = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("n_q"))
    m = data.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / DATA_CHUNK).cast("int").alias("n_d"))
    sizes = materialize(n.join(m, "block"))
    sizes = small(sizes, sizes.count())          # one row per block that holds queries and data
    q, p = _chunked(queries, sizes, "q", "d"), _chunked(data, sizes, "d", "q")
    if first_only is not None:
        pick = F.col("d") == 0 if first_only else F.col("d") > 0
        q, p = q.where(pick), p.where(pick)
    names = [f"x{i}" for i in range(d)]
    extra = [c for c in ("cell", "label") if c in data.columns]
    q = q.select("block", "q", "d", "id", *names, F.lit(0).cast("long").alias("w"),
                 *[F.col(c) if c in queries.columns else F.lit(0).cast("long").alias(c) for c in extra], F.lit(True).alias("query"))
    p = p.select("block", "q", "d", "id", *names, F.col("w").cast("long").alias("w"), *extra, F.lit(False).alias("query"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return test(pdf[pdf["query"]], pdf[~pdf["query"]], names)
    return q.unionByName(p).groupBy("block", "q", "d").applyInPandas(run, schema)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether each row of a lies within eps of each row of b."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        diff = a[:, i, None] - b[None, :, i]
        total += diff * diff
    return total <= eps * eps


def _walk(a: np.ndarray, b: np.ndarray, eps: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): boxes of at most ``leaf`` rows of a, halved along their longest side, each with
    the rows of b that lie within eps of the box, in ascending order."""
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    while todo:
        i, j = todo.pop()
        lo, hi, x = a[i].min(axis=0), a[i].max(axis=0), b[j]
        gap = np.maximum(np.maximum(lo - x, x - hi), 0)
        j = j[(gap * gap).sum(axis=1) <= eps * eps * (1 + 1e-9)]
        if not len(j):
            continue
        if len(i) <= leaf or (hi == lo).all():
            yield i, j
            continue
        order = np.argpartition(a[i, int(np.argmax(hi - lo))], len(i) // 2)
        todo += [(i[order[:len(i) // 2]], j), (i[order[len(i) // 2:]], j)]


def _count_test(eps: float, enough: int):
    """Rows near each query, counted exactly up to ``enough``."""
    def test(q: pd.DataFrame, p: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        a, b, w = q[names].to_numpy(), p[names].to_numpy(), p["w"].to_numpy()
        n = np.zeros(len(a), np.int64)
        for i, j in _walk(a, b, eps) if len(a) else ():
            off = b[j] - a[i].mean(axis=0)
            j = j[np.argsort((off * off).sum(axis=1), kind="stable")]      # the nearest settle most queries
            open_ = i
            for lo in range(0, len(j), 1024):
                at = j[lo:lo + 1024]
                n[open_] += _near(a[open_], b[at], eps) @ w[at]
                open_ = open_[n[open_] < enough]
                if not len(open_):
                    break
        return pd.DataFrame({"id": q["id"].to_numpy(), "n": n})
    return test


def _label_test(eps: float):
    """Smallest label among the data points near each query."""
    def test(q: pd.DataFrame, p: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        p = p.sort_values("label", kind="stable")
        a, b, label = q[names].to_numpy(), p[names].to_numpy(), p["label"].to_numpy()
        found = np.full(len(a), -1)
        for i, j in _walk(a, b, eps) if len(a) else ():
            open_ = i
            for lo in range(0, len(j), 1024):
                hit = _near(a[open_], b[j[lo:lo + 1024]], eps)
                any_ = hit.any(axis=1)
                found[open_[any_]] = j[lo + hit[any_].argmax(axis=1)]
                open_ = open_[~any_]
                if not len(open_):
                    break
        ok = found >= 0
        return pd.DataFrame({"id": q["id"].to_numpy()[ok], "label": label[found[ok]]})
    return test


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of each pair; ``parent`` points every node straight at its root."""
    while len(u):
        x, y = parent[u], parent[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _boxes(x: np.ndarray, cell: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """The points by cell: (order, first point of each cell, cell numbers, lower and upper corners)."""
    order = np.argsort(cell, kind="stable")
    own, first = np.unique(cell[order], return_index=True)
    by = x[order]
    return (order, np.append(first, len(x)), np.searchsorted(cells, own),
            np.minimum.reduceat(by, first, axis=0), np.maximum.reduceat(by, first, axis=0))


def _link_test(eps: float):
    """A spanning forest of the cells that hold points near each other, as pairs of cells.

    Pairs of cells whose boxes are more than eps apart are skipped; those whose boxes
    lie within eps of each other altogether are linked without looking at points.
    The rest are tried nearest first, unless their cells are already connected, until
    one pair of points within eps is found."""
    def test(q: pd.DataFrame, p: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        a, b, ca, cb = q[names].to_numpy(), p[names].to_numpy(), q["cell"].to_numpy(), p["cell"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        cells = np.unique(np.concatenate([ca, cb]))
        parent = np.arange(len(cells))
        at_a, from_a, own_a, lo_a, hi_a = _boxes(a, ca, cells)
        at_b, from_b, own_b, lo_b, hi_b = _boxes(b, cb, cells)
        maybe = []
        # a cell is eps across at most: centres of linked cells are within 2 eps
        for i, j in _walk((lo_a + hi_a) / 2, (lo_b + hi_b) / 2, 2 * eps):
            for k in range(0, len(j), 4096):
                jj = j[k:k + 4096]
                least, most = np.zeros((len(i), len(jj))), np.zeros((len(i), len(jj)))
                for c in range(a.shape[1]):
                    gap = np.maximum(lo_b[jj, c] - hi_a[i, c, None], lo_a[i, c, None] - hi_b[jj, c])
                    far = np.maximum(hi_b[jj, c] - lo_a[i, c, None], hi_a[i, c, None] - lo_b[jj, c])
                    least += np.maximum(gap, 0) ** 2
                    most += far * far
                new = own_a[i, None] < own_b[jj]
                x, y = np.nonzero(new & (most <= eps * eps))
                _unite(parent, own_a[i[x]], own_b[jj[y]])
                x, y = np.nonzero(new & (most > eps * eps) & (least <= eps * eps * (1 + 1e-9)))
                apart = parent[own_a[i[x]]] != parent[own_b[jj[y]]]
                x, y = x[apart], y[apart]
                maybe.append(np.stack([least[x, y], i[x], jj[y]]))
        maybe = np.concatenate(maybe, axis=1) if maybe else np.zeros((3, 0))
        maybe = maybe[:, np.argsort(maybe[0], kind="stable")]
        for k in range(0, maybe.shape[1], 256):
            u, v = maybe[1, k:k + 256].astype(int), maybe[2, k:k + 256].astype(int)
            apart = parent[own_a[u]] != parent[own_b[v]]
            for x, y in zip(u[apart], v[apart]):
                if parent[own_a[x]] != parent[own_b[y]] and _touch(a[at_a[from_a[x]:from_a[x + 1]]], b[at_b[from_b[y]:from_b[y + 1]]], eps):
                    _unite(parent, own_a[x:x + 1], own_b[y:y + 1])
        linked = np.flatnonzero(parent != np.arange(len(cells)))
        return pd.DataFrame({"a": cells[parent[linked]], "b": cells[linked]})
    return test


def _touch(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether a point of x lies within eps of a point of y."""
    reach = eps * (1 + 1e-9)
    x = x[((x >= y.min(axis=0) - reach) & (x <= y.max(axis=0) + reach)).all(axis=1)]
    if not len(x):
        return False
    y = y[((y >= x.min(axis=0) - reach) & (y <= x.max(axis=0) + reach)).all(axis=1)]
    return any(_near(x[i:i + 512], y[j:j + 512], eps).any() for i in range(0, len(x), 512) for j in range(0, len(y), 512))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, label): smallest cell reachable over ``edges`` (a, b)."""
    both = materialize(edges.union(edges.select("b", "a")).distinct())
    state = materialize(nodes.select("cell", F.col("cell").alias("label")))
    while True:
        near = both.join(state, both["b"] == state["cell"]).groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("m"))
        step = state.join(near, "cell", "left").select("cell", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        jump = step.groupBy("old").agg(F.min("new").alias("best"))
        step = materialize(step.join(jump, "old").select("cell", "old", F.least("new", "best").alias("label")))
        state = step.select("cell", "label")
        if step.where(F.col("label") < F.col("old")).isEmpty():
            return state


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 10, labels: bool = True) -> DataFrame:
    """Adds ``dbscan_core`` and ``dbscan_anomaly`` (noise: no core row within eps)
    and, with ``labels``, ``dbscan_label``: -1 for noise, else the cluster, numbered
    from 0 in order of its smallest cell key; a border row takes the smallest of the
    clusters it touches.  A row counts itself; missing values count as 0; an empty
    table gives an empty result."""
    cols, d = list(cols), len(cols)
    pts = _points(df, cols, eps)
    names = [f"x{i}" for i in range(d)]
    dense = pts.groupBy("cell").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples).select("cell", F.lit(True).alias("dense"))
    dense = materialize(dense)
    pts = _with(pts, dense, "cell")
    n_points, n_sparse = pts.agg(F.count(F.lit(1)), F.count_if(F.col("dense").isNull())).first()
    dims = _block_dims(d, n_sparse, n_points)
    data = _blocks(pts, dims, eps, halo=False)
    sparse = _blocks(pts.where(F.col("dense").isNull()), dims, eps, halo=True)
    count = _count_test(eps, min_samples)
    first = _compare(sparse, data, d, count, "id long, n long", first_only=True)
    first = materialize(first.groupBy("id").agg(F.sum("n").alias("n")))
    rest = sparse.join(first.where(F.col("n") >= min_samples), "id", "left_anti")
    more = _compare(rest, data, d, count, "id long, n long", first_only=False)
    enough = first.unionByName(more).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
    enough = materialize(enough.select("id", F.lit(True).alias("reached")))
    pts = _with(pts, enough, "id").withColumn("core", F.coalesce("dense", "reached", F.lit(False)))
    core = pts.where("core")
    if labels:
        near = min(d, BLOCK_DIMS)
        links = _compare(_blocks(core, near, eps, halo=False), _blocks(core, near, eps, halo=True), d, _link_test(eps), "a long, b long")
        groups = _components(core.select("cell").distinct(), links.distinct())
        core = materialize(core.join(groups, "cell"))
    else:
        core = core.withColumn("label", F.lit(0).cast("long"))
    border = _compare(_blocks(pts.where("not core"), dims, eps, halo=True), _blocks(core, dims, eps, halo=False), d,
                      _label_test(eps), "id long, label long").groupBy("id").agg(F.min("label").alias("label"))
    placed = core.select("id", "label").unionByName(border)
    if labels:
        order = _numbered(core.select("label").distinct())
        placed = placed.join(order, "label").select("id", F.col("number").alias("label"))
    label = F.coalesce("label", F.lit(-1)).cast("long").alias("label")
    # a dense cell tells all its rows by itself; only the rows of other cells look for their point
    keyed = df.withColumns({f"_x{i}": x for i, x in enumerate(_normalised(cols))})
    keyed = keyed.withColumn("_cell", _cell([f"_{n}" for n in names], eps))
    if labels:
        dense = pts.where("dense").join(placed, "id").groupBy("cell").agg(F.min("label").alias("label"))
    told = dense.withColumn("label", F.col("label") if labels else F.lit(0))
    told = materialize(told.select(F.col("cell").alias("_cell"), F.lit(True).alias("core"), label))
    told = small(told, told.count())
    alone = materialize(pts.where(F.col("dense").isNull()).join(placed, "id", "left").select(*[F.col(n).alias(f"_{n}") for n in names], "core", label))
    n, own = alone.count(), [f"_{n}" for n in names]
    found = keyed.join(told, "_cell", "left")
    if n <= BROADCAST_ROWS:
        alone = alone.withColumnsRenamed({"core": "_core", "label": "_label"})
        out = found.join(F.broadcast(alone), own, "left").select(
            *df.columns, F.coalesce("core", "_core").alias("core"), F.coalesce("label", "_label").alias("label"))
    else:
        found = materialize(found)
        out = found.where("core").select(*df.columns, "core", "label").unionByName(
            found.where("core is null").drop("core", "label").join(alone, own).select(*df.columns, "core", "label"))
    out = out.withColumn("dbscan_core", F.col("core")).withColumn("dbscan_anomaly", F.col("label") == -1)
    if labels:
        out = out.withColumn("dbscan_label", F.col("label").cast("long"))
    return out.drop("core", "label")


def _numbered(clusters: DataFrame) -> DataFrame:
    """(label, number): clusters numbered from 0 in order of their label."""
    from souk.operators.ordered import prefix_sum
    ranked = prefix_sum(clusters.withColumn("one", F.lit(1)), ["label"], ["one"])
    return ranked.select("label", (F.col("cum_one") - 1).cast("long").alias("number"))

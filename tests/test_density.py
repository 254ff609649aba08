"""DBSCAN against a brute-force version on rows."""

import numpy as np
import pytest

from souk.operators import anomaly as AN
from souk.operators import density as DE


def brute(x, eps, least):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = n
                        stack.append(j)
            n += 1
    touched = [set(label[near[i] & core]) for i in range(len(x))]
    return core, label, touched


def points(d, seed=1):
    r = np.random.default_rng(seed)
    centres = r.uniform(-4, 4, (5, d))
    x = np.concatenate([c + r.normal(0, 0.25, (60, d)) for c in centres] + [r.uniform(-6, 6, (60, d))])
    x[:12] = x[0]                                   # equal rows are dense by themselves
    return np.concatenate([x, np.linspace(x[0], x[0] + 3, 40)])      # a chain


@pytest.mark.parametrize("d", [1, 2, 4])
def test_against_brute_force(spark, d, monkeypatch):
    monkeypatch.setattr(DE, "QUERY_CHUNK", 40)
    monkeypatch.setattr(DE, "DATA_CHUNK", 90)
    x = points(d)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], ["k", *[f"f{i}" for i in range(d)]])
    out = DE.dbscan(df, [f"f{i}" for i in range(d)], eps=0.5, min_samples=6).toPandas().set_index("k").sort_index()
    core, label, touched = brute(x, 0.5, 6)
    assert len(out) == len(x) and (out.dbscan_core.to_numpy() == core).all()
    noise = np.array([not core[i] and not touched[i] for i in range(len(x))])
    assert (out.dbscan_anomaly.to_numpy() == noise).all() and noise.any() and (~core & ~noise).any()
    got = out.dbscan_label.to_numpy()
    name = {}
    for i in np.flatnonzero(core):                  # the same partition of the core rows
        assert name.setdefault(label[i], got[i]) == got[i]
    assert sorted(name.values()) == list(range(len(name)))
    for i in np.flatnonzero(~core):
        assert got[i] == min((name[t] for t in touched[i]), default=-1)


def test_null_features_and_empty_table(spark):
    df = spark.createDataFrame([(i, 0.01 * i, None) for i in range(12)] + [(99, 5.0, float("nan"))], "k int, a double, b double")
    out = {r["k"]: r["dbscan_anomaly"] for r in DE.dbscan(df, ["a", "b"], min_samples=10, labels=False).collect()}
    assert out == {**{i: False for i in range(12)}, 99: True}
    assert DE.dbscan(df.limit(0), ["a", "b"]).count() == 0


def test_three_detectors_vote(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(0, 0.3, (300, 2)))] + [(1000, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    df = AN.isolation_forest(df, ["a", "b"], ["k"], n_trees=50, contamination=0.01)
    df = DE.dbscan(AN.zscore_flags(df, ["a", "b"]), ["a", "b"], labels=False)
    out = AN.votes(df)
    assert out.schema["confirmed_anomaly"].dataType.simpleString() == "boolean"
    top = out.where("anomaly_votes = 3").collect()
    assert [t["k"] for t in top] == [1000]


@pytest.mark.parametrize("eps", [0.3, 0.08])
def test_dense_cells_are_linked_by_boxes_and_pairs(spark, eps, monkeypatch):
    monkeypatch.setattr(DE, "LEAF", 16)
    x = np.random.default_rng(9).uniform(0, 1, (900, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k long, a double, b double, c double")
    out = DE.dbscan(df, ["a", "b", "c"], eps=eps, min_samples=4).toPandas().set_index("k").sort_index()
    core, label, touched = brute(x, eps, 4)
    assert (out.dbscan_core.to_numpy() == core).all()
    got = out.dbscan_label.to_numpy()
    assert len(set(got[core])) == len(set(label[core])) == len(set(zip(got[core], label[core])))


def test_a_task_links_cells_by_a_forest():
    r = np.random.default_rng(1)
    x = np.concatenate([r.uniform(0, 1, (2000, 2)), r.uniform(3, 4, (500, 2))])
    import pandas as pd
    side = 0.2 / np.sqrt(2)
    pdf = pd.DataFrame(x, columns=["x0", "x1"]).assign(cell=(np.floor(x[:, 0] / side) * 1000 + np.floor(x[:, 1] / side)).astype(np.int64))
    links = DE._link_test(0.2)(pdf, pdf, ["x0", "x1"])
    assert len(links) == pdf.cell.nunique() - 2        # two clusters
    assert len(DE._link_test(0.2)(pdf[:0], pdf, ["x0", "x1"])) == 0


def test_data_points_are_not_copied(spark):
    x = points(4)
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], [f"f{i}" for i in range(4)])
    pts = DE._points(df, df.columns, 0.5)
    dims = DE._block_dims(4, 5, pts.count())
    assert dims == 4 and DE._block_dims(4, 200, 300) == DE.BLOCK_DIMS and DE._block_dims(2, 0, 9) == 2
    assert DE._blocks(pts, dims, 0.5, halo=False).count() == pts.count()
    # a pair of near points meets in exactly one block
    a = DE._blocks(pts, dims, 0.5, halo=True).select("id", "block")
    b = DE._blocks(pts, dims, 0.5, halo=False).select("id", "block").toPandas().set_index("id")["block"]
    seen = a.toPandas().groupby("id")["block"].apply(list)
    xs = pts.toPandas().set_index("id")[[f"x{i}" for i in range(4)]]
    for i in xs.index[:40]:
        for j in xs.index[((xs - xs.loc[i]) ** 2).sum(axis=1) <= 0.25]:
            assert seen[i].count(b[j]) == 1


def test_many_sparse_points_and_cells(spark, monkeypatch):
    monkeypatch.setattr(DE, "BROADCAST_ROWS", 5)
    x = points(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], ["k", "f0", "f1"])
    out = DE.dbscan(df, ["f0", "f1"], eps=0.5, min_samples=6, labels=False).toPandas().set_index("k").sort_index()
    core, _, touched = brute(x, 0.5, 6)
    assert len(out) == len(x) and (out.dbscan_core.to_numpy() == core).all()
    assert (out.dbscan_anomaly.to_numpy() == np.array([not core[i] and not touched[i] for i in range(len(x))])).all()

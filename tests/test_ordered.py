import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from souk.operators import ordered as OR


def test_prefix_sum_matches_cumsum_with_hot_group(spark):
    rng = np.random.default_rng(1)
    # group "hot" holds most rows; values unique per group
    pdf = pd.DataFrame({"g": ["hot"] * 400 + ["a"] * 30 + ["b"] * 20,
                        "x": np.concatenate([rng.permutation(400), rng.permutation(30), rng.permutation(20)]),
                        "w": rng.integers(1, 5, 450)})
    df = spark.createDataFrame(pdf)
    got = OR.prefix_sum(df, "x", ["w"], by=["g"], partitions=7).toPandas()
    exp = pdf.sort_values(["g", "x"]).assign(cum=lambda t: t.groupby("g")["w"].cumsum())
    m = got.merge(exp, on=["g", "x"])
    assert len(m) == 450
    assert (m["cum_w"] == m["cum"]).all()
    assert (m["total_w"] == m.groupby("g")["w_x"].transform("sum")).all()


def test_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.integers(0, 20, 300).astype(float), rng.normal(50, 10, 100)])
    grp = np.array(["a"] * 250 + ["b"] * 150)
    df = spark.createDataFrame(pd.DataFrame({"g": grp, "x": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = OR.quantiles(df, "x", probs, by=["g"], partitions=5).toPandas()
    for g in ("a", "b"):
        exp = np.percentile(vals[grp == g], [p * 100 for p in probs])
        row = got[got.g == g].sort_values("q")["value"].to_numpy()
        assert np.allclose(row, exp, rtol=0, atol=1e-9)


def test_quantiles_invariant_under_repartition(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).cast("double").alias("x"))
    a = OR.quantiles(df.repartition(1), "x", [0.3, 0.9]).orderBy("q").collect()
    b = OR.quantiles(df.repartition(13), "x", [0.3, 0.9], partitions=11).orderBy("q").collect()
    assert [r.value for r in a] == [r.value for r in b]


def _percentiles(pdf, probs, by):
    return {(k, c, q): np.percentile(g[c].dropna(), 100 * q) for k, g in pdf.groupby(by) for c, qs in probs.items() for q in qs
            if g[c].notna().any()}


def _wide(n=30_000):
    rng = np.random.default_rng(4)
    g = np.where(rng.random(n) < 0.6, "big", np.where(rng.random(n) < 0.98, "mid", "few"))
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 100, n))       # one value holds over a third
    some = pd.Series(rng.lognormal(3, 2, n)).where(rng.random(n) > 0.1)
    return pd.DataFrame({"g": g, "hot": hot, "some": some, "steps": rng.integers(0, 5, n).astype(float)})


@pytest.mark.parametrize("piece", [OR.PIECE_ROWS, 50])
def test_bracketed_quantiles_of_several_columns(spark, monkeypatch, piece):
    monkeypatch.setattr(OR, "PIECE_ROWS", piece)     # 50: ranked by a prefix sum, not by a window
    pdf = _wide()
    probs = {"hot": [0.0, 0.3, 0.5, 0.999], "some": [0.25, 0.5, 0.75, 1.0], "steps": [0.5, 0.95]}
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, hot double, some double, steps double").repartition(5)
    got = {(r["g"], r["feature"], r["q"]): r["value"] for r in OR.column_quantiles(df, probs, ["g"]).collect()}
    want = _percentiles(pdf, probs, "g")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quantiles_rank_only_rows_inside_the_brackets(spark, monkeypatch):
    seen, real = [], OR.prefix_sum
    monkeypatch.setattr(OR, "PIECE_ROWS", 50)
    monkeypatch.setattr(OR, "prefix_sum", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"))
    got = OR.quantiles(df, "x", [0.5]).first()["value"]
    xs = [r["x"] for r in df.collect()]
    assert got == np.percentile(xs, 50) and len(seen) == 1 and seen[0] < 0.02 * 200_000


def test_a_missed_bracket_is_ranked_in_full(spark, monkeypatch):
    monkeypatch.setattr(OR, "SMALL_GROUP", 0)
    monkeypatch.setattr(OR, "ACCURACY", 1_000_000)       # brackets of one value: the two ranks around a target differ
    df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in range(10)] + [("c", 5.0)], "g string, x double")
    got = {(r["g"], r["q"]): r["value"] for r in OR.quantiles(df, "x", [0.0, 0.33], ["g"]).collect()}
    assert got == {**{(g, 0.0): 0.0 for g in "ab"}, **{(g, 0.33): pytest.approx(2.97) for g in "ab"}, ("c", 0.0): 5.0, ("c", 0.33): 5.0}


def test_quantiles_without_values(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert [r for r in OR.quantiles(none, "x", [0.5]).collect()] == []
    assert OR.quantiles(none.limit(0), "x", [0.5]).collect() == []
    assert OR.quantile_row(none, "x", {"m": 0.5}).first()["m"] is None


def test_running_sums_take_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("w"))
    plan = OR.scanned_pieces(df, [F.col("x")], ["w"], ["g"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Window" not in plan


def test_prefix_sum_of_nulls_strings_and_doubles(spark):
    rows = [("a", 1, 0.5, None), ("a", 2, None, 3), (None, 1, 2.0, 1), (None, 2, 1.0, 1), ("b", 1, -1.0, 2)]
    df = spark.createDataFrame(rows, "g string, k int, w double, n int")
    got = {(r["g"], r["k"]): (r["cum_w"], r["cum_n"], r["total_w"], r["total_n"])
           for r in OR.prefix_sum(df, "k", ["w", "n"], ["g"], partitions=3).collect()}
    assert got == {("a", 1): (0.5, 0, 0.5, 3), ("a", 2): (0.5, 3, 0.5, 3), (None, 1): (2.0, 1, 3.0, 2),
                   (None, 2): (3.0, 2, 3.0, 2), ("b", 1): (-1.0, 2, -1.0, 2)}


def test_gini_properties(spark):
    eq = spark.createDataFrame([(5.0,)] * 10, "revenue double")
    g = OR.gini(eq).first()
    assert abs(g.gini) < 1e-12
    dom = spark.createDataFrame([(0.0,)] * 99 + [(100.0,)], "revenue double")
    g2 = OR.gini(dom).first()
    assert abs(g2.gini - 0.99) < 1e-9         # (n-1)/n
    rng = np.random.default_rng(3)
    vals = rng.lognormal(3, 1, 500)
    g3 = OR.gini(spark.createDataFrame([(float(v),) for v in vals], "revenue double")).first()
    s = np.sort(vals)
    n = len(s)
    exp = (2 * np.sum(np.arange(1, n + 1) * s)) / (n * s.sum()) - (n + 1) / n
    assert 0 <= g3.gini <= 1 and abs(g3.gini - exp) < 1e-9
    # the printed formula: 1 - 2 * trapezoid(descending cumulative share)
    desc = np.sort(vals)[::-1]
    cum = np.cumsum(desc) / desc.sum()
    x = np.linspace(0, 1, n)
    ref = 1 - 2 * np.sum((cum[1:] + cum[:-1]) / 2 * np.diff(x))
    assert abs(g3.reference_gini - ref) < 1e-9 and g3.reference_gini <= 0


def test_lorenz_and_ecdf(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (6.0,)], "revenue double")
    pts = {r.revenue: (r.population_share, r.value_share) for r in OR.lorenz(df).collect()}
    assert pts == {1.0: (0.5, 0.2), 2.0: (0.75, 0.4), 6.0: (1.0, 1.0)}
    e = {r.value: r.ecdf for r in OR.ecdf(df, ["revenue"]).collect()}
    assert e == {1.0: 0.5, 2.0: 0.75, 6.0: 1.0}


def test_pareto_crossing(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0)], "k string, revenue double")
    rows = OR.pareto(df, "k").orderBy("rank").collect()
    assert [r.k for r in rows] == ["a", "b", "c", "d"]
    assert [r.crosses_80 for r in rows] == [False, True, False, False]
    assert abs(rows[-1].cumulative_pct - 100.0) < 1e-12


def test_rolling_full_window_and_growth(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k int, v double")
    r = OR.rolling_stats(s, "k", "v").orderBy("k").collect()
    assert r[0].rolling_mean is None and r[-1].rolling_mean is None
    assert r[1].rolling_mean == 2.0 and abs(r[1].rolling_std - 1.0) < 1e-12
    g = OR.growth(s, "k", "v").orderBy("k").collect()
    assert g[0].growth_pct is None and abs(g[1].growth_pct - 100.0) < 1e-12
    assert OR.latest_delta(s, "k", "v").first().delta == 1.0

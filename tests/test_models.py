import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from order_rows import d, order, orders_df
from souk.operators import anomaly as AN
from souk.operators import ml as ML
from souk.operators import summary as SU
from souk.operators import timeseries as TS


def _model_rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = float(rng.uniform(100, 1000))
        rows.append(order(i, d(2022, 1 + i % 12, 1 + i % 28), base=base, disc=float(rng.choice([10, 20, 30])),
                          units=int(rng.integers(1, 10)), category=["A", "B"][i % 2],
                          zone=["North", "South"][i % 2], state=["S1", "S2", "S3"][i % 3]))
    return rows


def test_linear_model_fits_exact_relation(spark):
    df = orders_df(spark, _model_rows())
    # revenue = 3 * base_price exactly -> linear model is perfect on the test split
    df = df.withColumn("revenue", F.col("base_price") * 3.0)
    m = ML.compare_models(df, ["order_id"], names=["Linear Regression"]).first()
    assert m.r2 > 0.999999 and m.rmse < 1e-3


def test_unknown_category_encodes_to_zero(spark):
    df = orders_df(spark, _model_rows(50))
    model = ML.Pipeline(stages=ML.feature_stages(["category"], ["base_price"])).fit(ML.model_input(df, ["category"], ["base_price"]))
    new = spark.createDataFrame([("Z", 500.0, 1.0)], "category string, base_price double, revenue double")
    vec = model.transform(new).first().features.toArray()
    assert list(vec[1:]) == [0.0] * (len(vec) - 1)


def test_metrics_hand_computed(spark):
    p = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "revenue double, prediction double")
    m = ML.metrics(p).first()
    assert abs(m.rmse - np.sqrt(2 / 3)) < 1e-12 and abs(m.mae - 2 / 3) < 1e-12
    assert abs(m.r2 - (1 - 2 / 8)) < 1e-12


def test_hash_split_is_stable(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    a, _ = ML.split(df, ["k"])
    b, _ = ML.split(df.repartition(7), ["k"])
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    assert 700 < a.count() < 900


def test_prediction_drift_gate(spark):
    df = orders_df(spark, _model_rows(60))
    assert ML.prediction_drift(df).count() == 0


def test_isolation_forest_finds_planted_points(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(3000), "a": rng.normal(0, 1, 3000), "b": rng.normal(0, 1, 3000)})
    pdf.loc[:9, ["a", "b"]] = [[12.0, -12.0]] * 10   # far cluster
    df = spark.createDataFrame(pdf)
    out = AN.isolation_forest(df, ["a", "b"], ["k"], n_trees=60, contamination=0.005)
    flagged = {r.k for r in out.where("is_anomaly").collect()}
    assert set(range(10)) <= flagged and len(flagged) <= 20


def test_violin_density_matches_exact_kde(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(10, 2, 2000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": x}))
    got = SU.violin_density(df, "g", "v", grid=21, bins=2000).orderBy("x").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    exact = [np.mean(np.exp(-0.5 * ((g - x) / h) ** 2)) / (h * np.sqrt(2 * np.pi)) for g in got.x]
    assert np.allclose(got.density, exact, atol=2e-4)


def test_forecast_recovers_trend(spark):
    months = pd.date_range("2019-01-01", periods=48, freq="MS")
    y = 1000 * np.exp(0.01 * np.arange(48) + 0.1 * np.sin(2 * np.pi * months.month / 12))
    s = spark.createDataFrame(pd.DataFrame({"month": months.date, "value": y}))
    f = TS.forecast(s, periods=12, growth="log_linear").orderBy("month").toPandas()
    assert len(f) == 60 and f.is_forecast.sum() == 12
    fut = pd.date_range("2023-01-01", periods=12, freq="MS")
    exp = 1000 * np.exp(0.01 * np.arange(48, 60) + 0.1 * np.sin(2 * np.pi * fut.month / 12))
    assert np.allclose(f[f.is_forecast].yhat.to_numpy(), exp, rtol=1e-6)
    assert (f.yhat_lower <= f.yhat).all() and (f.yhat <= f.yhat_upper).all()


def test_sarima_recovers_seasonal_series(spark):
    rng = np.random.default_rng(11)
    months = pd.date_range("2015-01-01", periods=96, freq="MS")
    season = 50 * np.sin(2 * np.pi * np.arange(96) / 12)
    y = 1000 + 5 * np.arange(96) + season + rng.normal(0, 2, 96)
    s = spark.createDataFrame(pd.DataFrame({"month": months.date, "value": y}))
    f = TS.seasonal_arima_forecast(s, periods=12).orderBy("month").toPandas()
    assert len(f) == 12
    truth = 1000 + 5 * np.arange(96, 108) + 50 * np.sin(2 * np.pi * np.arange(96, 108) / 12)
    assert np.max(np.abs(f.yhat.to_numpy() - truth)) < 15
    assert (f.yhat_lower < f.yhat).all() and (f.yhat < f.yhat_upper).all()
    short = spark.createDataFrame(pd.DataFrame({"month": months.date[:20], "value": y[:20]}))
    assert TS.seasonal_arima_forecast(short, periods=12).count() == 0


def test_sarima_interpolates_missing_months(spark):
    months = pd.date_range("2015-01-01", periods=60, freq="MS")
    y = 100 + 2.0 * np.arange(60)
    rows = [(m.date(), float(v)) for m, v in zip(months, y)]
    full = spark.createDataFrame(rows, "month date, value double")
    holes = [(m, None if i in (0, 20, 59) else v) for i, (m, v) in enumerate(rows) if i not in (7, 33)]
    got = TS.seasonal_arima_forecast(spark.createDataFrame(holes + [(None, 5.0)], "month date, value double"), periods=6).collect()
    want = TS.seasonal_arima_forecast(full.where("month > '2015-01-01' and month < '2019-12-01'"), periods=6).collect()
    assert [r.month for r in got] == [r.month for r in want]
    assert np.allclose([r.yhat for r in got], [r.yhat for r in want], rtol=1e-6)


def test_null_numbers_leave_the_model_usable(spark):
    rows = _model_rows(300)
    rows[3]["customer_age"] = None
    df = orders_df(spark, rows).withColumn("revenue", F.col("base_price") * 3.0)
    df = df.withColumn("base_price", F.when(F.col("order_id") == "ORD00005", F.lit(float("nan"))).otherwise(F.col("base_price")))
    m = {r.model: r for r in ML.compare_models(df, ["order_id"], names=["Linear Regression", "Decision Tree"]).collect()}
    assert m["Linear Regression"].r2 > 0.999999 and m["Decision Tree"].r2 > 0.8
    model = ML.fit(ML.model_input(df), ML.regressors()["Linear Regression"])
    assert ML.score(model, df).count() == 298


def test_four_families_compared_in_one_table(spark):
    df = orders_df(spark, _model_rows(200)).withColumn("revenue", F.col("base_price") * 3.0)
    got = {r.model: r for r in ML.compare_models(df, ["order_id"], trees=5).collect()}
    assert list(got) == ["Linear Regression", "Decision Tree", "Random Forest", "Boosted Trees"]
    assert len({r.n for r in got.values()}) == 1 and all(r.r2 > 0.5 and r.rmse >= r.mae > 0 for r in got.values())


def test_trees_equal_those_over_one_hot_slots_with_small_rows(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
    from souk.operators import trees as TR
    rng = np.random.default_rng(9)
    rows = [(float(rng.choice([1, 2, 5, 7])), float(rng.normal()), rng.choice(["a", "b", "c", None], p=[.3, .3, .3, .1]), "xy"[i % 2]) for i in range(900)]
    rows = [(*r, 3 * r[0] + 5 * (r[2] == "b") + r[1] * (r[3] == "x") + float(rng.normal(0, .1))) for r in rows]
    df = spark.createDataFrame(rows, "p double, q double, c string, d string, revenue double").repartition(3)
    model = ML.Pipeline(stages=ML.feature_stages(["c", "d"], ["p", "q"])).fit(df)
    enc = model.transform(df).cache()
    lay = TR.layout(enc, ["p", "q"], ["c__idx", "d__idx"], [len(x) for x in model.stages[0].labelsArray], 32, 42)
    assert [len(c) for c in lay.cuts] == [3, 31] and lay.type == np.uint8
    blocks = TR.blocks(enc, lay, "revenue")
    assert all(len(b.bins) == 4 * b.n and len(b.y) == 8 * b.n for b in blocks.collect())    # a byte a column, not four a slot
    got = TR.predict(enc, lay, {"tree": (TR.grow(blocks, lay, [4], [None]), [1.0]), "boosted": TR.boost(blocks, lay, 5, 3, 0.1)})
    got = sorted((r.revenue, r.tree, r.boosted) for r in got.collect())
    tree = DecisionTreeRegressor(labelCol="revenue", maxDepth=4, predictionCol="t").fit(enc)
    both = GBTRegressor(labelCol="revenue", maxIter=5, maxDepth=3, stepSize=0.1, predictionCol="b").fit(enc).transform(tree.transform(enc))
    assert np.allclose(got, sorted((r.revenue, r.t, r.b) for r in both.select("revenue", "t", "b").collect()), atol=1e-9)


def test_forest_rows_weigh_poisson_and_runs_repeat(spark):
    from souk.operators import trees as TR
    assert abs(TR._POISSON.mean() - 1) < 1e-3 and abs(TR._POISSON.var() - 1) < 1e-3
    df = orders_df(spark, _model_rows(300)).withColumn("revenue", F.col("base_price") * 3.0)
    a, b = (ML.compare_models(df, ["order_id"], names=["Random Forest"], trees=3).first() for _ in range(2))
    assert a == b and a.r2 > 0.5


def test_comparison_grows_ensembles_of_all_trees(spark, monkeypatch):
    from souk.plans import more
    df, seen, grown = orders_df(spark, _model_rows(200)).withColumn("revenue", F.col("base_price") * 3.0), [], ML._grown

    def fewer(rows, lay, estimators, seed):
        seen.append([(e.getMaxDepth(), e.getMaxIter() if hasattr(e, "getMaxIter") else e.getNumTrees() if hasattr(e, "getNumTrees") else 1)
                     for e in estimators.values()])
        few = ML.regressors(seed, 2)
        return grown(rows, lay, {k: next(f for f in few.values() if type(f) is type(e)) for k, e in estimators.items()}, seed)

    monkeypatch.setattr(ML, "_grown", fewer)
    monkeypatch.setattr(more, "shared_fact", lambda spark, sf_dir: df)
    monkeypatch.setattr(more.FE, "engineer", lambda rows: rows)
    assert len(more.q_model_comparison(spark, "").collect()) == 4
    assert seen == [[(8, 1), (10, 100), (6, 100)]]


def test_trees_are_the_same_however_their_sums_move(spark, monkeypatch):
    from souk.operators import trees as TR
    rng = np.random.default_rng(4)
    rows = [(float(x), float(rng.integers(3)), float(x * (k % 3) + rng.normal())) for k, x in enumerate(rng.normal(size=600))]
    lay = TR.layout(df := spark.createDataFrame(rows, "p double, c double, revenue double").repartition(3), ["p"], ["c"], [3], 16, 1)
    blocks = TR.blocks(df, lay, "revenue")

    def grown():
        forest, boosted = TR.grow(blocks, lay, [4, 2, 4, 3], [None, 1, 2, 3]), TR.boost(blocks, lay, 6, 3, 0.1)[0]
        return [[x.tolist() for x in (t.feature, t.low, t.span, t.child, t.value)] for t in forest + boosted]

    whole = grown()
    assert len(whole) == 10 and all(len(x[0]) > 1 for x in whole)
    monkeypatch.setattr(TR, "DRIVER_BYTES", 0)               # sums move between tasks
    assert grown() == whole
    monkeypatch.setattr(TR, "LEVEL_BYTES", 16 * int(lay.starts[-1]) * 5)    # of five nodes at a time
    assert list(TR._runs([[0] * 4, [], [0], [0], [0] * 9, []], 5)) == [(0, 3), (3, 4), (4, 6)]
    assert grown() == whole


def test_boosted_trees_leave_no_residuals_behind(spark, tmp_path):
    from pathlib import Path

    from souk.operators import trees as TR
    rows = [(float(k % 7), float(k % 3), float(k % 7 * (k % 3))) for k in range(200)]
    lay = TR.layout(df := spark.createDataFrame(rows, "p double, c double, revenue double"), ["p"], ["c"], [3], 16, 1)
    blocks, kept = TR.blocks(df, lay, "revenue"), Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(kept.iterdir())
    assert len(TR.boost(blocks, lay, 7, 2, 0.1)[0]) == 7
    assert not set(kept.iterdir()) - before and blocks.count() > 0


def test_label_codes(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y"), (None, "x"), ("C", "x")], "u string, v string")
    assert sorted(tuple(r) for r in ML.label_codes(df, ["u", "v"]).collect()) == [
        ("u", "C", 0), ("u", "a", 1), ("u", "b", 2), ("v", "x", 0), ("v", "y", 1)]


def test_padded_forest_equals_a_walk_of_its_nodes(spark):
    rng = np.random.default_rng(2)
    rows, model = rng.normal(size=(500, 3)), []
    for tree in range(4):
        todo, n = [(0, 0)], 1
        while todo:
            node, level = todo.pop()
            if level < 3 and rng.random() < 0.8:
                model.append((tree, node, int(rng.integers(3)), float(rng.normal()), n, n + 1, 10))
                todo += [(n, level + 1), (n + 1, level + 1)]
                n += 2
            else:
                model.append((tree, node, -1, 0.0, -1, -1, int(rng.integers(1, 9))))
    model = pd.DataFrame(model, columns=["tree", "node", "feature", "threshold", "left", "right", "size"]).sort_values(["tree", "node"])
    got = AN._path_lengths(rows, *AN._padded(model, 3), rows=64)
    for x, g in zip(rows[:60], got):
        depths = []
        for _, nodes in model.groupby("tree"):
            at, depth, by = 0, 0, nodes.set_index("node")
            while by.feature[at] >= 0:
                at, depth = int(by.left[at] if x[by.feature[at]] < by.threshold[at] else by.right[at]), depth + 1
            depths.append(depth + float(AN._c_factor([by["size"][at]])[0]))
        assert abs(np.mean(depths) - g) < 1e-12


def test_permutation_importance_linear_shortcut_equals_rescoring(spark):
    rows = _model_rows(300)
    df = orders_df(spark, rows).withColumn("revenue", F.col("base_price") * 3.0 + F.col("customer_age"))
    keyed = df.select("order_id", *ML.CAT_FEATURES, *ML.NUM_FEATURES, "revenue")
    train, test = ML.split(keyed, ["order_id"])
    model = ML.fit(ML.model_input(train), ML.regressors()["Linear Regression"])
    test = test.withColumns({c: F.col(c).cast("double") for c in ML.NUM_FEATURES + ["revenue"]})
    feats = [*ML.CAT_FEATURES, *ML.NUM_FEATURES]
    fast = {r.feature: r.importance_mean for r in
            ML.permutation_importance(model, test, feats, ["order_id"], repeats=3).collect()}
    slow = {r.feature: r.importance_mean for r in
            ML._rescored_permutation_importance(model, test, feats, ["order_id"], 3, 42, "revenue").collect()}
    assert fast.keys() == slow.keys()
    assert all(abs(fast[k] - slow[k]) < 1e-9 for k in fast)
    assert max(fast, key=fast.get) == "base_price"


def test_bgnbd_fit_reaches_truth_likelihood(spark):
    from souk.operators import lifetime as LT
    rng = np.random.default_rng(21)
    r, alpha, a, b = 0.8, 10.0, 0.6, 2.5
    rows = []
    for i in range(3000):
        lam = rng.gamma(r, 1 / alpha)
        p = rng.beta(a, b)
        T_ = float(rng.uniform(20, 60))
        t, x, tx, alive = 0.0, 0, 0.0, True
        while alive:
            t += rng.exponential(1 / lam) if lam > 0 else np.inf
            if t > T_:
                break
            x, tx = x + 1, t
            alive = rng.random() > p
        rows.append((float(x), tx, T_, 1.0))
    cells = spark.createDataFrame(pd.DataFrame(rows, columns=["x", "t_x", "T", "w"]))
    passes = []
    fit = LT.fit(cells, "bgnbd", 0.0, told=passes)
    assert len(passes) <= 20
    arr = np.array(rows)
    ll_fit = LT.bgnbd_loglik(fit, arr[:, 0], arr[:, 1], arr[:, 2]).mean()
    ll_true = LT.bgnbd_loglik([r, alpha, a, b], arr[:, 0], arr[:, 1], arr[:, 2]).mean()
    assert ll_fit >= ll_true - 1e-3
    # expected purchases are positive and grow with the horizon
    e1 = LT.expected_purchases(fit, 10.0, arr[:50, 0], arr[:50, 1], arr[:50, 2])
    e2 = LT.expected_purchases(fit, 20.0, arr[:50, 0], arr[:50, 1], arr[:50, 2])
    assert (e1 > 0).all() and (e2 > e1).all()


def test_gradients_are_those_of_the_likelihoods():
    from souk.operators import lifetime as LT
    rng = np.random.default_rng(3)
    x = np.array([0.0, 1, 2, 7, 30])
    arrays = {"bgnbd": (x, np.where(x > 0, 5.0, 0.0), np.full(5, 9.0)), "gamma_gamma": (x + 1, rng.uniform(5, 90, 5))}
    for name, (of, gradient, _, k) in LT.MODELS.items():
        u = rng.uniform(0.4, 3, k)
        for i, e in enumerate(np.eye(k) * 1e-5):
            numeric = (of(u + e, *arrays[name]) - of(u - e, *arrays[name])) / 2e-5
            assert np.allclose(gradient(u, *arrays[name])[i], numeric, rtol=1e-5, atol=1e-6), (name, i)


def test_gamma_gamma_fit_and_binned_spend(spark):
    from souk.operators import lifetime as LT
    rng = np.random.default_rng(8)
    p, q, v = 4.0, 3.0, 20.0
    x = rng.integers(1, 12, 4000).astype(float)
    m = rng.gamma(p * x, 1 / (rng.gamma(q, 1 / v, 4000) * x))
    cust = spark.createDataFrame(pd.DataFrame({"x": x, "m": m}))
    cells = LT.spend_cells(cust)
    passes = []
    got = LT.fit(cells, "gamma_gamma", 0.0, told=passes)
    own = lambda prm: LT.gamma_gamma_loglik(prm, x, m).mean()
    assert own(got) >= own([p, q, v]) - 1e-6 and len(passes) <= 20
    told = LT.loglik(cells, "gamma_gamma", got).first()
    assert told.customers == 4000 and abs(told.loglik / 4000 - own(got)) < 1e-5


def test_bgnbd_clv_without_a_customer_column(spark):
    from souk.operators import lifetime as LT
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        for k in range(int(rng.integers(1, 6))):
            rows.append(order(len(rows), d(2023, 1 + int(rng.integers(0, 12)), 1 + int(rng.integers(0, 28))),
                              state=f"S{c % 10}", age=20 + c // 10, base=50.0 + c))
    out = LT.bgnbd_clv(orders_df(spark, rows)).toPandas()
    assert len(out) == 40 and out.customer_id.str.count("_").eq(2).all()
    assert out.clv.notna().all() and (out.clv >= 0).all()


def test_isolation_forest_writes_only_the_columns_kept(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"g{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "k int, g string, a double, b double")
    some = AN.isolation_forest(df, ["a", "b"], ["k"], n_trees=20, contamination=0.05, keep=["g"])
    every = AN.isolation_forest(df, ["a", "b"], ["k"], n_trees=20, contamination=0.05)
    assert some.columns == ["g", "iso_score", "is_anomaly", "iso_label"] and every.columns[:4] == df.columns
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(some.columns).collect()))

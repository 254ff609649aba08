"""No observation is dropped by size, first line, value or projection."""

import json

import numpy as np
import pandas as pd
import pytest

from souk.operators import anomaly as AN
from souk.operators import timeseries as TS
from souk.sources import landed, orders
from souk.sources import sinks as SK


def _series(spark, y, start="2019-01-01"):
    months = pd.date_range(start, periods=len(y), freq="MS")
    return spark.createDataFrame(pd.DataFrame({"month": months.date, "value": np.asarray(y, float)}))


def test_sarima_forecasts_from_two_seasons_on(spark):
    rng = np.random.default_rng(3)
    y = 1000 + 5 * np.arange(60) + 50 * np.sin(2 * np.pi * np.arange(60) / 12) + rng.normal(0, 1, 60)
    for n in (24, 36, 38, 40, 43, 44, 60):
        f = TS.seasonal_arima_forecast(_series(spark, y[:n]), periods=12).orderBy("month").toPandas()
        assert len(f) == 12
        truth = 1000 + 5 * np.arange(n, n + 12) + 50 * np.sin(2 * np.pi * np.arange(n, n + 12) / 12)
        if n >= 36:
            assert np.max(np.abs(f.yhat.to_numpy() - truth)) < 25


def test_forecast_counts_zero_and_negative_months(spark):
    y = [10.0 + 0.5 * i for i in range(30)] + [0.0] * 5 + [-1.0]
    f = TS.forecast(_series(spark, y), periods=12, growth="piecewise").orderBy("month").toPandas()
    assert len(f) == 48 and str(f[f.is_forecast].month.iloc[0]) == "2022-01-01"
    assert f.yhat[30:36].mean() < 12        # the zero months pull the fit down
    with pytest.raises(Exception, match="piecewise"):
        TS.forecast(_series(spark, y), periods=12, growth="log_linear").collect()


def test_piecewise_forecast_follows_a_bend_and_the_season(spark):
    t = np.arange(60)
    trend = 100 + 2.0 * t + np.where(t > 24, 3.0 * (t - 24), 0)
    y = trend * (1 + 0.2 * np.sin(2 * np.pi * (t % 12 + 1) / 12))
    f = TS.forecast(_series(spark, y), periods=6, growth="piecewise", ridge=1e-4).orderBy("month").toPandas()
    assert np.max(np.abs(f.yhat[:60] / y - 1)) < 0.03


def test_json_files_are_told_apart_one_by_one(spark, tmp_path):
    rec = lambda i: {"order_id": f"O{i}", "revenue": 1.0 * i}
    (tmp_path / "a.json").write_text(json.dumps([rec(i) for i in range(50)], indent=1))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(rec(i)) for i in range(50, 53)))
    (tmp_path / "c.json").write_text("\n\n  " + json.dumps([rec(i) for i in range(53, 60)], indent=1))
    (tmp_path / "d.json").write_text(json.dumps([rec(i) for i in range(60, 70)]))
    got = orders.read_json(spark, str(tmp_path)).collect()
    assert sorted(int(r["order_id"][1:]) for r in got) == list(range(70))


def test_report_holds_every_row(spark, tmp_path):
    one = spark.range(1)
    SK.export_report(str(tmp_path / "r"), one, one, one, spark.range(50_100), one)
    assert spark.read.parquet(str(tmp_path / "r/data")).count() == 50_100


def test_every_tree_gets_its_rows_on_a_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (500, 2)))]
    rows[7] = (7, 9.0, -9.0)
    df = spark.createDataFrame(rows, "k int, a double, b double")
    out = AN.isolation_forest(df, ["a", "b"], ["k"]).toPandas().set_index("k")
    assert out.iso_score.idxmax() == 7 and out.iso_score.median() < 0.55 and out.iso_score[7] > 0.7


def test_first_batch_of_a_trend_counts(spark):
    a = spark.createDataFrame([("2024-01-01", "x", 1.0)], "date string, keyword string, interest double")
    b = spark.createDataFrame([("2024-01-01", "x", 9.0), ("2024-01-02", "x", 2.0)], "date string, keyword string, interest double")
    got = {(r["date"], r["interest"]) for r in landed.union_trend_batches(a, b).collect()}
    assert got == {("2024-01-01", 1.0), ("2024-01-02", 2.0)}


def test_arrays_of_orders_are_bounded(spark, tmp_path, monkeypatch):
    import gzip

    from souk.plans import more

    monkeypatch.setattr(more, "ARRAY_ROWS", 10)
    raw = spark.createDataFrame([(f"o{i}", 1.0 * i, 2.0 * i) for i in range(1000)] + [("o1", 1.0, 2.0)], "order_id string, base_price double, final_price double")
    more._write_arrays(raw, str(tmp_path / "a.json"))
    files = list((tmp_path / "a.json").rglob("*.gz"))
    sizes = [len(json.loads(gzip.decompress(f.read_bytes()))) for f in files]
    assert len(sizes) > 64 and max(sizes) < 40 and sum(sizes) == 1001
    got = orders.read_json(spark, str(tmp_path / "a.json"), "order_id string, base_price double, final_price double")
    assert sorted(map(tuple, got.select(*raw.columns).collect())) == sorted(map(tuple, raw.collect()))


def test_json_files_are_told_without_sorting_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n  \n \ufeff [\n{}\n]\n")
    (tmp_path / "b.json").write_text("\n\n{}\n[\n")
    (tmp_path / "c.json").write_text("\n \n")
    plans = []
    real = type(spark.range(0)).collect
    type(spark.range(0)).collect = lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1]
    try:
        arrays, lines = orders._json_files(spark, str(tmp_path))
    finally:
        type(spark.range(0)).collect = real
    assert [a[-6:] for a in arrays] == ["a.json"] and sorted(x[-6:] for x in lines) == ["b.json", "c.json"]
    assert plans and plans[0].count("Aggregate [") == 2          # lines by whole numbers, then one row per split

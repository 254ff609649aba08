import json

from pyspark.sql import functions as F

from order_rows import d, order, orders_df
from souk.operators import enrich as EN
from souk.operators import insights as IN
from souk.sources import landed as LD
from souk.sources import sinks as SK


def test_macro_payload_and_full_outer(spark, tmp_path):
    (tmp_path / "gdp.json").write_text(json.dumps(
        [{"page": 1}, [{"date": "2023", "value": 7.6}, {"date": "2022", "value": None},
                       {"date": "2021", "value": 9.1}]]))
    (tmp_path / "cpi.json").write_text(json.dumps([{"page": 1}, [{"date": "2022", "value": 6.7}]]))
    gdp = LD.read_macro_payloads(spark, str(tmp_path / "gdp.json"))
    cpi = LD.read_macro_payloads(spark, str(tmp_path / "cpi.json"))
    assert sorted((r.year, r.value, r.indicator) for r in gdp.collect()) == [(2021, 9.1, "gdp"), (2023, 7.6, "gdp")]
    m = {r.year: (r.india_gdp_growth_pct, r.india_cpi_inflation_pct) for r in LD.macro_table(gdp, cpi).collect()}
    assert m == {2021: (9.1, None), 2022: (None, 6.7), 2023: (7.6, None)}
    orders = orders_df(spark, [order(0, d(2022, 5, 1)), order(1, d(2020, 5, 1))])
    e = {r.year: r.india_cpi_inflation_pct for r in EN.with_macro(orders, LD.macro_table(gdp, cpi)).collect()}
    assert e == {2022: 6.7, 2020: None}


def test_fx_selection(spark):
    snaps = spark.createDataFrame([
        ("fawazahmed0", 1, json.dumps({"usd": {"inr": 12.0}})),      # invalid (< 50)
        ("frankfurter", 2, json.dumps({"rates": {"INR": 83.5}})),
        ("open.er-api", 3, json.dumps({"rates": {"INR": 84.2}}))], "source string, priority int, payload string")
    assert LD.fx_rate(snaps).first().usd_inr_rate == 83.5
    empty = snaps.where("priority = 1")
    assert LD.fx_rate(empty).first().usd_inr_rate == 84.0
    o = EN.with_fx(orders_df(spark, [order(0, d(2022, 1, 1), base=100.0, disc=0.0, units=3)]), LD.fx_rate(snaps))
    r = o.first()
    assert r.revenue_usd == round(300.0 / 83.5, 2)


def test_trends_enrichment_keeps_row_count(spark, tmp_path):
    p = tmp_path / "trends.csv"
    p.write_text("date,a,b,isPartial\n2022-01-02,10,20,False\n2022-01-09,30,,False\n2022-02-06,50,50,True\n")
    wide = LD.read_trends(spark, str(p))
    assert "isPartial" not in wide.columns
    long = LD.trends_long(wide)
    orders = orders_df(spark, [order(i, d(2022, 1, 1 + i)) for i in range(5)] + [order(9, d(2022, 3, 1))])
    out = EN.with_trends(orders, long)
    assert out.count() == 6
    v = {r.year_month: r.ecommerce_search_interest for r in out.select("year_month", "ecommerce_search_interest").distinct().collect()}
    assert v == {"2022-01": (15.0 + 30.0) / 2, "2022-03": None}
    u = LD.union_trend_batches(long, long)
    assert u.count() == long.count()


def test_state_codes(spark):
    orders = orders_df(spark, [order(0, d(2022, 1, 1), state="Delhi NCR"), order(1, d(2022, 1, 1), state="Atlantis")])
    m = EN.state_revenue_map(orders).collect()
    assert [(r.state, r.iso_code) for r in m] == [("Delhi NCR", "IN-DL")]


def test_sinks_conform_and_append(spark, tmp_path):
    recs = spark.createDataFrame([("A", 10.0, 8.0, "decrease", 1.0)],
                                 "category string, current_discount double, optimal_discount double, "
                                 "direction string, revenue_impact_pct double")
    SK.save_price_recommendations(recs, str(tmp_path / "recs"))
    SK.save_price_recommendations(recs, str(tmp_path / "recs"))
    back = spark.read.parquet(str(tmp_path / "recs"))
    assert back.count() == 2 and "created_at" in back.columns and "run_date" in back.columns
    SK.export_csv(recs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def _summary_rows(n=40):
    rows = []
    for i in range(n):
        rows.append(order(i, d(2022, 1 + i % 4, 1 + i % 20), category=["A", "B"][i % 2],
                          zone=["North", "South", "East"][i % 3], state=["S1", "S2"][i % 2],
                          disc=40.0, event="Festival" if i % 4 == 3 else "Normal",
                          brand="Premium" if i % 5 == 0 else "Mass", comp="High" if i % 2 else "Low",
                          pressure="High" if i % 3 == 0 else "Low", units=1 + i))
    return rows


def test_narrative_rules(spark):
    df = orders_df(spark, _summary_rows())
    n = IN.narrative(df).collect()
    sections = {(r.section, r.seq) for r in n}
    assert ("headline", 0) in sections and ("risk", 1) in sections      # avg discount 40 > 35
    assert ("opportunity", 1) in sections                                # > 25
    texts = [r.text for r in n if r.section == "risk"]
    assert any("40.0%" in t for t in texts)
    k = IN.summary_kpis(df).first()
    assert k.orders == 40 and k.top_category in ("A", "B")


def test_recommendations_priority_order(spark):
    rows = _summary_rows(80)   # 40 rows per category (>= 30)
    # make category A discount-responsive (units rise with discount)
    for i, r in enumerate(rows):
        if r["category"] == "A":
            r["discount_percent"] = 31.0 + i
            r["units_sold"] = 2 * i + 1
    df = orders_df(spark, rows)
    recs = IN.recommendations(df).collect()
    pr = [r.priority for r in recs]
    assert pr == sorted(pr, key=["High", "Medium", "Low"].index)
    assert recs[0].category == "Pricing" and "A" in recs[0].action
    assert recs[-1].category == "Retention"
    el = IN.elastic_categories(df).collect()
    assert [r.category for r in el] == ["A"]


def test_alert_drift_and_report_sinks(spark, tmp_path):
    from souk.operators import customers as CU
    from souk.operators import drift as DR
    rows = _summary_rows(60)
    for i, r in enumerate(rows):
        r["customer_id"] = f"c{i % 12}"
    df = orders_df(spark, rows)
    alerts = CU.at_risk_alerts(df, top_n=5, min_score=0)
    SK.save_at_risk_alerts(alerts, str(tmp_path / "alerts"))
    back = spark.read.parquet(str(tmp_path / "alerts"))
    assert set(back.columns) >= {"customer_id", "churn_risk_score", "days_since_order", "recommended_action",
                                 "created_at", "run_date"}
    assert back.count() == alerts.count()
    rep = DR.drift_report(DR.feature_drift(df), pred_r2_drop=0.1, pred_alert=True)
    SK.save_drift_report(rep, str(tmp_path / "drift"))
    d = spark.read.parquet(str(tmp_path / "drift")).first()
    assert d.drift_alert is True and abs(d.pred_r2_drop - 0.1) < 1e-12
    k = IN.summary_kpis(df)
    SK.export_report(str(tmp_path / "report"), k, IN.narrative(df), IN.recommendations(df), df,
                     IN.SU.monthly_revenue(df), data_cap=10)
    assert spark.read.parquet(str(tmp_path / "report/data")).count() == 10
    assert spark.read.parquet(str(tmp_path / "report/kpis")).count() == 1


def test_kpi_texts(spark):
    df = orders_df(spark, _summary_rows())
    t = IN.kpi_texts(IN.summary_kpis(df)).first().asDict()
    assert t["Total Orders"] == "40" and t["Avg Discount"] == "40.0%"
    assert t["Top Category"] in ("A", "B") and t["MoM Growth"].endswith("%")

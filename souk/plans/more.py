"""Registered queries over readers, cleaning, enrichment joins, filters, pivots
and sinks (imported at the end of ``catalog``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from souk import texts
from souk.operators import anomaly as AN
from souk.operators import customers as CU
from souk.operators import density as DE
from souk.operators import drift as DR
from souk.operators import enrich as EN
from souk.operators import features as FE
from souk.operators import insights as IN
from souk.operators import inventory as IV
from souk.operators import lifetime as LT
from souk.operators import ml as ML
from souk.operators import ordered as OR
from souk.operators import pricing as PR
from souk.operators import summary as SU
from souk.operators import timeseries as TS
from souk.plans.catalog import (_COHORT_SQL, _DRIFT_SQL, NPR, ORACLE, QUERIES, R, W, _box_sql, _elast_sql, _hist_sql, fact, register,
                                rounded)
from souk.schema import (AT_RISK_ALERT_SCHEMA, DRIFT_FEATURES, DRIFT_REPORT_SCHEMA, PRICE_RECOMMENDATION_SCHEMA,
                         RAW_ORDER_SCHEMA)
from souk.session import ensure_checkpoint_dir
from souk.sources import landed, orders, sinks
from souk.sources.star import FACT_SQL, shared_fact, table


def _shared(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- FL1, FL8, SC9, PJ11, PJ16
@register("filtered_segments", W(f"""
SELECT zone, brand_type, count(*) AS orders, {R('sum(revenue)', 4)} AS revenue FROM feat
WHERE zone IN ('ASIA', 'EUROPE') AND brand_type IN ('Premium') GROUP BY zone, brand_type"""))
def q_filtered_segments(spark, sf_dir):
    """Orders and revenue under a set-membership filter on two dimensions (FL1)."""
    df = FE.filter_segments(fact(spark, sf_dir, ["zone", "brand_type", "category", "revenue"]),
                            zone=["ASIA", "EUROPE"], brand_type=["Premium"], category=None)
    return rounded(df.groupBy("zone", "brand_type").agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue")), 4)


@register("filter_options", W("SELECT DISTINCT category FROM feat WHERE category IS NOT NULL"))
def q_filter_options(spark, sf_dir):
    """Distinct values offered by a dimension's filter (FL8)."""
    return FE.distinct_values(fact(spark, sf_dir, ["category"]), "category")


@register("row_count", W("SELECT count(*) AS rows FROM feat"))
def q_row_count(spark, sf_dir):
    """Row-count probe of the fact (SC9)."""
    return orders.row_count(shared_fact(spark, sf_dir))


@register("available_columns", W(f"SELECT order_id, {R('revenue', 4)} AS revenue, zone FROM feat"))
def q_available_columns(spark, sf_dir):
    """Wanted columns that exist, in the wanted order (PJ11)."""
    df = fact(spark, sf_dir, ["order_id", "zone", "revenue", "units_sold"])
    return rounded(FE.keep_available(df, ["order_id", "revenue", "rating", "zone"]), 4)


@register("scatter_discount_units", W(f"""
SELECT {R('discount_percent', 6)} AS discount_percent, units_sold, sales_event, category FROM feat
WHERE discount_percent IS NOT NULL AND units_sold IS NOT NULL"""))
def q_scatter_discount_units(spark, sf_dir):
    """Rows of a discount / units scatter with colour and hover columns (PJ16)."""
    df = fact(spark, sf_dir, ["discount_percent", "units_sold", "sales_event", "category"])
    return rounded(FE.scatter_rows(df, "discount_percent", "units_sold", "sales_event", ("category", "brand_name")), 6)


# ---------------------------------------------------------------- PJ1-PJ3, PJ9
@register("cleaned_orders", W(f"""
SELECT order_id, CASE WHEN units_sold % 7 <> 0 THEN strftime(order_date, '%Y-%m-%d') END AS order_day,
       CASE WHEN units_sold % 5 <> 0 THEN {R('least(greatest(discount_percent * 15 - 20, 0), 100)', 6)} END AS discount_percent,
       zone, category FROM feat"""))
def q_cleaned_orders(spark, sf_dir):
    """Padded text, unreadable dates and out-of-range discounts made from the fact, then cleaned (PJ1-PJ3)."""
    raw = shared_fact(spark, sf_dir, ["order_id", "order_date", "discount_percent", "zone", "category", "units_sold"])
    date = F.concat(F.lit("  "), F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"), F.lit(" "))
    raw = raw.select(
        F.concat(F.lit("\t"), "order_id").alias("order_id"),
        F.when(F.col("units_sold") % 7 == 0, F.lit("31/31/2020")).otherwise(date).alias("order_date"),
        F.when(F.col("units_sold") % 5 != 0, F.col("discount_percent") * 15 - 20).alias("discount_percent"),
        F.concat(F.lit(" "), "zone", F.lit("  ")).alias("zone"), F.concat("category", F.lit("\n")).alias("category"))
    out = FE.clean(raw)
    return rounded(out.select("order_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_day"),
                              "discount_percent", "zone", "category"), 6)


_SYNTHETIC = "state || '_' || customer_gender || '_' || CAST(customer_age AS VARCHAR)"


@register("synthetic_customer_rfm", W(f"""
SELECT customer_id, CAST(date_diff('day', max(order_date), snap) AS INTEGER) AS recency, count(order_date) AS frequency,
       {R('avg(revenue)', 6)} AS monetary
FROM (SELECT {_SYNTHETIC} AS customer_id, order_date, revenue,
             (SELECT max(order_date) + INTERVAL 1 DAY FROM feat) AS snap FROM feat) t GROUP BY customer_id, snap"""))
def q_synthetic_customer_rfm(spark, sf_dir):
    """Recency, frequency and monetary value per synthesised customer key (PJ9, CU1)."""
    df = shared_fact(spark, sf_dir, ["state", "customer_gender", "customer_age", "order_date", "revenue"])
    return rounded(CU.rfm(df).select("customer_id", "recency", "frequency", "monetary"), 6)


# ---------------------------------------------------------------- SC7, PJ10
@register("usd_orders", W(f"""
SELECT order_id, {R(NPR('revenue / 83.25', 2), 2)} AS revenue_usd, {R(NPR('final_price / 83.25', 4), 4)} AS final_price_usd
FROM feat"""))
def q_usd_orders(spark, sf_dir):
    """Order values in USD at the first valid landed rate (SC7, PJ10)."""
    snapshots = spark.createDataFrame(
        [("frankfurter", 1, '{"rates": {"INR": 83.25}}'), ("fawazahmed0", 0, '{"usd": {"inr": 0.9}}'),
         ("open.er-api", 2, "not json")], "source string, priority int, payload string")
    df = EN.with_fx(fact(spark, sf_dir, ["order_id", "revenue", "final_price"]), landed.fx_rate(snapshots))
    return rounded(df.select("order_id", "revenue_usd", "final_price_usd"), 4, {"revenue_usd": 2})


# ---------------------------------------------------------------- SC8, PJ12, PJ13, JN3, JN6
_TRENDS_SQL = """
daily AS (SELECT CAST(ts AS DATE) - INTERVAL 30 YEAR AS date, event_type AS keyword, count(*) AS interest
          FROM events GROUP BY 1, 2),
per_date AS (SELECT date, avg(interest) AS i FROM daily GROUP BY date),
per_month AS (SELECT strftime(date, '%Y-%m') AS year_month, avg(i) AS interest FROM per_date GROUP BY 1)"""


def _trends(spark, sf_dir):
    """Daily event counts, one column per event type, in two batches that overlap."""
    ev = table(spark, sf_dir, "events")
    day = F.add_months(F.to_date("ts"), -360).alias("date")
    batch = lambda kinds: landed.trends_long(ev.where(F.col("event_type").isin(kinds))
                                             .groupBy(day).pivot("event_type", kinds).agg(F.count(F.lit(1))))
    return landed.union_trend_batches(batch(["click", "view", "error"]), batch(["error", "purchase", "signup"])) \
        .where(F.col("interest").isNotNull())


@register("trend_interest_by_day", W("""
SELECT strftime(date, '%Y-%m-%d') AS day, keyword, CAST(interest AS DOUBLE) AS interest FROM daily
WHERE keyword IN ('click', 'view', 'error', 'purchase', 'signup')""", extra=_TRENDS_SQL))
def q_trend_interest_by_day(spark, sf_dir):
    """Wide trend batches, melted and united on date and keyword (PJ12, JN6)."""
    return _trends(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "keyword", "interest")


@register("orders_with_search_interest", W(f"""
SELECT f.year_month, count(*) AS orders, {R('max(m.interest)', 6)} AS interest
FROM feat f LEFT JOIN (
  SELECT strftime(date, '%Y-%m') AS year_month, avg(i) AS interest FROM (
    SELECT date, avg(interest) AS i FROM daily WHERE keyword IN ('click', 'view', 'error', 'purchase', 'signup') GROUP BY date)
  GROUP BY 1) m ON f.year_month = m.year_month
GROUP BY f.year_month""", extra=_TRENDS_SQL))
def q_orders_with_search_interest(spark, sf_dir):
    """Monthly search interest joined to the orders, none of which is repeated (PJ13, JN3)."""
    df = EN.with_trends(fact(spark, sf_dir, ["order_date"]), _trends(spark, sf_dir))
    return rounded(df.groupBy("year_month").agg(F.count(F.lit(1)).alias("orders"),
                                                F.max("ecommerce_search_interest").alias("interest")), 6)


# ---------------------------------------------------------------- SC6, JN1, JN2
_MACRO_SQL = f"""
gdp AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {R('avg(o_totalprice)', 2)} AS v FROM orders
        WHERE year(o_orderdate) % 3 <> 0 GROUP BY 1),
cpi AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS v FROM orders
        WHERE year(o_orderdate) % 2 = 0 GROUP BY 1),
macro AS (SELECT coalesce(g.year, c.year) AS year, g.v AS gdp, c.v AS cpi FROM gdp g FULL JOIN cpi c ON g.year = c.year)"""


def _macro(spark, sf_dir):
    """Two yearly series landed as JSON payloads and read back."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    gdp = rounded(o.where("year % 3 <> 0").groupBy("year").agg(F.avg("o_totalprice").alias("v")), 2)
    cpi = o.where("year % 2 = 0").groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("v"))
    out = []
    for name, series in (("gdp", gdp), ("cpi", cpi)):
        rec = F.collect_list(F.struct(F.col("year").cast("string").alias("date"), F.col("v").alias("value")))
        path = _shared(spark, f"macro-{name}")
        series.agg(F.concat(F.lit('[{"page": 1}, '), F.to_json(rec), F.lit("]")).alias("value")).coalesce(1).write.text(path)
        out.append(landed.read_macro_payloads(spark, path, name))
    return landed.macro_table(*out)


@register("macro_table", W(f"""
SELECT year, {R('gdp', 2)} AS india_gdp_growth_pct, {R('cpi', 2)} AS india_cpi_inflation_pct FROM macro""", extra=_MACRO_SQL))
def q_macro_table(spark, sf_dir):
    """Two landed yearly indicators in a full outer join (SC6, JN1)."""
    return rounded(_macro(spark, sf_dir), 2)


@register("orders_with_macro", W(f"""
SELECT f.year, count(*) AS orders, {R('max(gdp)', 2)} AS gdp, {R('max(cpi)', 2)} AS cpi
FROM feat f LEFT JOIN macro m ON f.year = m.year GROUP BY f.year""", extra=_MACRO_SQL))
def q_orders_with_macro(spark, sf_dir):
    """Yearly indicators joined to the orders (JN2)."""
    df = EN.with_macro(fact(spark, sf_dir, ["order_date"]), _macro(spark, sf_dir))
    return rounded(df.groupBy("year").agg(F.count(F.lit(1)).alias("orders"), F.max("india_gdp_growth_pct").alias("gdp"),
                                          F.max("india_cpi_inflation_pct").alias("cpi")), 2)


# ---------------------------------------------------------------- PJ15
@register("state_revenue_map", W(f"""
SELECT state, {R('sum(revenue)', 4)} AS revenue, 'N-' || substr(state, 1, 3) AS iso_code FROM feat
WHERE substr(state, 1, 1) < 'S' GROUP BY state ORDER BY sum(revenue) DESC, state LIMIT 10"""))
def q_state_revenue_map(spark, sf_dir):
    """Revenue of the ten largest mapped states with their codes; unmapped states drop out (PJ15)."""
    nations = table(spark, sf_dir, "nation").where(F.substring("n_name", 1, 1) < "S")
    codes = nations.select(F.col("n_name").alias("state"), F.concat(F.lit("N-"), F.substring("n_name", 1, 3)).alias("iso_code"))
    return rounded(EN.state_revenue_map(fact(spark, sf_dir, ["state", "revenue"]), 10, codes), 4)


# ---------------------------------------------------------------- WN6
@register("latest_month_delta", W(f"""
SELECT year_month, {R('revenue', 4)} AS revenue, {R('revenue - previous', 4)} AS delta
FROM (SELECT year_month, revenue, lag(revenue) OVER (ORDER BY year_month) AS previous
      FROM (SELECT year_month, sum(revenue) AS revenue FROM feat WHERE year_month IS NOT NULL GROUP BY 1))
ORDER BY year_month DESC LIMIT 1"""))
def q_latest_month_delta(spark, sf_dir):
    """Revenue of the last month and its change (WN6)."""
    m = SU.monthly_revenue(fact(spark, sf_dir, ["order_date", "revenue"])).withColumnRenamed("revenue_sum", "revenue")
    return rounded(OR.latest_delta(m, "year_month", "revenue"), 4)


# ---------------------------------------------------------------- PR2
@register("elasticity_classes", f"""
SELECT category, elasticity, r2, n_obs,
       CASE WHEN elasticity < -1 THEN '{texts.ELASTICITY_CLASSES["elastic"]}' WHEN elasticity < 0 THEN '{texts.ELASTICITY_CLASSES["inelastic"]}'
            ELSE '{texts.ELASTICITY_CLASSES["giffen"]}' END AS elasticity_type,
       CASE WHEN elasticity < -1 THEN '{texts.DISCOUNT_ADVICE["elastic"]}'
            WHEN elasticity < 0 THEN '{texts.DISCOUNT_ADVICE["inelastic"]}'
            ELSE '{texts.DISCOUNT_ADVICE["giffen"]}' END AS advice
FROM ({W(_elast_sql(["category"], 20, True))}) e""")
def q_elasticity_classes(spark, sf_dir):
    """Elasticity class and pricing advice per category (PR2)."""
    df = fact(spark, sf_dir, ["category", "final_price", "units_sold"])
    return PR.with_classes(PR.elasticity(df, ["category"], min_obs=20, precheck=True))


# ---------------------------------------------------------------- AG14, CU7 wide forms
_REGIONS = {"AFRICA": "africa", "AMERICA": "america", "ASIA": "asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east"}


@register("units_matrix_wide", W("SELECT category, " + ", ".join(
    R(f"(round_even((avg(CASE WHEN zone = '{k}' THEN units_sold END)) * 10.0, 0) / 10.0)", 1) + f" AS {v}" for k, v in _REGIONS.items())
    + " FROM feat WHERE category IS NOT NULL GROUP BY category"))
def q_units_matrix_wide(spark, sf_dir):
    """Mean units per category, one column per zone (AG14)."""
    df = SU.mean_matrix(fact(spark, sf_dir, ["category", "zone", "units_sold"]), pivot_values=list(_REGIONS))
    return rounded(df.withColumnsRenamed(_REGIONS), 1)


_PERIODS = [0, 1, 2, 3, 6, 12, 24]


@register("cohort_matrix", W("SELECT cohort_month, " + ", ".join(
    R(f"max(CASE WHEN cohort_period = {p} THEN revenue END)", 4) + f" AS m{p}" for p in _PERIODS)
    + " FROM coh GROUP BY cohort_month", extra=_COHORT_SQL))
def q_cohort_matrix(spark, sf_dir):
    """Cohort revenue, one column per period (CU7)."""
    t = CU.cohort_table(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"]))
    return rounded(CU.cohort_pivot(t, "revenue", _PERIODS).withColumnsRenamed({str(p): f"m{p}" for p in _PERIODS}), 4)


# ---------------------------------------------------------------- AG7, AG8
@register("price_histograms", W(_hist_sql(["base_price", "final_price"], 60)))
def q_price_histograms(spark, sf_dir):
    """60-bin histograms of base and final price (AG7)."""
    return rounded(SU.histogram(fact(spark, sf_dir, ["base_price", "final_price"]), ["base_price", "final_price"], 60), 6)


@register("box_final_price_by_competition_intensity", W(_box_sql("competition_intensity", "final_price")))
def q_box_final_price_by_competition(spark, sf_dir):
    """Box statistics of final price by competition level (AG8)."""
    df = fact(spark, sf_dir, ["competition_intensity", "final_price"])
    return rounded(SU.box_stats(df, "competition_intensity", "final_price"), 9)


@register("box_units_by_brand_event", W(_box_sql("brand_event", "units_sold").replace(
    "FROM feat", "FROM (SELECT *, brand_type || ' / ' || sales_event AS brand_event FROM feat)")))
def q_box_units_by_brand_event(spark, sf_dir):
    """Box statistics of units by brand type and sales event (AG8, PJ14)."""
    df = fact(spark, sf_dir, ["brand_type", "sales_event", "units_sold"])
    df = df.select(FE.group_label("brand_type", "sales_event").alias("brand_event"), F.col("units_sold").cast("double"))
    return rounded(SU.box_stats(df, "brand_event", "units_sold"), 9)


# ---------------------------------------------------------------- SC1-SC5, SK4, SK6
_READ_SQL = W(f"""
SELECT year_month, count(*) AS orders, {R('sum(revenue)', 4)} AS revenue, {R('sum(discount_percent)', 2)} AS discount,
       CAST(sum(units_sold) AS BIGINT) AS units, count(DISTINCT category) AS categories
FROM feat GROUP BY year_month""")


def _round_trip(fmt: str, write):
    @register(f"orders_from_{fmt}", _READ_SQL)
    def q(spark, sf_dir):
        cols = [f.name for f in RAW_ORDER_SCHEMA.fields]
        raw = shared_fact(spark, sf_dir).select(*[
            F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "order_date" else F.col(c) for c in cols])
        path = f"{_shared(spark, 'orders')}.{fmt}"
        write(raw, path)
        df = FE.prepare(orders.load_orders(spark, path))
        return rounded(df.groupBy("year_month").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"), F.sum("discount_percent").alias("discount"),
            F.sum("units_sold").alias("units"), F.countDistinct("category").alias("categories")), 4, {"discount": 2})
    q.__doc__ = f"Orders exported as {fmt}, read back by suffix, cleaned and summed per month (SC1-SC5, SK4, SK6)."


# text of all orders is several times the fact: the files are gzipped
_round_trip("csv", lambda df, path: sinks.export_csv(df, path, "gzip"))
_round_trip("tsv", lambda df, path: df.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path))
_round_trip("json", lambda df, path: sinks.export_json(df, path, "gzip"))
_round_trip("parquet", lambda df, path: df.write.parquet(path))


# ---------------------------------------------------------------- SK1, SK3
@register("stored_price_recommendations", f"""
SELECT category, current_discount, optimal_discount, direction, revenue_impact_pct
FROM ({ORACLE["price_recommendations"]}) r""")
def q_stored_price_recommendations(spark, sf_dir):
    """Price recommendations appended to their table and read back (SK1)."""
    path = _shared(spark, "price-recommendations")
    sinks.save_price_recommendations(QUERIES["price_recommendations"](spark, sf_dir), path)
    return spark.read.schema(PRICE_RECOMMENDATION_SCHEMA).parquet(path).drop("created_at", "run_date")


@register("stored_at_risk_alerts", f"""
SELECT customer_id, churn_risk_score, risk_label, value_tier, CAST(days_since_last_order AS INTEGER) AS days_since_order,
       total_revenue, recommended_action FROM ({ORACLE["at_risk_alerts"]}) r""")
def q_stored_at_risk_alerts(spark, sf_dir):
    """At-risk alerts appended to their table and read back (SK3)."""
    path = _shared(spark, "at-risk-alerts")
    sinks.save_at_risk_alerts(QUERIES["at_risk_alerts"](spark, sf_dir), path)
    return spark.read.schema(AT_RISK_ALERT_SCHEMA).parquet(path).drop("created_at", "run_date")


# ---------------------------------------------------------------- AN4
_POINT_SQL = f"""
point AS (SELECT customer_id, {R('count(*) / 8.0', 6)} AS x, {R('avg(revenue) / 10000', 6)} AS y, {R('avg(discount_percent)', 6)} AS z
          FROM feat WHERE customer_id IS NOT NULL GROUP BY customer_id),
near AS (SELECT p.customer_id AS a, q.customer_id AS b FROM point p JOIN point q
           ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 0.25),
flagged AS (SELECT a AS customer_id, count(*) >= 10 AS core FROM near GROUP BY a)"""


def _customer_points(spark, sf_dir):
    df = fact(spark, sf_dir, ["customer_id", "revenue", "discount_percent"])
    return rounded(df.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        (F.count(F.lit(1)) / 8.0).alias("x"), (F.avg("revenue") / 10000).alias("y"), F.avg("discount_percent").alias("z")), 6)


@register("dbscan_customers", W("""
SELECT customer_id, core AS dbscan_core, NOT (core OR EXISTS (
         SELECT 1 FROM near n JOIN flagged o ON o.customer_id = n.b WHERE n.a = f.customer_id AND o.core)) AS dbscan_anomaly
FROM flagged f""", extra=_POINT_SQL))
def q_dbscan_customers(spark, sf_dir):
    """DBSCAN core and noise flags over three features per customer (AN4)."""
    point = _customer_points(spark, sf_dir)
    return DE.dbscan(point, ["x", "y", "z"], eps=0.5, min_samples=10).select("customer_id", "dbscan_core", "dbscan_anomaly")


# ---------------------------------------------------------------- ML4, SO1
@register("mean_predictor_metrics", W(f"""
SELECT {R('sqrt(avg((revenue - p) * (revenue - p)))', 6)} AS rmse, {R('avg(abs(revenue - p))', 6)} AS mae,
       {R('1 - sum((revenue - p) * (revenue - p)) / NULLIF(var_pop(revenue) * count(*), 0)', 6)} AS r2, count(*) AS n
FROM (SELECT revenue, avg(revenue) OVER (PARTITION BY category) AS p FROM feat) t"""))
def q_mean_predictor_metrics(spark, sf_dir):
    """RMSE, MAE and R2 of predicting each order by its category's mean (ML4)."""
    df = fact(spark, sf_dir, ["category", "revenue"])
    mean = df.groupBy("category").agg(F.avg("revenue").alias("prediction"))
    return rounded(ML.metrics(df.join(mean, "category")), 6)


# ---------------------------------------------------------------- ML3, ML5, ML6, ML8, TK8
def _split(spark, sf_dir):
    df = shared_fact(spark, sf_dir)
    return ML.split(FE.engineer(df), ["order_id", "base_price", "units_sold"])


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """Test metrics of all four model families (ML3)."""
    return ML.compare_models(FE.engineer(shared_fact(spark, sf_dir)), ["order_id", "base_price", "units_sold"])


@register("linear_attribution")
def q_linear_attribution(spark, sf_dir):
    """Features with the largest mean contribution to the linear model (ML8, TK8)."""
    train, test = _split(spark, sf_dir)
    model = ML.fit(ML.model_input(train), ML.regressors()["Linear Regression"])
    return ML.linear_attribution(model, ML.model_input(test))


@register("scored_residuals")
def q_scored_residuals(spark, sf_dir):
    """Test orders with prediction and residual of the linear model (ML5, ML6)."""
    train, test = _split(spark, sf_dir)
    model = ML.fit(ML.model_input(train), ML.regressors()["Linear Regression"])
    return ML.residuals(ML.score(model, test, keep=["revenue"]), prediction="predicted_revenue")


_EXACT = "base_price * 2 - discount_percent * 5 + month * 3"
_EXACT_NUM = ["base_price", "discount_percent", "month", "weekday"]


def _exact_model(spark, sf_dir):
    """The linear model of a target that is a known line through four numbers, fitted on the training part."""
    train, _ = _split(spark, sf_dir)
    train = train.withColumn("revenue", F.expr(_EXACT))
    return ML.fit(ML.model_input(train, [], _EXACT_NUM), ML.regressors()["Linear Regression"], [], _EXACT_NUM)


@register("linear_scores", W(f"""
SELECT order_id, {R('base_price', 6)} AS base_price, units_sold, {R(f'({_EXACT}) / 1000', 6)} AS predicted, 0.0::DOUBLE AS residual FROM feat"""))
def q_linear_scores(spark, sf_dir):
    """All orders scored by a linear model whose target is a known line: predictions and residuals must be that line's (ML1, ML5, ML6)."""
    orders_ = FE.engineer(shared_fact(spark, sf_dir, ["order_id", "order_date", "base_price", "discount_percent", "units_sold"]))
    scored = ML.score(_exact_model(spark, sf_dir), orders_.withColumn("revenue", F.expr(_EXACT)), [], _EXACT_NUM,
                      keep=["order_id", "units_sold", "revenue"])
    rest = ML.residuals(scored, keep=["order_id", "base_price", "units_sold"], prediction="predicted_revenue")
    return rounded(rest.select("order_id", "base_price", "units_sold", (F.col("predicted") / 1000).alias("predicted"), "residual"), 6,
                   {"residual": 4})


@register("linear_contributions", W(f"""
SELECT feature, {R('mean_abs', 4)} AS mean_abs FROM (
  SELECT 'base_price' AS feature, avg(abs(base_price - (SELECT avg(base_price) FROM feat))) * 2 AS mean_abs FROM feat
  UNION ALL SELECT 'discount_percent', avg(abs(discount_percent - (SELECT avg(discount_percent) FROM feat))) * 5 FROM feat
  UNION ALL SELECT 'month', avg(abs(month - (SELECT avg(month) FROM feat))) * 3 FROM feat) c"""))
def q_linear_contributions(spark, sf_dir):
    """The three largest mean contributions to that linear model, which are known too (ML8, TK8)."""
    orders_ = FE.engineer(shared_fact(spark, sf_dir, ["order_date", "base_price", "discount_percent"])).withColumn("revenue", F.expr(_EXACT))
    told = ML.linear_attribution(_exact_model(spark, sf_dir), ML.model_input(orders_, [], _EXACT_NUM), top_n=3, num=_EXACT_NUM)
    return rounded(told, 4)


# ---------------------------------------------------------------- SO1, DR4
_WINDOW_SQL = """
b AS (SELECT max(order_date) - INTERVAL 3 MONTH AS cut, max(order_date) - INTERVAL 3 MONTH - INTERVAL 6 MONTH AS start FROM feat),
win AS (SELECT f.*, CASE WHEN order_date >= cut THEN 'cur' ELSE 'ref' END AS side FROM feat f CROSS JOIN b WHERE order_date >= start)"""


@register("window_label_codes", W("SELECT feature, label, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY label) - 1 AS INTEGER) AS code FROM ("
                                  + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, {c} AS label FROM win WHERE {c} IS NOT NULL"
                                                       for c in ML.PRED_DRIFT_CAT) + ") l", extra=_WINDOW_SQL))
def q_window_label_codes(spark, sf_dir):
    """Codes of the category labels over the reference and current windows together (SO1)."""
    return ML.label_codes(DR.tag_windows(fact(spark, sf_dir, ["order_date", *ML.PRED_DRIFT_CAT])))


@register("mean_predictor_drift", W(f"""
SELECT {R("round_even(ref_r2 * 1000, 0) / 1000", 3)} AS ref_r2, {R("round_even(cur_r2 * 1000, 0) / 1000", 3)} AS cur_r2,
       {R("round_even(ref_mae, 0)", 0)} AS ref_mae, {R("round_even(cur_mae, 0)", 0)} AS cur_mae,
       {R("round_even((ref_r2 - cur_r2) * 1000, 0) / 1000", 3)} AS r2_drop, ref_r2 - cur_r2 > 0.05 AS drift_alert
FROM (SELECT max(CASE WHEN side = 'ref' THEN r2 END) AS ref_r2, max(CASE WHEN side = 'cur' THEN r2 END) AS cur_r2,
             max(CASE WHEN side = 'ref' THEN mae END) AS ref_mae, max(CASE WHEN side = 'cur' THEN mae END) AS cur_mae
      FROM (SELECT side, 1 - sum((revenue - p) * (revenue - p)) / NULLIF(var_pop(revenue) * count(*), 0) AS r2, avg(abs(revenue - p)) AS mae
            FROM (SELECT w.side, w.revenue, m.p FROM win w JOIN (
                    SELECT category, zone, avg(revenue) AS p FROM win WHERE side = 'ref' GROUP BY category, zone) m
                  ON w.category = m.category AND w.zone = m.zone) GROUP BY side) s) t""", extra=_WINDOW_SQL))
def q_mean_predictor_drift(spark, sf_dir):
    """Prediction drift of the reference window's mean revenue per category and zone (DR4)."""
    t = DR.tag_windows(fact(spark, sf_dir, ["order_date", "category", "zone", "revenue"]))
    mean = t.where(F.col("side") == "ref").groupBy("category", "zone").agg(F.avg("revenue").alias("prediction"))
    return rounded(ML.window_drift(t.join(mean, ["category", "zone"])), 3, {"ref_mae": 0, "cur_mae": 0})


# ---------------------------------------------------------------- PR4, IV2, IN4, IN5 on demand that reaches every branch
# The given tables hold no price response, discounts up to 10 % and one pressure
# level, so the default queries reach few branches.  Here units follow price and
# discount by category, discounts are eight times as high and pressure depends on
# the zone; the thresholds are the operators' own.
_SHAPE = {
    "discount_percent": "CASE WHEN zone = 'EUROPE' THEN discount_percent * 12 ELSE discount_percent * 8 END",
    "inventory_pressure": "CASE WHEN zone IN ('AFRICA', 'EUROPE') OR (zone = 'ASIA' AND discount_percent >= 5) THEN 'High' ELSE 'Low' END",
    "units_sold": "CAST(floor(CASE length(category) % 3 WHEN 0 THEN 1000000000 / (final_price * final_price) + discount_percent * 20 "
                  "WHEN 1 THEN 30000 / sqrt(final_price) ELSE final_price / 2 + discount_percent * 900 END * CASE zone WHEN 'AFRICA' THEN 3 WHEN 'ASIA' THEN 2.5 "
                  "WHEN 'AMERICA' THEN 0.4 ELSE 1 END) AS INT)",
}


def _shaped_sql(sql: str) -> str:
    shaped = ", ".join(f"{e} AS {c}" for c, e in _SHAPE.items())
    return sql.replace(FACT_SQL, FACT_SQL.replace("fact AS (", "plain AS (", 1) + f",\nfact AS (SELECT * REPLACE ({shaped}) FROM plain)")


def _shaped(spark, sf_dir):
    return FE.engineer(shared_fact(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _SHAPE.items()}))


def _on_shaped(name: str, run):
    @register(f"{name}_shaped", _shaped_sql(ORACLE[name]))
    def q(spark, sf_dir):
        return run(_shaped(spark, sf_dir))
    q.__doc__ = f"``{name}`` on demand shaped so that every branch is reached."


_on_shaped("price_recommendations", lambda df: rounded(PR.price_recommendations(df), 1, {"elasticity": 4}))
_on_shaped("inventory_alerts", lambda df: rounded(IV.alerts(df), 6, {"velocity_score": 1}))
_on_shaped("urgent_groups", lambda df: rounded(IV.urgent_groups(IV.alerts(df)).select(
    "category", "zone", "alert_level", "velocity_score", "group"), 1))
_on_shaped("elastic_categories", lambda df: rounded(IN.elastic_categories(df), 6, {"base_price_total": 2}))
_on_shaped("recommendations", IN.recommendations)


# ---------------------------------------------------------------- SC3: arrays and lines in one folder
ARRAY_ROWS = 50_000          # orders of a JSON array, on average
ARRAYS = 64                  # arrays at least


def _write_arrays(raw, path: str) -> None:
    """One gzipped file per JSON array, over several lines; their number follows the counted rows,
    so that an array's size does not."""
    n = max(ARRAYS, -(-raw.count() // ARRAY_ROWS))
    part = F.pmod(F.xxhash64("order_id", "base_price", "final_price"), F.lit(n)).alias("part")
    # the rows are moved as columns and become text where their array is put together
    dealt = raw.select("*", part).repartition(n, "part")
    each = F.to_json(F.struct(*raw.columns))
    arrays = dealt.groupBy("part").agg(F.concat(F.lit("\n [\n"), F.array_join(F.collect_list(each), ",\n"), F.lit("\n]\n")).alias("value"))
    arrays.write.partitionBy("part").option("compression", "gzip").text(path)


@register("orders_from_mixed_json", _READ_SQL)
def q_orders_from_mixed_json(spark, sf_dir):
    """Orders landed as JSON lines and as JSON arrays in one folder, each file read by its own form (SC3)."""
    raw = shared_fact(spark, sf_dir)
    raw = raw.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "order_date" else F.col(c)
                       for c in (f.name for f in RAW_ORDER_SCHEMA.fields)])
    path = f"{_shared(spark, 'orders')}.json"
    sinks.export_json(raw.where("units_sold % 2 = 0"), path, "gzip")
    _write_arrays(raw.where("units_sold % 2 <> 0"), f"{path}/arrays")
    df = FE.prepare(orders.load_orders(spark, path))
    return rounded(df.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"), F.sum("discount_percent").alias("discount"),
        F.sum("units_sold").alias("units"), F.countDistinct("category").alias("categories")), 4, {"discount": 2})


# ---------------------------------------------------------------- SC8, SK2, SK5
@register("trend_file_scan", W("""
SELECT strftime(date, '%Y-%m-%d') AS day, keyword, CAST(interest AS DOUBLE) AS interest FROM daily
WHERE keyword IN ('click', 'view', 'purchase')""", extra=_TRENDS_SQL))
def q_trend_file_scan(spark, sf_dir):
    """A wide trend file with its marker column, landed as CSV, read back and melted (SC8, PJ12)."""
    kinds = ["click", "view", "purchase"]
    day = F.add_months(F.to_date("ts"), -360).alias("date")
    wide = table(spark, sf_dir, "events").groupBy(day).pivot("event_type", kinds).agg(F.count(F.lit(1)))
    path = _shared(spark, "trends")
    wide.withColumn("isPartial", F.lit(False)).write.option("header", True).csv(path)
    long = landed.trends_long(landed.read_trends(spark, path)).where(F.col("interest").isNotNull())
    return long.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "keyword", "interest")


@register("stored_drift_report", W(f"""
SELECT CAST(sum(CASE WHEN psi > 0.2 OR ks_p_value < 0.05 THEN 1 ELSE 0 END) AS INTEGER) AS features_drifted,
       {R('max((round_even((psi) * 10000.0, 0) / 10000.0))', 4)} AS max_psi,
       (SELECT r2_drop FROM ({ORACLE["mean_predictor_drift"]}) d) AS pred_r2_drop, (SELECT drift_alert FROM ({ORACLE["mean_predictor_drift"]}) d) AS drift_alert,
       string_agg(feature, ',' ORDER BY feature) AS reported, true AS has_time FROM res""", extra=_DRIFT_SQL))
def q_stored_drift_report(spark, sf_dir):
    """The drift report with the prediction drift, appended to its table and read back: all six columns (SK2, DR3, DR4)."""
    drop = QUERIES["mean_predictor_drift"](spark, sf_dir).first()        # one row
    path = _shared(spark, "drift-report")
    features = DR.feature_drift(fact(spark, sf_dir, ["order_date", *DRIFT_FEATURES]))
    sinks.save_drift_report(DR.drift_report(features, drop["r2_drop"], drop["drift_alert"]), path)
    back = spark.read.schema(DRIFT_REPORT_SCHEMA).parquet(path)
    names = F.from_json("report_json", "array<struct<feature string>>")
    return rounded(back.select("features_drifted", "max_psi", "pred_r2_drop", "drift_alert",
                               F.array_join(F.array_sort(F.transform(names, lambda f: f["feature"])), ",").alias("reported"),
                               F.col("created_at").isNotNull().alias("has_time")), 4)


@register("report_folder", W(f"""
SELECT 'kpis' AS part, 1::BIGINT AS rows, 0.0::DOUBLE AS revenue
UNION ALL SELECT 'insights', count(*), 0.0 FROM ({ORACLE["executive_narrative"]}) n
UNION ALL SELECT 'recommendations', count(*), 0.0 FROM ({ORACLE["recommendations"]}) r
UNION ALL SELECT 'data', count(*), {R('sum(revenue)', 2)} FROM feat
UNION ALL SELECT 'monthly', count(DISTINCT year_month), {R('sum(revenue)', 2)} FROM feat WHERE year_month IS NOT NULL"""))
def q_report_folder(spark, sf_dir):
    """The five tables of a report folder, read back: rows of each and the revenue of two (SK5)."""
    df = fact(spark, sf_dir)
    path = _shared(spark, "report")
    sinks.export_report(path, IN.summary_kpis(df, 84.0), IN.narrative(df), IN.recommendations(df), df.select("order_id", "order_date", "revenue"),
                        SU.monthly_revenue(df))
    out = None
    for part, value in (("kpis", None), ("insights", None), ("recommendations", None), ("data", "revenue"), ("monthly", "revenue_sum")):
        total = F.sum(value) if value else F.lit(0.0)
        one = spark.read.parquet(f"{path}/{part}").agg(F.count(F.lit(1)).alias("rows"), total.alias("revenue")).select(F.lit(part).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


# ---------------------------------------------------------------- AN5, AG17: a vote that SQL can take too
@register("customer_votes", W("""
SELECT customer_id, noise AS dbscan_anomaly, far AS zscore_anomaly, wide AS robust_anomaly,
       CAST(noise AS INTEGER) + CAST(far AS INTEGER) + CAST(wide AS INTEGER) AS anomaly_votes,
       CAST(noise AS INTEGER) + CAST(far AS INTEGER) + CAST(wide AS INTEGER) >= 2 AS confirmed_anomaly
FROM (SELECT f.customer_id, NOT (core OR EXISTS (
               SELECT 1 FROM near n JOIN flagged o ON o.customer_id = n.b WHERE n.a = f.customer_id AND o.core)) AS noise,
             abs(x - mx) / sx > 2.2 OR abs(y - my) / sy > 2.2 OR abs(z - mz) / sz > 2.2 AS far,
             abs((x - qx[2]) / (qx[3] - qx[1])) > 1.6 OR abs((y - qy[2]) / (qy[3] - qy[1])) > 1.6
               OR abs((z - qz[2]) / (qz[3] - qz[1])) > 1.6 AS wide
      FROM flagged f JOIN point USING (customer_id), (
        SELECT avg(x) mx, stddev_samp(x) sx, avg(y) my, stddev_samp(y) sy, avg(z) mz, stddev_samp(z) sz,
               quantile_cont(x, [0.25, 0.5, 0.75]) qx, quantile_cont(y, [0.25, 0.5, 0.75]) qy, quantile_cont(z, [0.25, 0.5, 0.75]) qz
        FROM point) s) v""", extra=_POINT_SQL))
def q_customer_votes(spark, sf_dir):
    """DBSCAN noise, z-scores and robust-scaled distances of customers, confirmed by two votes of three (AN1, AN2, AN4, AN5)."""
    point = AN.zscore_flags(_customer_points(spark, sf_dir), ["x", "y", "z"], 2.2)
    point = AN.robust_scale(point, ["x", "y", "z"])
    wide = F.lit(False)
    for c in "xyz":
        wide |= F.abs(F.col(f"rs_{c}")) > 1.6
    out = AN.votes(DE.dbscan(point.withColumn("robust_anomaly", wide), ["x", "y", "z"], eps=0.5, min_samples=10, labels=False),
                   ["dbscan_anomaly", "zscore_anomaly", "robust_anomaly"], 2)
    return out.select("customer_id", "dbscan_anomaly", "zscore_anomaly", "robust_anomaly", "anomaly_votes", "confirmed_anomaly")


# ---------------------------------------------------------------- CU6: a given model's likelihood
_GIVEN = (0.9, 40.0, 0.8, 2.5)


@register("purchase_model_likelihood", W(f"""
SELECT count(*) AS customers, {R("sum(lgamma(r + x) - lgamma(r) + r * ln(alpha) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)"
    " + ln(pow(alpha + t, -(r + x)) + CASE WHEN x > 0 THEN a / (b + x - 1) * pow(alpha + tx, -(r + x)) ELSE 0 END)) / 100", 4)} AS loglik
FROM (SELECT count(*) - 1 AS x, date_diff('day', min(day), max(day)) / 7.0::DOUBLE AS tx, date_diff('day', min(day), any_value(last)) / 7.0::DOUBLE AS t
      FROM (SELECT DISTINCT customer_id, CAST(order_date AS DATE) AS day, (SELECT max(CAST(order_date AS DATE)) FROM feat) AS last
            FROM feat WHERE customer_id IS NOT NULL) v GROUP BY customer_id) c,
     (SELECT {', '.join(f'{v}::DOUBLE AS {n}' for n, v in zip(('r', 'alpha', 'a', 'b'), _GIVEN))}) p"""))
def q_purchase_model_likelihood(spark, sf_dir):
    """Log-likelihood of the customers' histories under given purchase-model parameters, in hundreds (CU6)."""
    cust = LT.customer_cells(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"]))
    told = LT.loglik(LT.purchase_cells(cust), "bgnbd", _GIVEN)
    return rounded(told.select("customers", (F.col("loglik") / 100).alias("loglik")), 4)


# ---------------------------------------------------------------- TS3, TS4: series whose future is known
_PLANTED = {"growing": "1000.0 * length(zone) * exp(0.01 * t + 0.1 * sin(pi() * month(month) / 6))",
            "seasonal": "1000.0 * length(zone) + 50.0 * t + 200.0 * sin(pi() * month(month) / 6)"}


def _planted_sql(form: str, after: str) -> str:
    value = R(f"({_PLANTED[form].replace('month(month)', 'month(m)')}) / 1000", 6)
    return W(f"""
SELECT zone, strftime(m, '%Y-%m') AS month, {value} AS yhat, {value} AS yhat_lower, {value} AS yhat_upper, t > last AS is_forecast
FROM (SELECT zone, last, t, first + to_months(CAST(t AS INTEGER)) AS m
      FROM (SELECT zone, first, last, unnest(range(0, last + 25)) AS t
            FROM (SELECT zone, min(mon) AS first, date_diff('month', min(mon), max(mon)) AS last
                  FROM (SELECT zone, date_trunc('month', order_date) AS mon FROM feat WHERE zone IS NOT NULL) d GROUP BY zone) z) u) v
WHERE {after}""")


def _planted(spark, sf_dir, form: str):
    """The zones' months with values of a known form; t counts months from the zone's first."""
    s = TS.monthly_series(fact(spark, sf_dir, ["order_date", "zone", "revenue"]), "revenue", "sum", by=["zone"])
    first = s.groupBy("zone").agg(F.min("month").alias("first"))
    s = s.join(F.broadcast(first), "zone").withColumn("t", F.round(F.months_between("month", "first")))      # a row per zone
    return s.select("zone", "month", F.expr(_PLANTED[form]).alias("value"))


def _told(f):
    return rounded(f.select("zone", F.date_format("month", "yyyy-MM").alias("month"),
                            *[(F.col(c) / 1000).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")], "is_forecast"), 6)


@register("planted_growth_forecast", _planted_sql("growing", "true"))
def q_planted_growth_forecast(spark, sf_dir):
    """Forecast of exponential growth with a season: fit and 24 future months must be that form's, the band of no width (TS3)."""
    return _told(TS.forecast(_planted(spark, sf_dir, "growing"), "month", "value", periods=24, by=["zone"], growth="log_linear"))


@register("planted_season_forecast", _planted_sql("seasonal", "t > last"))
def q_planted_season_forecast(spark, sf_dir):
    """Seasonal ARIMA forecast of a line with a season: 24 future months must be that form's, the band of no width (TS4)."""
    f = TS.seasonal_arima_forecast(_planted(spark, sf_dir, "seasonal"), "month", "value", periods=24, by=["zone"])
    return _told(f.withColumn("is_forecast", F.lit(True)))

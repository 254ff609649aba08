"""Customer analytics: RFM, churn-risk features and score, simple CLV with
tiers, at-risk alerts, cohort tables and retention (CU1-CU5, CU7-CU8, AG15,
AG16, WN8).

Plan shape: one ``groupBy(customer)`` (partial aggregation map-side, one
shuffle), global scalars (snapshot date, percentiles) as one-row tables
cross-joined by broadcast -- never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk import texts
from souk.functions import clip, customer_key, month_start, months_between_keys, safe_div, np_round
from souk.operators.ordered import column_quantiles, first_in_group, materialize


def with_customer_id(df: DataFrame, null_literal: bool = True) -> DataFrame:
    """Keep ``customer_id`` when present, else synthesise state_gender_age."""
    if "customer_id" in df.columns:
        return df
    return df.withColumn("customer_id", customer_key("state", "customer_gender", "customer_age",
                                                     null_literal))


def _days(later: str, earlier: str):
    # whole elapsed days, floored like Timedelta.days (T9)
    return F.expr(f"timestampdiff(DAY, `{earlier}`, `{later}`)").cast("int")


def rfm(df: DataFrame, snapshot_offset_days: int = 1) -> DataFrame:
    """Recency (days since last order), frequency (dated orders), monetary
    (mean revenue), first purchase and T (customer age in days) per customer;
    snapshot = latest order date + ``snapshot_offset_days`` (CU1)."""
    df = with_customer_id(df)
    snap = df.agg((F.max("order_date") + F.expr(f"INTERVAL {int(snapshot_offset_days)} DAY"))
                  .alias("_snapshot"))
    per = (df.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
             .agg(F.max("order_date").alias("_last"),
                  F.count("order_date").alias("frequency"),
                  F.avg("revenue").alias("monetary"),
                  F.min("order_date").alias("first_purchase")))
    return (per.crossJoin(F.broadcast(snap))
               .select("customer_id",
                       _days("_snapshot", "_last").alias("recency"),
                       "frequency", "monetary", "first_purchase",
                       _days("_snapshot", "first_purchase").alias("T")))


def customer_features(df: DataFrame) -> DataFrame:
    """Per-customer churn features (CU2); snapshot = latest order date.

    Modal category/zone: the most frequent value, ties to the smallest.
    """
    df = with_customer_id(df)
    snap = df.agg(F.max("order_date").alias("_snapshot"))
    per = (df.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
             .agg(F.max("order_date").alias("last_order_date"),
                  F.min("order_date").alias("first_order_date"),
                  F.count("revenue").alias("order_count"),
                  F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
                  F.avg("revenue").alias("avg_order_value"),
                  F.avg("discount_percent").alias("avg_discount"),
                  F.mode("category", True).alias("top_category"),
                  F.mode("zone", True).alias("top_zone")))
    out = per.crossJoin(F.broadcast(snap))
    days_since = _days("_snapshot", "last_order_date")
    age = _days("_snapshot", "first_order_date")
    return out.select(
        "customer_id", "last_order_date", "first_order_date", "order_count", "total_revenue",
        "avg_order_value", "avg_discount", "top_category", "top_zone",
        days_since.alias("days_since_last_order"), age.alias("customer_age_days"),
        (F.col("order_count") / F.greatest(age / 30.0, F.lit(1.0))).alias("purchase_frequency"))


def _named_quantiles(df: DataFrame, spec: dict[str, tuple[str, float]]) -> DataFrame:
    """One-row table of named quantiles of several columns, one ranking job:
    ``{'p95_rev': ('total_revenue', .95), ...}``."""
    probs: dict[str, list[float]] = {}
    for c, q in spec.values():
        if q not in probs.setdefault(c, []):
            probs[c].append(q)
    q = column_quantiles(df, probs)
    return q.agg(*[F.max(F.when((F.col("feature") == c) & (F.col("q") == float(p)), F.col("value")))
                   .alias(name) for name, (c, p) in spec.items()])


def churn_scores(cust: DataFrame) -> DataFrame:
    """Churn risk 0-100 (CU3): 40 recency + 35 (1 - frequency) + 25 (1 - monetary),
    each scaled by its own 95th percentile and clipped to [0, 1]; value tier
    at the revenue p75 / p50; risk label at 70 / 50 / 30."""
    cust = materialize(cust)   # thresholds and scores read it once
    th = _named_quantiles(cust, {
        "_p95_days": ("days_since_last_order", 0.95),
        "_p95_freq": ("purchase_frequency", 0.95),
        "_p95_rev": ("total_revenue", 0.95),
        "_p75_rev": ("total_revenue", 0.75),
        "_p50_rev": ("total_revenue", 0.50),
    })
    s = cust.crossJoin(F.broadcast(th))
    rec = clip(F.col("days_since_last_order") / F.greatest(F.col("_p95_days"), F.lit(1.0)), 0.0, 1.0) * 40
    frq = (1 - clip(F.col("purchase_frequency") / F.greatest(F.col("_p95_freq"), F.lit(1e-9)), 0.0, 1.0)) * 35
    mon = (1 - clip(F.col("total_revenue") / F.greatest(F.col("_p95_rev"), F.lit(1e-9)), 0.0, 1.0)) * 25
    s = s.withColumns({"recency_risk": rec, "frequency_risk": frq, "monetary_risk": mon})
    score = np_round(F.col("recency_risk") + F.col("frequency_risk") + F.col("monetary_risk"), 1)
    tier = (F.when(F.col("total_revenue") >= F.col("_p75_rev"), "High Value")
             .when(F.col("total_revenue") >= F.col("_p50_rev"), "Mid Value").otherwise("Low Value"))
    s = s.withColumn("churn_risk_score", score).withColumn("value_tier", tier)
    label = (F.when(F.col("churn_risk_score") >= 70, "Critical")
              .when(F.col("churn_risk_score") >= 50, "High")
              .when(F.col("churn_risk_score") >= 30, "Medium").otherwise("Low"))
    return s.withColumn("risk_label", label).drop(*[c for c in s.columns if c.startswith("_p")])


def recommended_action(risk_label="risk_label", value_tier="value_tier",
                       avg_discount="avg_discount", top_category="top_category"):
    """Action text per customer (rule order as specified)."""
    cat = F.coalesce(F.col(top_category), F.lit("nan"))
    disc = F.least(F.col(avg_discount) + 10, F.lit(40.0))
    return (F.when((F.col(risk_label) == "Critical") & (F.col(value_tier) == "High Value"),
                   F.format_string(texts.CUSTOMER_ACTIONS["critical, high value"], disc, cat))
             .when((F.col(risk_label) == "High") & (F.col(value_tier) == "High Value"),
                   F.format_string(texts.CUSTOMER_ACTIONS["high, high value"], cat))
             .when(F.col(value_tier) == "Mid Value",
                   F.format_string(texts.CUSTOMER_ACTIONS["mid value"], cat))
             .otherwise(F.lit(texts.CUSTOMER_ACTIONS["other"])))


def at_risk_alerts(df: DataFrame, top_n: int = 50, min_score: float = 50.0) -> DataFrame:
    """At-risk alert list (CU5): score >= ``min_score`` and High/Mid value,
    the ``top_n`` highest scores (ties: customer id), action text, UTC time."""
    scored = churn_scores(customer_features(df))
    hit = scored.where((F.col("churn_risk_score") >= min_score) &
                       F.col("value_tier").isin("High Value", "Mid Value"))
    top = hit.orderBy(F.col("churn_risk_score").desc(), F.col("customer_id").asc()).limit(top_n)
    return top.withColumns({"recommended_action": recommended_action(),
                            "alert_generated_at": F.current_timestamp()})


def revenue_at_risk(alerts: DataFrame) -> DataFrame:
    """Revenue of the alert list by risk label x value tier (AG16)."""
    return (alerts.groupBy("risk_label", "value_tier")
            .agg(F.coalesce(F.sum("total_revenue"), F.lit(0.0)).alias("total_revenue")))


def simple_clv(df: DataFrame, horizon_months: int = 12, margin: float = 0.20) -> DataFrame:
    """CLV = frequency / max(T / 30, 1) * monetary * horizon * margin, 2 dp,
    with quartile tiers (CU4)."""
    r = rfm(df, snapshot_offset_days=1)
    r = r.withColumns({"T_months": F.col("T") / 30.0})
    r = r.withColumn("purchase_rate", F.col("frequency") / F.greatest(F.col("T_months"), F.lit(1.0)))
    r = r.withColumn("clv", np_round(F.col("purchase_rate") * F.col("monetary") * horizon_months * margin, 2))
    return add_clv_tiers(r)


def add_clv_tiers(r: DataFrame, col: str = "clv") -> DataFrame:
    r = materialize(r)
    th = _named_quantiles(r, {"_q1": (col, 0.25), "_q2": (col, 0.5), "_q3": (col, 0.75)})
    x = F.col(col)
    tier = (F.when(x >= F.col("_q3"), "Champions").when(x >= F.col("_q2"), "Loyalists")
             .when(x >= F.col("_q1"), "At-Risk").otherwise("Lost / Dormant"))
    return r.crossJoin(F.broadcast(th)).withColumn("clv_tier", tier).drop("_q1", "_q2", "_q3")


def clv_tier_summary(clv: DataFrame) -> DataFrame:
    """Customers, mean and total CLV per tier (AG15)."""
    return (clv.groupBy("clv_tier")
            .agg(F.count(F.lit(1)).alias("customers"), F.avg("clv").alias("avg_clv"),
                 F.coalesce(F.sum("clv"), F.lit(0.0)).alias("total_clv")))


def cohort_table(df: DataFrame, metric: str = "revenue") -> DataFrame:
    """Long cohort table (CU7): cohort month (first order month of the
    customer), months since, and revenue sum or order count."""
    df = with_customer_id(df, null_literal=False)
    base = (df.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
              .select("customer_id", month_start("order_date").alias("order_month"),
                      *(["revenue"] if metric == "revenue" else [])))
    base = first_in_group(base, "customer_id", "order_month", "cohort_month")
    period = months_between_keys(F.col("order_month"), F.col("cohort_month")).alias("cohort_period")
    agg = (F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue") if metric == "revenue"
           else F.count(F.lit(1)).alias("count"))
    return (base.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort_month"), period)
            .agg(agg))


def cohort_retention(cohort: DataFrame, metric: str = "revenue") -> DataFrame:
    """Value as % of the cohort's period-0 value, 1 dp (CU8).  The window is
    over the aggregated cohort table (cohorts x periods rows)."""
    w = Window.partitionBy("cohort_month")
    base = F.max(F.when(F.col("cohort_period") == 0, F.col(metric))).over(w)
    return cohort.select("cohort_month", "cohort_period", metric,
                         np_round(safe_div(F.col(metric) * 100.0, base), 1).alias("retention_pct"))


def cohort_pivot(cohort: DataFrame, metric: str, periods: list[int]) -> DataFrame:
    """Wide cohort matrix with the given period columns."""
    return cohort.groupBy("cohort_month").pivot("cohort_period", periods).agg(F.first(metric))

"""Executive summary, narrative texts, risk / opportunity rules and the
prioritised recommendation list (IN1-IN5, AG22).

All inputs are one pass of fused aggregates: a global conditional aggregate,
one GROUPING SETS pass for the arg-max keys, the monthly series for growth.
Rules are ``when`` expressions over that one-row context; texts are built
with ``format_string`` -- the rows never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk import texts
from souk.functions import safe_corr, safe_div
from souk.operators import summary as SU

PRIORITY_ORDER = ["High", "Medium", "Low"]


def _month_growth(df: DataFrame) -> DataFrame:
    """One row: growth of the last month over the previous (NULL if < 2 months)."""
    m = SU.monthly_by(df.withColumn("_all", F.lit(1)), "_all").drop("_all")
    w = Window.orderBy(F.col("year_month").desc())
    last2 = m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    return last2.agg(
        F.max(F.when(F.col("_r") == 1, F.col("revenue"))).alias("_last"),
        F.max(F.when(F.col("_r") == 2, F.col("revenue"))).alias("_prev"),
        F.count(F.lit(1)).alias("_months")).select(
        F.when(F.col("_months") >= 2,
               safe_div((F.col("_last") - F.col("_prev")) * 100, F.col("_prev"))).alias("mom_growth"))


def summary_kpis(df: DataFrame, fx: float = 84.0) -> DataFrame:
    """One-row executive KPI table (IN1)."""
    rev = F.coalesce(F.sum("revenue"), F.lit(0.0))
    g = df.agg(
        rev.alias("total_revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.avg("revenue").alias("avg_order_value"),
        F.avg("discount_percent").alias("avg_discount"),
        F.coalesce(F.sum(F.when(F.col("sales_event") == "Festival", F.col("revenue"))), F.lit(0.0)).alias("_fest"),
        F.coalesce(F.sum(F.when(F.col("brand_type") == "Premium", F.col("revenue"))), F.lit(0.0)).alias("_prem"),
        F.avg(F.when(F.col("competition_intensity") == "High", F.col("discount_percent"))).alias("_hc_disc"),
        F.coalesce(F.sum(F.col("base_price") - F.col("final_price")), F.lit(0.0)).alias("_disc_cost"),
        F.coalesce(F.sum("base_price"), F.lit(0.0)).alias("base_price_total"),
        safe_div(F.sum(F.when(F.col("inventory_pressure") == "High", 1).otherwise(0)) * 1.0,
                 F.count(F.lit(1))).alias("high_pressure_share"))
    tops = SU.arg_best(df, ("category", "zone", "state"))
    t = tops.agg(*[F.max(F.when(F.col("dimension") == d, F.col("top_value"))).alias(f"top_{d}")
                   for d in ("category", "zone", "state")])
    out = g.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(_month_growth(df)))
    pct = lambda x: F.when(F.col("total_revenue") != 0, x * 100 / F.col("total_revenue")).otherwise(F.lit(0.0))
    return out.select(
        "total_revenue",
        (F.col("total_revenue") / 1e7).alias("revenue_cr"),
        (F.col("total_revenue") / F.lit(fx) / 1e6).alias("revenue_usd_m"),
        "orders", "avg_order_value", "avg_discount",
        pct(F.col("_fest")).alias("festival_revenue_pct"),
        pct(F.col("_prem")).alias("premium_revenue_pct"),
        F.coalesce(F.col("_hc_disc"), F.col("avg_discount")).alias("high_competition_discount"),
        "top_category", "top_zone", "top_state", "mom_growth",
        (F.col("_disc_cost") / 1e7).alias("discount_cost_cr"),
        "base_price_total", "high_pressure_share")


def kpi_texts(k: DataFrame) -> DataFrame:
    """The KPI values as display strings (IN1)."""
    return k.select(
        F.format_string("%.1f Cr  ($%.1fM USD)", "revenue_cr", "revenue_usd_m").alias("Total Revenue"),
        F.format_number("orders", 0).alias("Total Orders"),
        F.format_number("avg_order_value", 0).alias("Avg Order Value"),
        F.format_string("%.1f%%", "avg_discount").alias("Avg Discount"),
        F.format_string("%.1f%%", "festival_revenue_pct").alias("Festival Revenue %"),
        F.format_string("%.1f%%", "premium_revenue_pct").alias("Premium Brand %"),
        F.col("top_category").alias("Top Category"),
        F.col("top_zone").alias("Top Zone"),
        F.col("top_state").alias("Top State"),
        F.coalesce(F.format_string("%+.1f%%", "mom_growth"), F.lit("N/A")).alias("MoM Growth"),
        F.format_string("%.1f Cr", "discount_cost_cr").alias("Total Discount Cost"))


def narrative(df: DataFrame, fx: float = 84.0) -> DataFrame:
    """Headline, insights, risks and opportunities as rows (section, seq, text)
    (IN2, IN3)."""
    k = summary_kpis(df, fx)
    low = SU.top_n(df, "zone", 2, ascending=True)
    lowz = low.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("revenue", "zone"))),
                                            lambda s: s["zone"]), " & ").alias("_low_zones"))
    c = k.crossJoin(F.broadcast(lowz))
    ad, fp, pp = F.col("avg_discount"), F.col("festival_revenue_pct"), F.col("premium_revenue_pct")
    mom = F.col("mom_growth")

    def item(section, seq, text, cond=None):
        s = F.struct(F.lit(section).alias("section"), F.lit(seq).alias("seq"), text.alias("text"))
        return F.when(cond, s) if cond is not None else s

    items = [
        item("headline", 0, F.format_string(texts.NARRATIVE["headline 0"],
                                            "revenue_cr", F.format_number("orders", 0), "top_category", "top_zone")),
        item("insight", 1, F.format_string(texts.NARRATIVE["insight 1"], "top_category")),
        item("insight", 2, F.format_string(texts.NARRATIVE["insight 2"], "top_zone")),
        item("insight", 3, F.format_string(texts.NARRATIVE["insight 3"], fp)),
        item("insight", 4, F.format_string(texts.NARRATIVE["insight 4"], ad, "discount_cost_cr")),
        item("insight", 5, F.format_string(texts.NARRATIVE["insight 5"], pp, F.when(pp > 40, "is strong").otherwise("has room to grow"))),
        item("insight", 6, F.format_string(texts.NARRATIVE["insight 6"],
                                           F.when(mom > 0, "growing").otherwise("declining"), mom),
             mom.isNotNull()),
        item("risk", 1, F.format_string(texts.NARRATIVE["risk 1"], ad), ad > 35),
        item("risk", 2, F.format_string(texts.NARRATIVE["risk 2"], fp), fp > 50),
        item("risk", 3, F.format_string(texts.NARRATIVE["risk 3"], "high_competition_discount"),
             F.col("high_competition_discount") > ad + 10),
        item("risk", 4, F.format_string(texts.NARRATIVE["risk 4"], mom), mom < -5),
        item("opportunity", 1, F.format_string(texts.NARRATIVE["opportunity 1"], F.col("base_price_total") * 0.05 / 1e7), ad > 25),
        item("opportunity", 2, F.format_string(texts.NARRATIVE["opportunity 2"], pp), pp < 40),
        item("opportunity", 3, F.format_string(texts.NARRATIVE["opportunity 3"], "_low_zones")),
        item("opportunity", 4, F.lit(texts.NARRATIVE["opportunity 4"]), F.col("high_pressure_share") > 0.4),
    ]
    no_risk = ~((ad > 35) | (fp > 50) | (F.col("high_competition_discount") > ad + 10) |
                F.coalesce(mom < -5, F.lit(False)))
    items.append(item("risk", 5, F.lit(texts.NARRATIVE["risk 5"]), no_risk))
    return (c.select(F.explode(F.array_compact(F.array(*items))).alias("_i"))
             .select("_i.section", "_i.seq", "_i.text"))


def elastic_categories(df: DataFrame, min_rows: int = 30, min_corr: float = 0.1) -> DataFrame:
    """Categories whose units rise with discount: >= min_rows rows and
    corr(discount, units) > min_corr, by correlation descending (IN4)."""
    g = (df.where(F.col("category").isNotNull()).groupBy("category")
           .agg(F.count(F.lit(1)).alias("_n"), safe_corr("discount_percent", "units_sold").alias("corr"),
                F.coalesce(F.sum("base_price"), F.lit(0.0)).alias("base_price_total")))
    return (g.where((F.col("_n") >= min_rows) & (F.col("corr") > min_corr)).drop("_n")
             .orderBy(F.col("corr").desc(), F.col("category")))


def recommendations(df: DataFrame) -> DataFrame:
    """Prioritised recommendation rows (IN5): priority, category, action,
    impact, effort, metric; ordered High, Medium, Low then rule order."""
    base = df.agg(
        F.avg("discount_percent").alias("_avg_disc"),
        safe_div(F.sum(F.when(F.col("brand_type") == "Premium", 1).otherwise(0)) * 100.0,
                 F.count(F.lit(1))).alias("_prem_orders_pct"),
        safe_div(F.sum(F.when(F.col("competition_intensity") == "High", 1).otherwise(0)) * 1.0,
                 F.count(F.lit(1))).alias("_hc_share"))
    fest = SU.top_months(df, F.col("sales_event") == "Festival", 3)
    fest_row = fest.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "month"))),
                                    lambda s: s["month"]).alias("_fest_months"))
    zones = SU.arg_best(df, ("zone",)).select(
        F.col("top_value").alias("_top_zone"), F.col("top_total").alias("_top_rev"),
        F.col("bottom_value").alias("_bottom_zone"), F.col("bottom_total").alias("_bottom_rev"))
    # the two most responsive categories only (bounded before collecting)
    el = elastic_categories(df).limit(2)
    el_row = el.agg(F.array_sort(F.collect_list(
        F.struct((-F.col("corr")).alias("k"), "category", "base_price_total"))).alias("_elastic"))
    c = (base.crossJoin(F.broadcast(fest_row)).crossJoin(F.broadcast(zones))
             .crossJoin(F.broadcast(el_row)))

    def rec(rank, seq, priority, category, action, impact, effort, metric, cond=None):
        s = F.struct(F.lit(rank).alias("_rank"), F.lit(seq).alias("_seq"), F.lit(priority).alias("priority"),
                     F.lit(category).alias("category"), action.alias("action"), impact.alias("impact"),
                     F.lit(effort).alias("effort"), F.lit(metric).alias("metric"))
        return F.when(cond, s) if cond is not None else s

    def pricing(i):
        e = F.element_at(F.col("_elastic"), i)
        return rec(0, i, "High", "Pricing",
                   F.format_string(texts.RECOMMENDATIONS["action pricing"], e["category"]),
                   F.format_string(texts.RECOMMENDATIONS["impact pricing"], e["base_price_total"] * 0.06 / 1e7),
                   "Low", "Avg discount %", (F.col("_avg_disc") > 30) & (F.size("_elastic") >= i))

    months_txt = F.concat(F.lit("["), F.array_join(F.col("_fest_months"), ", "), F.lit("]"))
    recs = [
        pricing(1), pricing(2),
        rec(0, 3, "High", "Inventory",
            F.format_string(texts.RECOMMENDATIONS["action 3"], months_txt),
            F.lit(texts.RECOMMENDATIONS["impact 3"]),
            "Medium", "Inventory pressure %", F.size("_fest_months") > 0),
        rec(1, 4, "Medium", "Growth",
            F.format_string(texts.RECOMMENDATIONS["action 4"],
                            "_bottom_zone", safe_div(F.col("_bottom_rev") * 100, F.col("_top_rev")), "_top_zone"),
            F.lit(texts.RECOMMENDATIONS["impact 4"]), "Medium", "Zone revenue share",
            F.col("_top_zone").isNotNull()),
        rec(1, 5, "Medium", "Revenue Mix",
            F.lit(texts.RECOMMENDATIONS["action 5"]),
            F.format_string(texts.RECOMMENDATIONS["impact 5"], "_prem_orders_pct"),
            "Low", "Premium revenue %", F.col("_prem_orders_pct") < 45),
        rec(2, 6, "Low", "Retention", F.lit(texts.RECOMMENDATIONS["action 6"]),
            F.lit(texts.RECOMMENDATIONS["impact 6"]),
            "High", "Repeat purchase rate"),
        rec(1, 7, "Medium", "Competitive",
            F.lit(texts.RECOMMENDATIONS["action 7"]),
            F.lit(texts.RECOMMENDATIONS["impact 7"]),
            "Medium", "Discount % in high-competition segments", F.col("_hc_share") > 0.3),
    ]
    out = (c.select(F.explode(F.array_compact(F.array(*recs))).alias("_r"))
            .select("_r.*"))
    return out.orderBy("_rank", "_seq").select(
        F.row_number().over(Window.orderBy("_rank", "_seq")).alias("position"),
        "priority", "category", "action", "impact", "effort", "metric")


def attention_counts(at_risk_scored: DataFrame, alerts: DataFrame, drift: DataFrame) -> DataFrame:
    """Counts that need attention (AG22): critical customers, CRITICAL/HIGH
    inventory groups, drifted features."""
    a = at_risk_scored.agg(F.sum(F.when(F.col("risk_label") == "Critical", 1).otherwise(0)).cast("long")
                           .alias("critical_customers"))
    b = alerts.agg(F.sum(F.when(F.col("alert_level").isin("CRITICAL", "HIGH"), 1).otherwise(0)).cast("long")
                   .alias("urgent_inventory_groups"))
    c = drift.agg(F.coalesce(F.sum(F.col("drift_detected").cast("int")), F.lit(0)).cast("long")
                  .alias("drifted_features"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))       # one row each

"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the order fact derived from the given tables, with a DuckDB SQL twin in
``ORACLE`` where SQL can express it.

Floating results are rounded in both engines (summation order differs); the
rounding belongs to the check view, not to the analytics, which return full
precision.  The fact values sit on decimal grids (revenue has 4 decimals,
prices divided by small quantities terminate within 9 decimals), so digits are
chosen per kind of value to snap onto the grid rather than onto a rounding
tie: row-level values and quantiles 9, sums of revenue 4, means and ratios 6,
other sums 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk import texts
from souk.operators import features as FE
from souk.operators import summary as SU
from souk.sources.star import FACT_SQL, shared_fact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Quantisation of floating results for the side-by-side check.  The fact's
# values sit on decimal grids (4-dp revenue, means over 2^k rows terminate),
# so a boundary at .5 is hit exactly and the engines' last-bit differences
# (summation order) decide the side.  The boundary is placed at an
# off-grid fraction instead, which no grid value can equal.
_CHECK_OFFSET = 0.4142135623


def _half_away(c, digits: int):
    """sign(x) * floor(|x| * 10^d + offset) / 10^d, the same IEEE steps as
    the SQL twin ``R`` (+ 0.0 folds a negative zero)."""
    scale = F.lit(float(10 ** digits))
    return (F.signum(c) * F.floor(F.abs(c) * scale + _CHECK_OFFSET).cast("double") / scale) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, per_col: dict[str, int] | None = None) -> DataFrame:
    """Round every double column for the side-by-side check."""
    per_col = per_col or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(_half_away(F.col(f.name), per_col.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    scale = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + {_CHECK_OFFSET!r}) / {scale} + 0.0)"


def NPR(expr: str, digits: int) -> str:
    """SQL twin of ``souk.functions.np_round`` (rint(x * 10^d) / 10^d)."""
    scale = repr(float(10 ** digits))
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def fact(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Prepared fact (derived columns added) over the given tables, scanned
    from the shared materialised fact (see ``sources.star.shared_fact``)."""
    return FE.engineer(shared_fact(spark, sf_dir, columns))


def W(body: str, extra: str = "") -> str:
    """Prefix the shared fact CTE (and the derived-column CTE) to a query."""
    ctes = [FACT_SQL, FEATURES_SQL]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body


FEATURES_SQL = """
feat AS (
  SELECT *,
         CAST(year(order_date) AS INTEGER) AS year,
         CAST(month(order_date) AS INTEGER) AS month,
         strftime(order_date, '%Y-%m') AS year_month,
         CAST(isodow(order_date) - 1 AS INTEGER) AS weekday
  FROM fact
)"""


# ---------------------------------------------------------------- AG1 / AG3
@register("monthly_revenue", W(f"""
SELECT year_month,
       {R('sum(revenue)', 4)} AS revenue_sum,
       {R('avg(revenue)', 6)} AS revenue_mean,
       count(*) AS orders
FROM feat WHERE year_month IS NOT NULL GROUP BY year_month"""))
def q_monthly_revenue(spark, sf_dir):
    df = fact(spark, sf_dir, ["order_date", "revenue", "base_price", "final_price", "units_sold"])
    return rounded(SU.monthly_revenue(df), 6, {"revenue_sum": 4})


# ---------------------------------------------------------------- helpers
from souk.operators import customers as CU  # noqa: E402
from souk.operators import inventory as IV  # noqa: E402
from souk.operators import ordered as OR  # noqa: E402
from souk.operators import pricing as PR  # noqa: E402
from souk.schema import DIMENSIONS, MEASURES  # noqa: E402


def _union_dims(dims, select_tpl: str, source: str = "feat", where: str = "") -> str:
    parts = []
    for d in dims:
        parts.append(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, "
                     + select_tpl.format(d=d)
                     + f" FROM {source} WHERE {d} IS NOT NULL {where} GROUP BY {d}")
    return "\nUNION ALL\n".join(parts)



# ---------------------------------------------------------------- PJ1-PJ9
FEATURE_COLS = ["order_id", "customer_id", "year", "month", "month_name", "weekday", "is_weekend",
                "fiscal_quarter", "year_month", "discount_amount", "discount_ratio",
                "revenue_per_unit", "log_base_price", "log_final_price", "log_units_sold",
                "log_revenue"]


@register("order_features", W(f"""
SELECT order_id, customer_id, year, month, monthname(order_date) AS month_name, weekday,
       COALESCE(weekday >= 5, false) AS is_weekend,
       CAST(((month - 4) % 12 + 12) % 12 // 3 + 1 AS TINYINT) AS fiscal_quarter,
       year_month,
       {R('base_price - final_price', 9)} AS discount_amount,
       {R('(base_price - final_price) / NULLIF(base_price, 0)', 9)} AS discount_ratio,
       {R('final_price', 9)} AS revenue_per_unit,
       {R('ln(1 + greatest(base_price, 0))', 9)} AS log_base_price,
       {R('ln(1 + greatest(final_price, 0))', 9)} AS log_final_price,
       {R('ln(1 + greatest(CAST(units_sold AS DOUBLE), 0))', 9)} AS log_units_sold,
       {R('ln(1 + greatest(revenue, 0))', 9)} AS log_revenue
FROM feat"""))
def q_order_features(spark, sf_dir):
    """Cleaned fact with calendar, fiscal, price and log features (PJ1-PJ9)."""
    df = FE.prepare(shared_fact(spark, sf_dir))
    return rounded(df.select(*FEATURE_COLS), 9)


# ---------------------------------------------------------------- AG2
for _dim in ("zone", "brand_type", "sales_event"):
    def _mk(dim):
        @register(f"monthly_by_{dim}", W(f"""
SELECT year_month, {dim}, {R('sum(revenue)', 4)} AS revenue
FROM feat WHERE year_month IS NOT NULL AND {dim} IS NOT NULL GROUP BY year_month, {dim}"""))
        def q(spark, sf_dir):
            df = fact(spark, sf_dir, ["order_date", dim, "revenue"])
            return rounded(SU.monthly_by(df, dim), 4)
        q.__doc__ = f"Monthly revenue by {dim} (AG2)."
        return q
    _mk(_dim)


# ---------------------------------------------------------------- AG4
@register("dimension_means", W(_union_dims(
    DIMENSIONS, ", ".join(f"{R(f'avg({m})', 4)} AS mean_{m}" for m in MEASURES))))
def q_dimension_means(spark, sf_dir):
    """Mean revenue / price / units / discount per value of six dimensions (AG4)."""
    df = fact(spark, sf_dir, [*DIMENSIONS, *MEASURES, "order_date"])
    return rounded(SU.dimension_means(df), 4)


# ---------------------------------------------------------------- AG5
_COUNT_DIMS = [*DIMENSIONS, "customer_gender", "state"]


@register("value_counts", W(_union_dims(_COUNT_DIMS, "count(*) AS count")))
def q_value_counts(spark, sf_dir):
    """Order counts per value of eight dimensions (AG5)."""
    df = fact(spark, sf_dir, [*_COUNT_DIMS, "order_date"])
    return SU.value_counts(df, _COUNT_DIMS)


@register("top_states_by_orders", W("""
SELECT state, count(*) AS count FROM feat WHERE state IS NOT NULL
GROUP BY state ORDER BY count DESC, state ASC LIMIT 12"""))
def q_top_states_by_orders(spark, sf_dir):
    """Top 12 states by order count (AG5, TK1)."""
    return SU.top_n(fact(spark, sf_dir, ["state", "order_date"]), "state", 12, value=None)


# ---------------------------------------------------------------- AG6
_SHARE_DIMS = ["category", "zone", "sales_event", "brand_type", "customer_gender", "competition_intensity"]


@register("revenue_share", W(f"""
SELECT dimension, value, {R('revenue', 4)} AS revenue,
       {R('revenue * 100 / NULLIF(sum(revenue) OVER (PARTITION BY dimension), 0)', 6)} AS share_pct
FROM ({_union_dims(_SHARE_DIMS, 'sum(revenue) AS revenue')}) t"""))
def q_revenue_share(spark, sf_dir):
    """Revenue share per value of six dimensions (AG6)."""
    df = fact(spark, sf_dir, [*_SHARE_DIMS, "revenue", "order_date"])
    return rounded(SU.revenue_share(df, _SHARE_DIMS), 6, {"revenue": 4})


@register("top_states_revenue", W(f"""
SELECT state, {R('sum(revenue)', 4)} AS revenue FROM feat WHERE state IS NOT NULL
GROUP BY state ORDER BY sum(revenue) DESC, state ASC LIMIT 8"""))
def q_top_states_revenue(spark, sf_dir):
    """Top 8 states by revenue (TK1)."""
    return rounded(SU.top_n(fact(spark, sf_dir, ["state", "revenue", "order_date"]), "state", 8), 4)


@register("bottom_zones", W(f"""
SELECT zone, {R('sum(revenue)', 4)} AS revenue FROM feat WHERE zone IS NOT NULL
GROUP BY zone ORDER BY sum(revenue) ASC, zone ASC LIMIT 2"""))
def q_bottom_zones(spark, sf_dir):
    """Two lowest-revenue zones (TK2)."""
    return rounded(SU.top_n(fact(spark, sf_dir, ["zone", "revenue", "order_date"]), "zone", 2,
                            ascending=True), 4)


@register("top_bottom_groups", W(f"""
SELECT dimension,
       arg_min(value, rmax) AS top_value, {R('min(CASE WHEN rmax = 1 THEN total END)', 4)} AS top_total,
       arg_min(value, rmin) AS bottom_value, {R('min(CASE WHEN rmin = 1 THEN total END)', 4)} AS bottom_total
FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value ASC) AS rmax,
                row_number() OVER (PARTITION BY dimension ORDER BY total ASC, value ASC) AS rmin
      FROM ({_union_dims(['category', 'zone', 'state'], 'sum(revenue) AS total')}) u) r
GROUP BY dimension"""))
def q_top_bottom_groups(spark, sf_dir):
    """Arg-max / arg-min category, zone and state by revenue (TK3)."""
    df = fact(spark, sf_dir, ["category", "zone", "state", "revenue", "order_date"])
    return rounded(SU.arg_best(df), 4)


# ---------------------------------------------------------------- AG7
_HIST_COLS = ["customer_age", "discount_percent", "units_sold"]


def _hist_sql(cols, bins):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS feature, CAST(x AS DOUBLE) AS x FROM (SELECT {c} AS x FROM feat) WHERE x IS NOT NULL""")
    long = "\nUNION ALL\n".join(parts)
    return f"""
SELECT feature, bin, {R(f'lo + bin * ((hi - lo) / {bins})', 6)} AS bin_lo,
       {R(f'lo + (bin + 1) * ((hi - lo) / {bins})', 6)} AS bin_hi, count(*) AS count
FROM (
  SELECT l.feature, lo, hi,
         CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin
  FROM ({long}) l
  JOIN (SELECT feature, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
        FROM ({long}) GROUP BY feature) r ON l.feature = r.feature
) GROUP BY feature, bin, lo, hi"""


@register("histograms", W(_hist_sql(_HIST_COLS, 40)))
def q_histograms(spark, sf_dir):
    """40-bin equal-width histograms of age, discount and units (AG7)."""
    df = fact(spark, sf_dir, [*_HIST_COLS, "order_date"])
    return rounded(SU.histogram(df, _HIST_COLS, 40), 6)


# ---------------------------------------------------------------- AG8
def _box_sql(group, value):
    return f"""
SELECT b.{group}, {R('q1', 9)} AS q1, {R('median', 9)} AS median, {R('q3', 9)} AS q3, {R('q3 - q1', 9)} AS iqr,
       {R(f'min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END)', 9)} AS lower_whisker,
       {R(f'max(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END)', 9)} AS upper_whisker,
       CAST(sum(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       count(*) AS n
FROM feat b JOIN (
  SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3
  FROM feat WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY {group}) q ON b.{group} = q.{group}
WHERE b.{value} IS NOT NULL
GROUP BY b.{group}, q1, median, q3"""


for _g, _v in (("category", "final_price"), ("zone", "revenue"), ("sales_event", "discount_percent")):
    def _mkbox(group, value):
        @register(f"box_{value}_by_{group}", W(_box_sql(group, value)))
        def q(spark, sf_dir):
            df = fact(spark, sf_dir, [group, value, "order_date"])
            return rounded(SU.box_stats(df, group, value), 9)
        q.__doc__ = f"Box statistics of {value} by {group} (AG8)."
        return q
    _mkbox(_g, _v)


# ---------------------------------------------------------------- AG10
@register("revenue_hierarchy", W(f"""
WITH_PLACEHOLDER"""))
def q_revenue_hierarchy(spark, sf_dir):
    """Category > zone > brand revenue rollup with share of parent (AG10)."""
    df = fact(spark, sf_dir, ["category", "zone", "brand_type", "revenue", "order_date"])
    return rounded(SU.hierarchy_rollup(df), 6, {"revenue": 4})


ORACLE["revenue_hierarchy"] = W(f"""
SELECT level, category, zone, brand_type, {R('revenue', 4)} AS revenue,
       {R('revenue * 100 / NULLIF(parent, 0)', 6)} AS parent_share_pct
FROM (
  SELECT n.*, (SELECT sum(revenue) FROM nodes p WHERE p.level = n.level - 1
                 AND (n.level - 1 < 1 OR p.category = n.category)
                 AND (n.level - 1 < 2 OR p.zone = n.zone)) AS parent
  FROM nodes n) t""", extra="""
nodes AS (
  SELECT 3 AS level, category, zone, brand_type, sum(revenue) AS revenue FROM feat GROUP BY 2, 3, 4
  UNION ALL SELECT 2, category, zone, NULL, sum(revenue) FROM feat GROUP BY 2, 3
  UNION ALL SELECT 1, category, NULL, NULL, sum(revenue) FROM feat GROUP BY 2
  UNION ALL SELECT 0, NULL, NULL, NULL, sum(revenue) FROM feat
)""")


# ---------------------------------------------------------------- AG11 / AG12
@register("kpis", W(f"""
SELECT {R('sum(revenue)', 2)} AS total_revenue, count(*) AS orders,
       {R('avg(revenue)', 6)} AS avg_order_value, {R('avg(discount_percent)', 6)} AS avg_discount,
       {R('avg(units_sold)', 6)} AS avg_units, {R('sum(revenue) / 84.0', 4)} AS revenue_usd
FROM feat"""))
def q_kpis(spark, sf_dir):
    """Headline KPIs (AG11)."""
    df = fact(spark, sf_dir, ["revenue", "discount_percent", "units_sold", "order_date"])
    return rounded(SU.kpis(df), 6, {"total_revenue": 2, "revenue_usd": 4})


@register("segment_shares", W(f"""
SELECT {R("sum(CASE WHEN sales_event = 'Festival' THEN revenue END) * 100 / NULLIF(sum(revenue), 0)")} AS festival_revenue_pct,
       {R("COALESCE(sum(CASE WHEN brand_type = 'Premium' THEN revenue END), 0) * 100 / NULLIF(sum(revenue), 0)")} AS premium_revenue_pct,
       {R("sum(CASE WHEN brand_type = 'Premium' THEN 1 ELSE 0 END) * 100.0 / count(*)")} AS premium_order_pct,
       {R("avg(CASE WHEN competition_intensity = 'High' THEN discount_percent END)")} AS high_competition_avg_discount,
       {R("sum(CASE WHEN competition_intensity = 'High' THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS high_competition_share,
       {R("sum(CASE WHEN inventory_pressure = 'High' THEN 1 ELSE 0 END) * 1.0 / count(*)")} AS high_pressure_share,
       {R('sum(base_price - final_price)', 2)} AS unit_discount_cost,
       {R('sum(base_price)', 2)} AS base_price_total
FROM feat"""))
def q_segment_shares(spark, sf_dir):
    """Festival / premium / competition / pressure shares, discount cost (AG12)."""
    df = fact(spark, sf_dir, ["revenue", "sales_event", "brand_type", "competition_intensity",
                              "discount_percent", "inventory_pressure", "base_price", "final_price",
                              "order_date"])
    return rounded(SU.segment_shares(df), 6, {"unit_discount_cost": 2, "base_price_total": 2})


# ---------------------------------------------------------------- AG13 / AG14
@register("state_revenue", W(f"""
SELECT state, {R('sum(revenue)', 4)} AS revenue FROM feat WHERE state IS NOT NULL GROUP BY state"""))
def q_state_revenue(spark, sf_dir):
    """Revenue by state (AG13)."""
    return rounded(SU.group_revenue(fact(spark, sf_dir, ["state", "revenue", "order_date"]), "state"), 4)


@register("units_matrix", W(f"""
SELECT category, zone, {R(NPR('avg(units_sold)', 1), 1)} AS avg_units_sold FROM feat
WHERE category IS NOT NULL AND zone IS NOT NULL GROUP BY category, zone"""))
def q_units_matrix(spark, sf_dir):
    """Mean units per category x zone, 1 dp (AG14)."""
    return rounded(SU.mean_matrix(fact(spark, sf_dir, ["category", "zone", "units_sold", "order_date"])), 1)


# ---------------------------------------------------------------- customers
_CUST_COLS = ["customer_id", "order_date", "revenue", "discount_percent", "category", "zone"]

_CUST_FEATURES_SQL = """
cust AS (
  SELECT customer_id, max(order_date) AS last_order_date, min(order_date) AS first_order_date,
         count(revenue) AS order_count, COALESCE(sum(revenue), 0) AS total_revenue,
         avg(revenue) AS avg_order_value, avg(discount_percent) AS avg_discount
  FROM feat WHERE customer_id IS NOT NULL GROUP BY customer_id
),
modes AS (
  SELECT customer_id,
         max(CASE WHEN kind = 'c' AND rn = 1 THEN v END) AS top_category,
         max(CASE WHEN kind = 'z' AND rn = 1 THEN v END) AS top_zone
  FROM (
    SELECT customer_id, kind, v,
           row_number() OVER (PARTITION BY customer_id, kind ORDER BY n DESC, v ASC) AS rn
    FROM (SELECT customer_id, 'c' AS kind, category AS v, count(*) AS n FROM feat
          WHERE category IS NOT NULL GROUP BY 1, 2, 3
          UNION ALL
          SELECT customer_id, 'z', zone, count(*) FROM feat WHERE zone IS NOT NULL GROUP BY 1, 2, 3) x
  ) y GROUP BY customer_id
),
features AS (
  SELECT c.*, m.top_category, m.top_zone,
         CAST(date_diff('day', c.last_order_date, s.snap) AS INTEGER) AS days_since_last_order,
         CAST(date_diff('day', c.first_order_date, s.snap) AS INTEGER) AS customer_age_days,
         c.order_count / greatest(CAST(date_diff('day', c.first_order_date, s.snap) AS INTEGER) / 30.0, 1.0)
           AS purchase_frequency
  FROM cust c LEFT JOIN modes m USING (customer_id)
  CROSS JOIN (SELECT max(order_date) AS snap FROM feat) s
),
th AS (
  SELECT quantile_cont(days_since_last_order, 0.95) AS p95_days,
         quantile_cont(purchase_frequency, 0.95) AS p95_freq,
         quantile_cont(total_revenue, 0.95) AS p95_rev,
         quantile_cont(total_revenue, 0.75) AS p75_rev,
         quantile_cont(total_revenue, 0.50) AS p50_rev
  FROM features
),
scored0 AS (
  SELECT f.*,
         least(greatest(days_since_last_order / greatest(p95_days, 1.0), 0.0), 1.0) * 40 AS recency_risk,
         (1 - least(greatest(purchase_frequency / greatest(p95_freq, 1e-9), 0.0), 1.0)) * 35 AS frequency_risk,
         (1 - least(greatest(total_revenue / greatest(p95_rev, 1e-9), 0.0), 1.0)) * 25 AS monetary_risk,
         CASE WHEN total_revenue >= p75_rev THEN 'High Value'
              WHEN total_revenue >= p50_rev THEN 'Mid Value' ELSE 'Low Value' END AS value_tier
  FROM features f CROSS JOIN th
),
scored AS (
  SELECT *, CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 50 THEN 'High'
                 WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_label
  FROM (SELECT *, (round_even((recency_risk + frequency_risk + monetary_risk) * 10.0, 0) / 10.0) AS score FROM scored0) t
)"""

_DT = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _ts(df, *cols):
    # timestamps compared as text (engines differ in timestamp types)
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@register("customer_features", W(f"""
SELECT customer_id, {_DT.format(c='last_order_date')} AS last_order_date,
       {_DT.format(c='first_order_date')} AS first_order_date, order_count,
       {R('total_revenue', 4)} AS total_revenue, {R('avg_order_value')} AS avg_order_value,
       {R('avg_discount')} AS avg_discount, top_category, top_zone, days_since_last_order,
       customer_age_days, {R('purchase_frequency')} AS purchase_frequency
FROM features""", extra=_CUST_FEATURES_SQL))
def q_customer_features(spark, sf_dir):
    """Per-customer churn features incl. modal category/zone (CU2)."""
    cf = CU.customer_features(fact(spark, sf_dir, _CUST_COLS))
    return rounded(_ts(cf, "last_order_date", "first_order_date"), 6, {"total_revenue": 4})


_SCORE_COLS = ["customer_id", "days_since_last_order", "purchase_frequency", "total_revenue",
               "recency_risk", "frequency_risk", "monetary_risk", "churn_risk_score",
               "value_tier", "risk_label"]


@register("churn_scores", W(f"""
SELECT customer_id, days_since_last_order, {R('purchase_frequency')} AS purchase_frequency,
       {R('total_revenue', 4)} AS total_revenue, {R('recency_risk')} AS recency_risk,
       {R('frequency_risk')} AS frequency_risk, {R('monetary_risk')} AS monetary_risk,
       {R('score', 1)} AS churn_risk_score, value_tier, risk_label
FROM scored""", extra=_CUST_FEATURES_SQL))
def q_churn_scores(spark, sf_dir):
    """Churn risk score, value tier and risk label per customer (CU3)."""
    s = CU.churn_scores(CU.customer_features(fact(spark, sf_dir, _CUST_COLS)))
    return rounded(s.select(*_SCORE_COLS), 6, {"total_revenue": 4, "churn_risk_score": 1})


@register("at_risk_alerts", W(f"""
SELECT customer_id, {R('score', 1)} AS churn_risk_score, risk_label, value_tier,
       days_since_last_order, {R('total_revenue', 4)} AS total_revenue, top_category,
       CASE WHEN risk_label = 'Critical' AND value_tier = 'High Value'
              THEN printf('{texts.CUSTOMER_ACTIONS["critical, high value"]}',
                          least(avg_discount + 10, 40.0), COALESCE(top_category, 'nan'))
            WHEN risk_label = 'High' AND value_tier = 'High Value'
              THEN printf('{texts.CUSTOMER_ACTIONS["high, high value"]}', COALESCE(top_category, 'nan'))
            WHEN value_tier = 'Mid Value'
              THEN printf('{texts.CUSTOMER_ACTIONS["mid value"]}', COALESCE(top_category, 'nan'))
            ELSE '{texts.CUSTOMER_ACTIONS["other"]}' END AS recommended_action
FROM scored WHERE score >= 50 AND value_tier IN ('High Value', 'Mid Value')
ORDER BY score DESC, customer_id ASC LIMIT 50""", extra=_CUST_FEATURES_SQL))
def q_at_risk_alerts(spark, sf_dir):
    """Top-50 at-risk customers with recommended action (CU5, TK5)."""
    a = CU.at_risk_alerts(fact(spark, sf_dir, _CUST_COLS))
    return rounded(a.select("customer_id", "churn_risk_score", "risk_label", "value_tier",
                            "days_since_last_order", "total_revenue", "top_category",
                            "recommended_action"), 6, {"total_revenue": 4, "churn_risk_score": 1})


@register("revenue_at_risk", W(f"""
SELECT risk_label, value_tier, {R('sum(total_revenue)', 4)} AS total_revenue FROM (
  SELECT * FROM scored WHERE score >= 50 AND value_tier IN ('High Value', 'Mid Value')
  ORDER BY score DESC, customer_id ASC LIMIT 50) GROUP BY risk_label, value_tier""",
    extra=_CUST_FEATURES_SQL))
def q_revenue_at_risk(spark, sf_dir):
    """Alert-list revenue by risk label x value tier (AG16)."""
    a = CU.at_risk_alerts(fact(spark, sf_dir, _CUST_COLS))
    return rounded(CU.revenue_at_risk(a), 4)


_RFM_SQL = """
rfm AS (
  SELECT customer_id,
         CAST(date_diff('day', max(order_date), (SELECT max(order_date) + INTERVAL 1 DAY FROM feat)) AS INTEGER) AS recency,
         count(order_date) AS frequency, avg(revenue) AS monetary, min(order_date) AS first_purchase,
         CAST(date_diff('day', min(order_date), (SELECT max(order_date) + INTERVAL 1 DAY FROM feat)) AS INTEGER) AS T
  FROM feat WHERE customer_id IS NOT NULL GROUP BY customer_id
),
clv0 AS (
  SELECT *, T / 30.0 AS T_months, frequency / greatest(T / 30.0, 1.0) AS purchase_rate,
         (round_even((frequency / greatest(T / 30.0, 1.0) * monetary * 12 * 0.2) * 100.0, 0) / 100.0) AS clv
  FROM rfm
),
clv AS (
  SELECT c.*, CASE WHEN clv >= q3 THEN 'Champions' WHEN clv >= q2 THEN 'Loyalists'
                   WHEN clv >= q1 THEN 'At-Risk' ELSE 'Lost / Dormant' END AS clv_tier
  FROM clv0 c CROSS JOIN (SELECT quantile_cont(clv, 0.25) AS q1, quantile_cont(clv, 0.5) AS q2,
                                 quantile_cont(clv, 0.75) AS q3 FROM clv0) q
)"""


@register("rfm", W(f"""
SELECT customer_id, recency, frequency, {R('monetary')} AS monetary,
       {_DT.format(c='first_purchase')} AS first_purchase, T FROM rfm""", extra=_RFM_SQL))
def q_rfm(spark, sf_dir):
    """Recency / frequency / monetary / T per customer (CU1)."""
    r = CU.rfm(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"]))
    return rounded(_ts(r, "first_purchase"), 6)


@register("customer_clv", W(f"""
SELECT customer_id, recency, frequency, {R('monetary')} AS monetary, T,
       {R('T_months')} AS T_months, {R('purchase_rate')} AS purchase_rate, {R('clv', 2)} AS clv, clv_tier
FROM clv""", extra=_RFM_SQL))
def q_customer_clv(spark, sf_dir):
    """Simple CLV with quartile tiers (CU4)."""
    c = CU.simple_clv(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"]))
    return rounded(c.drop("first_purchase"), 6, {"clv": 2})


@register("clv_tiers", W(f"""
SELECT clv_tier, count(*) AS customers, {R('avg(clv)')} AS avg_clv, {R('sum(clv)', 2)} AS total_clv
FROM clv GROUP BY clv_tier""", extra=_RFM_SQL))
def q_clv_tiers(spark, sf_dir):
    """Customers, mean and total CLV per tier (AG15)."""
    c = CU.simple_clv(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"]))
    return rounded(CU.clv_tier_summary(c), 6, {"total_clv": 2})


_COHORT_SQL = """
om AS (
  SELECT customer_id, date_trunc('month', order_date) AS order_month, revenue
  FROM feat WHERE customer_id IS NOT NULL AND order_date IS NOT NULL
),
coh AS (
  SELECT strftime(c.cohort_month, '%Y-%m') AS cohort_month,
         CAST((year(o.order_month) - year(c.cohort_month)) * 12 + month(o.order_month) - month(c.cohort_month) AS INTEGER) AS cohort_period,
         sum(revenue) AS revenue, count(*) AS count
  FROM om o JOIN (SELECT customer_id, min(order_month) AS cohort_month FROM om GROUP BY 1) c USING (customer_id)
  GROUP BY 1, 2
)"""


@register("cohort_revenue", W(f"""
SELECT cohort_month, cohort_period, {R('revenue', 4)} AS revenue FROM coh""", extra=_COHORT_SQL))
def q_cohort_revenue(spark, sf_dir):
    """Cohort month x months-since revenue (CU7, AG21)."""
    return rounded(CU.cohort_table(fact(spark, sf_dir, ["customer_id", "order_date", "revenue"])), 4)


@register("cohort_retention", W(f"""
SELECT cohort_month, cohort_period, count,
       {R("(round_even((count * 100.0 / NULLIF(max(CASE WHEN cohort_period = 0 THEN count END) OVER (PARTITION BY cohort_month), 0)) * 10.0, 0) / 10.0)", 1)} AS retention_pct
FROM coh""", extra=_COHORT_SQL))
def q_cohort_retention(spark, sf_dir):
    """Order-count cohort retention % vs period 0 (CU7, CU8)."""
    t = CU.cohort_table(fact(spark, sf_dir, ["customer_id", "order_date"]), metric="count")
    return rounded(CU.cohort_retention(t, "count"), 1)


# ---------------------------------------------------------------- pricing
def _elast_sql(groups, min_obs, precheck):
    g = ", ".join(groups)
    keys = " AND ".join(f"{c} IS NOT NULL" for c in groups)
    pre = f"AND count(*) >= {min_obs}" if precheck else ""
    return f"""
SELECT {g}, {R(NPR('regr_slope(lq, lp)', 4), 4)} AS elasticity,
       {R(NPR('regr_slope(lq, lp) * regr_slope(lq, lp) * regr_sxx(lq, lp) / NULLIF(regr_syy(lq, lp), 0)', 4), 4)} AS r2,
       count(lq) AS n_obs
FROM (SELECT {g}, CASE WHEN final_price > 0 AND units_sold > 0 THEN ln(final_price) END AS lp,
             CASE WHEN final_price > 0 AND units_sold > 0 THEN ln(CAST(units_sold AS DOUBLE)) END AS lq
      FROM feat WHERE {keys}) t
GROUP BY {g} HAVING count(lq) >= {min_obs} AND regr_sxx(lq, lp) > 0 {pre}"""


for _name, _groups in (("elasticity_by_category", ["category"]),
                       ("elasticity_by_category_zone", ["category", "zone"]),
                       ("elasticity_by_brand_category", ["brand_type", "category"])):
    def _mkel(name, groups):
        @register(name, W(_elast_sql(groups, 50, True)))
        def q(spark, sf_dir):
            df = fact(spark, sf_dir, [*groups, "final_price", "units_sold", "order_date"])
            return PR.elasticity(df, groups, min_obs=50, precheck=True)
        q.__doc__ = f"Log-log price elasticity by {' x '.join(groups)} (PR1, PR3)."
        return q
    _mkel(_name, _groups)


@register("elasticity_pvalues")
def q_elasticity_pvalues(spark, sf_dir):
    """Elasticity by category with the slope's two-sided t-test p-value (PR1, PR2)."""
    df = fact(spark, sf_dir, ["category", "final_price", "units_sold", "order_date"])
    return PR.with_classes(PR.elasticity(df, ["category"], min_obs=50, with_pvalue=True))


_PRICE_SQL = _elast_sql(["category"], 30, False)


@register("price_recommendations", W(f"""
SELECT category, {R('(round_even((cur) * 10.0, 0) / 10.0)', 1)} AS current_discount, {R('opt', 1)} AS optimal_discount,
       {R('(round_even((opt - cur) * 10.0, 0) / 10.0)', 1)} AS change, direction, {R('elasticity', 4)} AS elasticity,
       {R('impact', 1)} AS revenue_impact_pct, rationale
FROM (
  SELECT category, cur, elasticity,
         (round_even((least(greatest(CASE WHEN e >= 0 THEN cur WHEN a > 1 THEN least(cur * (a / (a - 0.5)), 60.0)
                              ELSE greatest(cur * 0.8, 0.0) END, 0.0), 60.0)) * 10.0, 0) / 10.0) AS opt,
         CASE WHEN e >= 0 THEN 'hold' WHEN a > 1 THEN
                CASE WHEN least(cur * (a / (a - 0.5)), 60.0) > cur THEN 'increase' ELSE 'hold' END
              ELSE 'decrease' END AS direction,
         (round_even((CASE WHEN e >= 0 THEN 0.0 ELSE (a - 1) * (CASE WHEN a > 1 THEN least(cur * (a / (a - 0.5)), 60.0)
               ELSE greatest(cur * 0.8, 0.0) END - cur) END) * 10.0, 0) / 10.0) AS impact,
         CASE WHEN e >= 0 THEN '{texts.DISCOUNT_RATIONALE["giffen"]}'
              ELSE printf('{texts.DISCOUNT_RATIONALE["other"]}', e, CASE WHEN a > 1 THEN '{texts.DISCOUNT_RATIONALE["elastic"]}'
                                                       ELSE '{texts.DISCOUNT_RATIONALE["inelastic"]}' END) END AS rationale
  FROM (
    SELECT el.category, el.elasticity, el.elasticity AS e, abs(el.elasticity) AS a,
           COALESCE(d.cur, 30.0) AS cur
    FROM el LEFT JOIN (SELECT category, avg(discount_percent) AS cur FROM feat
                       WHERE category IS NOT NULL GROUP BY category) d USING (category)
  ) x
) y""", extra=f"el AS ({_PRICE_SQL})"))
def q_price_recommendations(spark, sf_dir):
    """Optimal discount per category from elasticity and current discount (PR4, PR5)."""
    df = fact(spark, sf_dir, ["category", "final_price", "units_sold", "discount_percent", "order_date"])
    return rounded(PR.price_recommendations(df), 1, {"elasticity": 4})


# ---------------------------------------------------------------- inventory
_ALERT_SQL = """
grp AS (
  SELECT category, zone, avg(units_sold) AS avg_units_sold, CAST(sum(units_sold) AS BIGINT) AS total_units,
         avg(discount_percent) AS avg_discount, count(revenue) AS n_orders,
         avg(CASE WHEN inventory_pressure = 'High' THEN 1.0 ELSE 0.0 END) * 100 AS high_pressure_pct,
         avg(revenue) AS avg_revenue
  FROM feat WHERE category IS NOT NULL AND zone IS NOT NULL GROUP BY category, zone
),
al AS (
  SELECT g.*, (round_even((avg_units_sold / NULLIF(vmax, 0) * 100) * 10.0, 0) / 10.0) AS velocity_score,
         CASE WHEN avg_units_sold >= vhi AND high_pressure_pct >= 60 THEN 'CRITICAL'
              WHEN avg_units_sold >= vhi AND high_pressure_pct >= 30 THEN 'HIGH'
              WHEN avg_discount >= 45 AND high_pressure_pct >= 50 THEN 'CLEARANCE'
              WHEN avg_units_sold < vlo THEN 'SLOW_MOVER' ELSE 'HEALTHY' END AS alert_level
  FROM grp g CROSS JOIN (SELECT quantile_cont(avg_units_sold, 0.8) AS vhi, quantile_cont(avg_units_sold, 0.2) AS vlo,
                                max(avg_units_sold) AS vmax FROM grp) t
)"""


@register("inventory_alerts", W(f"""
SELECT category, zone, {R('avg_units_sold')} AS avg_units_sold, total_units, {R('avg_discount')} AS avg_discount,
       n_orders, {R('high_pressure_pct')} AS high_pressure_pct, {R('avg_revenue')} AS avg_revenue,
       {R('velocity_score', 1)} AS velocity_score, alert_level,
       CASE alert_level WHEN 'CRITICAL' THEN printf('{texts.ALERT_TEXTS["CRITICAL"]}', category, zone)
                        WHEN 'HIGH' THEN printf('{texts.ALERT_TEXTS["HIGH"]}', category, zone)
                        WHEN 'CLEARANCE' THEN printf('{texts.ALERT_TEXTS["CLEARANCE"]}', category, zone)
                        WHEN 'SLOW_MOVER' THEN printf('{texts.ALERT_TEXTS["SLOW_MOVER"]}', category, zone)
                        ELSE '{texts.ALERT_TEXTS["HEALTHY"]}' END AS recommendation
FROM al""", extra=_ALERT_SQL))
def q_inventory_alerts(spark, sf_dir):
    """Category x zone health, velocity, alert level and recommendation (IV1-IV3)."""
    df = fact(spark, sf_dir, ["category", "zone", "units_sold", "discount_percent", "revenue",
                              "inventory_pressure", "order_date"])
    return rounded(IV.alerts(df), 6, {"velocity_score": 1})


@register("urgent_groups", W(f"""
SELECT category, zone, alert_level, {R('velocity_score', 1)} AS velocity_score,
       category || ' / ' || zone AS "group"
FROM al WHERE alert_level IN ('CRITICAL', 'HIGH')
ORDER BY alert_level, velocity_score DESC, category, zone LIMIT 15""", extra=_ALERT_SQL))
def q_urgent_groups(spark, sf_dir):
    """First 15 CRITICAL/HIGH inventory groups with labels (IV4)."""
    df = fact(spark, sf_dir, ["category", "zone", "units_sold", "discount_percent", "revenue",
                              "inventory_pressure", "order_date"])
    u = IV.urgent_groups(IV.alerts(df))
    return rounded(u.select("category", "zone", "alert_level", "velocity_score", "group"), 1)


# ---------------------------------------------------------------- drift
from souk.operators import drift as DR  # noqa: E402
from souk.schema import DRIFT_FEATURES  # noqa: E402

_LONG_DRIFT = "\nUNION ALL\n".join(
    f"SELECT side, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM tt WHERE {f} IS NOT NULL"
    for f in DRIFT_FEATURES)
_KS_TERMS = "list_reduce(list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)), lambda p, q: p + q)"

_DRIFT_SQL = f"""
b AS (SELECT max(order_date) - INTERVAL 3 MONTH AS cut,
             max(order_date) - INTERVAL 3 MONTH - INTERVAL 6 MONTH AS start FROM feat),
tt AS (SELECT * FROM (
         SELECT f.*, CASE WHEN order_date >= start AND order_date < cut THEN 'ref'
                          WHEN order_date >= cut THEN 'cur' END AS side
         FROM feat f CROSS JOIN b) WHERE side IS NOT NULL),
gate AS (SELECT sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS nref_rows,
                sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS ncur_rows FROM tt),
lng AS ({_LONG_DRIFT}),
vc AS (SELECT feature, x, CAST(sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS BIGINT) AS n_ref,
              CAST(sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS BIGINT) AS n_cur
       FROM lng GROUP BY feature, x),
bp AS (SELECT feature, list_sort(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS bps
       FROM lng WHERE side = 'ref' GROUP BY feature),
st AS (SELECT feature, CAST(sum(n_ref) AS BIGINT) AS N_ref, CAST(sum(n_cur) AS BIGINT) AS N_cur,
              sum(x * n_ref) / sum(n_ref) AS ref_mean, sum(x * n_cur) / sum(n_cur) AS cur_mean
       FROM vc GROUP BY feature),
bc AS (SELECT feature, len(list_filter(bps, lambda v: v <= x)) AS bucket,
              sum(n_ref) AS b_ref, sum(n_cur) AS b_cur
       FROM vc JOIN bp USING (feature) GROUP BY 1, 2),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM (
          SELECT feature,
                 CASE WHEN CAST(b_ref AS DOUBLE) / N_ref = 0 THEN 1e-6 ELSE CAST(b_ref AS DOUBLE) / N_ref END AS e,
                 CASE WHEN CAST(b_cur AS DOUBLE) / N_cur = 0 THEN 1e-6 ELSE CAST(b_cur AS DOUBLE) / N_cur END AS a
          FROM bc JOIN st USING (feature)) GROUP BY feature),
ks AS (SELECT feature, max(abs(CAST(cr AS DOUBLE) / nr - CAST(cc AS DOUBLE) / nc)) AS ks_statistic FROM (
         SELECT feature,
                sum(n_ref) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS cr,
                sum(n_cur) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS cc,
                sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc
         FROM vc) GROUP BY feature),
res0 AS (
  SELECT st.*, psi.psi, ks.ks_statistic,
         (sqrt(CAST(N_ref AS DOUBLE) * N_cur / (CAST(N_ref AS DOUBLE) + N_cur)) + 0.12
          + 0.11 / sqrt(CAST(N_ref AS DOUBLE) * N_cur / (CAST(N_ref AS DOUBLE) + N_cur))) * ks.ks_statistic AS lam
  FROM st JOIN psi USING (feature) JOIN ks USING (feature) CROSS JOIN gate
  WHERE nref_rows >= 50 AND ncur_rows >= 50 AND N_ref >= 10 AND N_cur >= 10),
res AS (
  SELECT *, CASE WHEN lam <= 0 THEN 1.0 ELSE least(greatest(2.0 * {_KS_TERMS}, 0.0), 1.0) END AS ks_p_value
  FROM res0)"""


@register("feature_drift", W(f"""
SELECT feature, {R('(round_even((psi) * 10000.0, 0) / 10000.0)', 4)} AS psi, {R('(round_even((ks_statistic) * 10000.0, 0) / 10000.0)', 4)} AS ks_statistic,
       {R('(round_even((ks_p_value) * 10000.0, 0) / 10000.0)', 4)} AS ks_p_value,
       (psi > 0.2 OR ks_p_value < 0.05) AS drift_detected,
       CASE WHEN NOT (psi > 0.2 OR ks_p_value < 0.05) THEN 'None' WHEN psi > 0.25 THEN 'High'
            WHEN psi > 0.2 THEN 'Medium' ELSE 'Low' END AS severity,
       {R('(round_even((ref_mean) * 100.0, 0) / 100.0)', 2)} AS ref_mean, {R('(round_even((cur_mean) * 100.0, 0) / 100.0)', 2)} AS cur_mean,
       {R('(round_even(((cur_mean - ref_mean) / (ref_mean + 1e-9) * 100) * 10.0, 0) / 10.0)', 1)} AS mean_shift_pct
FROM res""", extra=_DRIFT_SQL))
def q_feature_drift(spark, sf_dir):
    """PSI / KS drift of five features, reference 6 months vs current 3 months (DR1-DR3)."""
    df = fact(spark, sf_dir, ["order_date", *DRIFT_FEATURES])
    return rounded(DR.feature_drift(df), 4, {"ref_mean": 2, "cur_mean": 2, "mean_shift_pct": 1})


@register("drift_summary", W(f"""
SELECT CAST(sum(CASE WHEN psi > 0.2 OR ks_p_value < 0.05 THEN 1 ELSE 0 END) AS INTEGER) AS features_drifted,
       {R('max((round_even((psi) * 10000.0, 0) / 10000.0))', 4)} AS max_psi
FROM res""", extra=_DRIFT_SQL))
def q_drift_summary(spark, sf_dir):
    """Drift-report summary row: features drifted and max PSI (SK2, AG22)."""
    df = fact(spark, sf_dir, ["order_date", *DRIFT_FEATURES])
    rep = DR.drift_report(DR.feature_drift(df))
    return rounded(rep.select("features_drifted", "max_psi"), 4)


# ---------------------------------------------------------------- ordered (WN*)
@register("pareto_category", W(f"""
SELECT category, {R('revenue', 4)} AS revenue, CAST(rank AS INTEGER) AS rank,
       {R('cum * 100 / total')} AS cumulative_pct,
       ((cum - revenue) * 100 / total < 80 AND cum * 100 / total >= 80) AS crosses_80
FROM (SELECT category, revenue,
             row_number() OVER (ORDER BY revenue DESC, category ASC) AS rank,
             sum(revenue) OVER (ORDER BY revenue DESC, category ASC ROWS UNBOUNDED PRECEDING) AS cum,
             sum(revenue) OVER () AS total
      FROM (SELECT category, sum(revenue) AS revenue FROM feat WHERE category IS NOT NULL GROUP BY 1))"""))
def q_pareto_category(spark, sf_dir):
    """Pareto table of revenue by category with the 80 % crossing (WN1)."""
    return rounded(OR.pareto(fact(spark, sf_dir, ["category", "revenue", "order_date"]), "category"),
                   6, {"revenue": 4})


@register("pareto_customer", W(f"""
SELECT customer_id, {R('revenue', 4)} AS revenue, CAST(rank AS INTEGER) AS rank,
       {R('cum * 100 / total')} AS cumulative_pct,
       ((cum - revenue) * 100 / total < 80 AND cum * 100 / total >= 80) AS crosses_80
FROM (SELECT customer_id, revenue,
             row_number() OVER (ORDER BY revenue DESC, customer_id ASC) AS rank,
             sum(revenue) OVER (ORDER BY revenue DESC, customer_id ASC ROWS UNBOUNDED PRECEDING) AS cum,
             sum(revenue) OVER () AS total
      FROM (SELECT customer_id, sum(revenue) AS revenue FROM feat WHERE customer_id IS NOT NULL GROUP BY 1))"""))
def q_pareto_customer(spark, sf_dir):
    """Pareto table of revenue by customer (high-cardinality key; WN1 on PX1)."""
    return rounded(OR.pareto(fact(spark, sf_dir, ["customer_id", "revenue", "order_date"]), "customer_id"),
                   6, {"revenue": 4})


@register("lorenz_curve", W(f"""
SELECT {R('revenue', 9)} AS revenue, {R('CAST(cn AS DOUBLE) / tn', 9)} AS population_share, {R('cs / ts', 9)} AS value_share
FROM (SELECT revenue, sum(n) OVER (ORDER BY revenue ROWS UNBOUNDED PRECEDING) AS cn,
             sum(s) OVER (ORDER BY revenue ROWS UNBOUNDED PRECEDING) AS cs,
             sum(n) OVER () AS tn, sum(s) OVER () AS ts
      FROM (SELECT revenue, count(*) AS n, sum(revenue) AS s FROM feat WHERE revenue IS NOT NULL GROUP BY 1))"""))
def q_lorenz_curve(spark, sf_dir):
    """Ascending Lorenz curve of order revenue, one point per distinct value (WN2)."""
    return rounded(OR.lorenz(fact(spark, sf_dir, ["revenue", "order_date"])), 9)


@register("gini", W(f"""
SELECT {R('2 * sa / (n * total) - (n + 1.0) / n', 9)} AS gini,
       {R('1 - 2 * ((sa / total - (mx / total + 1) / 2) / (n - 1))', 9)} AS reference_gini,
       n, {R('total', 2)} AS total
FROM (SELECT sum(revenue * (CAST(n AS DOUBLE) * (cn - n) + n * (n + 1.0) / 2)) AS sa,
             CAST(sum(n) AS BIGINT) AS n, sum(revenue * n) AS total, max(revenue) AS mx
      FROM (SELECT revenue, n, sum(n) OVER (ORDER BY revenue ROWS UNBOUNDED PRECEDING) AS cn
            FROM (SELECT revenue, count(*) AS n FROM feat WHERE revenue IS NOT NULL GROUP BY 1)))"""))
def q_gini(spark, sf_dir):
    """Gini of order revenue (standard) and the descending-curve variant (WN2)."""
    return rounded(OR.gini(fact(spark, sf_dir, ["revenue", "order_date"])), 9, {"total": 2})


_ECDF_COLS = ["revenue", "final_price", "units_sold"]


@register("ecdf", W(f"""
SELECT feature, {R('value', 9)} AS value, {R('CAST(cn AS DOUBLE) / tn', 9)} AS ecdf
FROM (SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cn,
             sum(n) OVER (PARTITION BY feature) AS tn
      FROM (SELECT feature, value, count(*) AS n FROM (
              {' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in _ECDF_COLS)})
            WHERE value IS NOT NULL GROUP BY 1, 2))"""))
def q_ecdf(spark, sf_dir):
    """Empirical CDF of revenue, final price and units (WN3)."""
    return rounded(OR.ecdf(fact(spark, sf_dir, [*_ECDF_COLS, "order_date"]), _ECDF_COLS), 9)


_MONTHLY_SQL = """
mon AS (SELECT year_month, sum(revenue) AS revenue FROM feat WHERE year_month IS NOT NULL GROUP BY 1)"""


@register("rolling_revenue", W(f"""
SELECT year_month, {R('revenue', 4)} AS revenue,
       {R('CASE WHEN count(revenue) OVER w = 3 THEN avg(revenue) OVER w END', 4)} AS rolling_mean,
       {R('CASE WHEN count(revenue) OVER w = 3 THEN stddev_samp(revenue) OVER w END', 4)} AS rolling_std
FROM mon WINDOW w AS (ORDER BY year_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", extra=_MONTHLY_SQL))
def q_rolling_revenue(spark, sf_dir):
    """Monthly revenue with centred 3-month rolling mean and std (WN4)."""
    m = SU.monthly_by(fact(spark, sf_dir, ["order_date", "revenue"]).withColumn("_all", F.lit(1)), "_all")
    return rounded(OR.rolling_stats(m.drop("_all"), "year_month", "revenue"), 4)


@register("mom_growth", W(f"""
SELECT year_month, {R('revenue', 4)} AS revenue, {R('prev', 4)} AS previous,
       {R('(revenue - prev) * 100 / NULLIF(prev, 0)', 6)} AS growth_pct
FROM (SELECT *, lag(revenue) OVER (ORDER BY year_month) AS prev FROM mon)""", extra=_MONTHLY_SQL))
def q_mom_growth(spark, sf_dir):
    """Month-over-month revenue growth (WN5)."""
    m = SU.monthly_by(fact(spark, sf_dir, ["order_date", "revenue"]).withColumn("_all", F.lit(1)), "_all")
    return rounded(OR.growth(m.drop("_all"), "year_month", "revenue"), 6, {"revenue": 4, "previous": 4})


@register("festival_months", W("""
SELECT month, count(*) AS count FROM feat WHERE sales_event = 'Festival' AND month IS NOT NULL
GROUP BY month ORDER BY count DESC, month ASC LIMIT 3"""))
def q_festival_months(spark, sf_dir):
    """Top-3 months by festival order count (TK4)."""
    df = fact(spark, sf_dir, ["order_date", "sales_event"])
    return SU.top_months(df, F.col("sales_event") == "Festival", 3)


@register("last_three_months", W(f"""
SELECT year_month, {R('revenue', 4)} AS revenue FROM mon ORDER BY year_month DESC LIMIT 3""",
    extra=_MONTHLY_SQL))
def q_last_three_months(spark, sf_dir):
    """The three latest months of the revenue series (WN7)."""
    m = SU.monthly_by(fact(spark, sf_dir, ["order_date", "revenue"]).withColumn("_all", F.lit(1)), "_all")
    return rounded(OR.last_k(m.drop("_all"), "year_month", 3), 4)


# ---------------------------------------------------------------- time series
from souk.operators import anomaly as AN  # noqa: E402
from souk.operators import insights as IN  # noqa: E402
from souk.operators import timeseries as TS  # noqa: E402

_SERIES_SQL = """
m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(revenue) AS value
      FROM feat WHERE order_date IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m),
s0 AS (SELECT sp.month, m.value, row_number() OVER (ORDER BY sp.month) AS i FROM sp LEFT JOIN m USING (month)),
s1 AS (SELECT *,
              last_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
              last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS)
                OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
              first_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
              first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS)
                OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
       FROM s0),
series AS (SELECT month,
                  CASE WHEN value IS NOT NULL THEN value WHEN ni IS NULL THEN pv
                       ELSE pv + (nv - pv) * (CAST(i - pi AS DOUBLE) / (ni - pi)) END AS value,
                  value IS NULL AS interpolated
           FROM s1)"""


@register("monthly_series", W(f"""
SELECT strftime(month, '%Y-%m') AS month, {R('value', 2)} AS value, interpolated FROM series""",
    extra=_SERIES_SQL))
def q_monthly_series(spark, sf_dir):
    """Gapless monthly revenue series with linear interpolation (TS1)."""
    s = TS.monthly_series(fact(spark, sf_dir, ["order_date", "revenue"]), "revenue", "sum")
    return rounded(s.withColumn("month", F.date_format("month", "yyyy-MM")), 2)


@register("seasonal_decomposition", W(f"""
SELECT strftime(t.month, '%Y-%m') AS month, {R('value', 2)} AS observed, {R('trend', 2)} AS trend,
       {R('seasonal', 2)} AS seasonal, {R('value - trend - seasonal', 2)} AS resid
FROM t JOIN (SELECT phase, pa - avg(pa) OVER () AS seasonal
             FROM (SELECT phase, avg(value - trend) AS pa FROM t GROUP BY phase)) p USING (phase)""",
    extra=_SERIES_SQL + """,
s2 AS (SELECT month, value, row_number() OVER (ORDER BY month) - 1 AS pos, count(*) OVER () AS n FROM series),
t AS (SELECT month, value, pos % 12 AS phase,
             CASE WHEN count(value) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
                  THEN (sum(value) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
                        - 0.5 * (lag(value, 6) OVER (ORDER BY month) + lead(value, 6) OVER (ORDER BY month))) / 12
             END AS trend
      FROM s2 WHERE n >= 24)"""))
def q_seasonal_decomposition(spark, sf_dir):
    """Additive decomposition of monthly revenue, period 12 (TS2)."""
    s = TS.monthly_series(fact(spark, sf_dir, ["order_date", "revenue"]), "revenue", "sum")
    d = TS.decompose(s, "month", "value", 12)
    return rounded(d.withColumn("month", F.date_format("month", "yyyy-MM")), 2)


# ---------------------------------------------------------------- anomaly
_RS_COLS = AN.SCALED_FEATURES


@register("robust_scaled", W(f"""
SELECT order_id, {', '.join(f"{R(f'({c} - med_{c}) / CASE WHEN q3_{c} - q1_{c} = 0 THEN 1.0 ELSE q3_{c} - q1_{c} END', 9)} AS rs_{c}" for c in _RS_COLS)}
FROM lf CROSS JOIN (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.75) AS q3_{c}, quantile_cont({c}, 0.25) AS q1_{c}" for c in _RS_COLS)} FROM lf) q""",
    extra="""
lf AS (SELECT order_id, CAST(customer_age AS DOUBLE) AS customer_age, ln(1 + greatest(base_price, 0)) AS log_base_price,
              discount_percent, ln(1 + greatest(final_price, 0)) AS log_final_price,
              ln(1 + greatest(CAST(units_sold AS DOUBLE), 0)) AS log_units_sold,
              ln(1 + greatest(revenue, 0)) AS log_revenue FROM feat)"""))
def q_robust_scaled(spark, sf_dir):
    """Median/IQR scaling of the six anomaly features (AN1)."""
    df = fact(spark, sf_dir, ["order_id", "customer_age", "base_price", "discount_percent", "final_price",
                              "units_sold", "revenue"])
    df = df.withColumn("customer_age", F.col("customer_age").cast("double"))
    s = AN.robust_scale(df, _RS_COLS)
    return rounded(s.select("order_id", *[f"rs_{c}" for c in _RS_COLS]), 9)


def _z_sql(threshold):
    cond = " OR ".join(
        f"COALESCE(abs(({c} - mu_{c}) / NULLIF(sd_{c}, 0)) > {threshold}, false)" for c in AN.ZSCORE_COLUMNS)
    stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in AN.ZSCORE_COLUMNS)
    return f"""
SELECT category, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS anomalies, count(*) AS orders,
       {R('sum(CASE WHEN flag THEN 1 ELSE 0 END) * 100.0 / count(*)')} AS anomaly_rate_pct
FROM (SELECT category, ({cond}) AS flag FROM feat CROSS JOIN (SELECT {stats} FROM feat) s) t
WHERE category IS NOT NULL GROUP BY category"""


for _thr, _nm in ((3.5, "zscore_anomalies_by_category"), (1.5, "zscore_anomalies_by_category_t15")):
    def _mkz(thr, name):
        @register(name, W(_z_sql(thr)))
        def q(spark, sf_dir):
            df = fact(spark, sf_dir, ["category", *AN.ZSCORE_COLUMNS, "order_date"])
            flagged = AN.zscore_flags(df, threshold=thr)
            return rounded(AN.anomalies_by(flagged, "zscore_anomaly", "category"), 6)
        q.__doc__ = f"Z-score anomalies (|z| > {thr}) per category with rate (AN2, AG17)."
        return q
    _mkz(_thr, _nm)


# ---------------------------------------------------------------- insights
_SUMMARY_COLS = ["revenue", "discount_percent", "sales_event", "brand_type", "competition_intensity",
                 "base_price", "final_price", "inventory_pressure", "category", "zone", "state", "order_date"]

_KPI_SQL = f"""
g AS (SELECT COALESCE(sum(revenue), 0) AS total_revenue, count(*) AS orders, avg(revenue) AS aov,
             avg(discount_percent) AS avg_discount,
             COALESCE(sum(CASE WHEN sales_event = 'Festival' THEN revenue END), 0) AS fest,
             COALESCE(sum(CASE WHEN brand_type = 'Premium' THEN revenue END), 0) AS prem,
             avg(CASE WHEN competition_intensity = 'High' THEN discount_percent END) AS hc_disc,
             COALESCE(sum(base_price - final_price), 0) AS disc_cost,
             COALESCE(sum(base_price), 0) AS base_price_total,
             sum(CASE WHEN inventory_pressure = 'High' THEN 1 ELSE 0 END) * 1.0 / count(*) AS high_pressure_share
      FROM feat),
tops AS (SELECT max(CASE WHEN dimension = 'category' THEN value END) AS top_category,
                max(CASE WHEN dimension = 'zone' THEN value END) AS top_zone,
                max(CASE WHEN dimension = 'state' THEN value END) AS top_state
         FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, value ASC) AS r
               FROM ({_union_dims(['category', 'zone', 'state'], 'sum(revenue) AS total')})) WHERE r = 1),
mg AS (SELECT CASE WHEN count(*) >= 2 THEN (max(CASE WHEN r = 1 THEN revenue END) - max(CASE WHEN r = 2 THEN revenue END)) * 100
                   / NULLIF(max(CASE WHEN r = 2 THEN revenue END), 0) END AS mom_growth
       FROM (SELECT *, row_number() OVER (ORDER BY year_month DESC) AS r FROM mon) WHERE r <= 2),
k AS (SELECT total_revenue, total_revenue / 1e7 AS revenue_cr, total_revenue / 84.0 / 1e6 AS revenue_usd_m,
             orders, aov AS avg_order_value, avg_discount,
             CASE WHEN total_revenue <> 0 THEN fest * 100 / total_revenue ELSE 0.0 END AS festival_revenue_pct,
             CASE WHEN total_revenue <> 0 THEN prem * 100 / total_revenue ELSE 0.0 END AS premium_revenue_pct,
             COALESCE(hc_disc, avg_discount) AS high_competition_discount,
             top_category, top_zone, top_state, mom_growth, disc_cost / 1e7 AS discount_cost_cr,
             base_price_total, high_pressure_share
      FROM g CROSS JOIN tops CROSS JOIN mg)"""


@register("executive_kpis", W(f"""
SELECT {R('total_revenue', 2)} AS total_revenue, {R('revenue_cr')} AS revenue_cr, {R('revenue_usd_m')} AS revenue_usd_m,
       orders, {R('avg_order_value')} AS avg_order_value, {R('avg_discount')} AS avg_discount,
       {R('festival_revenue_pct')} AS festival_revenue_pct, {R('premium_revenue_pct')} AS premium_revenue_pct,
       {R('high_competition_discount')} AS high_competition_discount, top_category, top_zone, top_state,
       {R('mom_growth')} AS mom_growth, {R('discount_cost_cr')} AS discount_cost_cr,
       {R('base_price_total', 2)} AS base_price_total, {R('high_pressure_share')} AS high_pressure_share
FROM k""", extra=_MONTHLY_SQL + "," + _KPI_SQL))
def q_executive_kpis(spark, sf_dir):
    """Executive KPI row: revenue (Cr, USD m), orders, AOV, shares, top keys, MoM (IN1)."""
    k = IN.summary_kpis(fact(spark, sf_dir, _SUMMARY_COLS))
    return rounded(k, 6, {"total_revenue": 2, "base_price_total": 2})


@register("executive_narrative", W(f"""
SELECT section, seq, text FROM (
  SELECT 'headline' AS section, 0 AS seq,
         printf('{texts.NARRATIVE["headline 0"]}', revenue_cr, format('{{:,}}', orders), top_category, top_zone) AS text FROM k
  UNION ALL SELECT 'insight', 1, printf('{texts.NARRATIVE["insight 1"]}', top_category) FROM k
  UNION ALL SELECT 'insight', 2, printf('{texts.NARRATIVE["insight 2"]}', top_zone) FROM k
  UNION ALL SELECT 'insight', 3, printf('{texts.NARRATIVE["insight 3"]}', festival_revenue_pct) FROM k
  UNION ALL SELECT 'insight', 4, printf('{texts.NARRATIVE["insight 4"]}', avg_discount, discount_cost_cr) FROM k
  UNION ALL SELECT 'insight', 5, printf('{texts.NARRATIVE["insight 5"]}', premium_revenue_pct, CASE WHEN premium_revenue_pct > 40 THEN 'is strong' ELSE 'has room to grow' END) FROM k
  UNION ALL SELECT 'insight', 6, printf('{texts.NARRATIVE["insight 6"]}', CASE WHEN mom_growth > 0 THEN 'growing' ELSE 'declining' END, mom_growth) FROM k WHERE mom_growth IS NOT NULL
  UNION ALL SELECT 'risk', 1, printf('{texts.NARRATIVE["risk 1"]}', avg_discount) FROM k WHERE avg_discount > 35
  UNION ALL SELECT 'risk', 2, printf('{texts.NARRATIVE["risk 2"]}', festival_revenue_pct) FROM k WHERE festival_revenue_pct > 50
  UNION ALL SELECT 'risk', 3, printf('{texts.NARRATIVE["risk 3"]}', high_competition_discount) FROM k WHERE high_competition_discount > avg_discount + 10
  UNION ALL SELECT 'risk', 4, printf('{texts.NARRATIVE["risk 4"]}', mom_growth) FROM k WHERE mom_growth < -5
  UNION ALL SELECT 'risk', 5, '{texts.NARRATIVE["risk 5"]}' FROM k
    WHERE NOT (avg_discount > 35 OR festival_revenue_pct > 50 OR high_competition_discount > avg_discount + 10 OR COALESCE(mom_growth < -5, false))
  UNION ALL SELECT 'opportunity', 1, printf('{texts.NARRATIVE["opportunity 1"]}', base_price_total * 0.05 / 1e7) FROM k WHERE avg_discount > 25
  UNION ALL SELECT 'opportunity', 2, printf('{texts.NARRATIVE["opportunity 2"]}', premium_revenue_pct) FROM k WHERE premium_revenue_pct < 40
  UNION ALL SELECT 'opportunity', 3, printf('{texts.NARRATIVE["opportunity 3"]}',
                  (SELECT string_agg(zone, ' & ' ORDER BY rev, zone) FROM (SELECT zone, sum(revenue) AS rev FROM feat WHERE zone IS NOT NULL GROUP BY zone ORDER BY rev, zone LIMIT 2))) FROM k
  UNION ALL SELECT 'opportunity', 4, '{texts.NARRATIVE["opportunity 4"]}' FROM k WHERE high_pressure_share > 0.4
) x""", extra=_MONTHLY_SQL + "," + _KPI_SQL))
def q_executive_narrative(spark, sf_dir):
    """Headline, insight, risk and opportunity texts (IN2, IN3)."""
    return IN.narrative(fact(spark, sf_dir, _SUMMARY_COLS))


@register("elastic_categories", W(f"""
SELECT category, {R('c')} AS corr, {R('bp', 2)} AS base_price_total FROM (
  SELECT category, count(*) AS n,
         covar_samp(CASE WHEN discount_percent IS NOT NULL AND units_sold IS NOT NULL THEN discount_percent END,
                    CASE WHEN discount_percent IS NOT NULL AND units_sold IS NOT NULL THEN units_sold END)
         / NULLIF(stddev_samp(CASE WHEN discount_percent IS NOT NULL AND units_sold IS NOT NULL THEN discount_percent END)
                  * stddev_samp(CASE WHEN discount_percent IS NOT NULL AND units_sold IS NOT NULL THEN units_sold END), 0) AS c,
         COALESCE(sum(base_price), 0) AS bp
  FROM feat WHERE category IS NOT NULL GROUP BY category) t
WHERE n >= 30 AND c > 0.1"""))
def q_elastic_categories(spark, sf_dir):
    """Categories whose units rise with discount (corr > 0.1, n >= 30) (IN4)."""
    df = fact(spark, sf_dir, ["category", "discount_percent", "units_sold", "base_price", "order_date"])
    return rounded(IN.elastic_categories(df), 6, {"base_price_total": 2})


@register("recommendations", W(f"""
SELECT CAST(row_number() OVER (ORDER BY rnk, seq) AS INTEGER) AS position, priority, category, action, impact, effort, metric
FROM (
  SELECT 0 AS rnk, 3 AS seq, 'High' AS priority, 'Inventory' AS category,
         printf('{texts.RECOMMENDATIONS["action 3"]}', '[' || string_agg(CAST(month AS VARCHAR), ', ' ORDER BY cnt DESC, month) || ']') AS action,
         '{texts.RECOMMENDATIONS["impact 3"]}' AS impact, 'Medium' AS effort, 'Inventory pressure %' AS metric
  FROM (SELECT month, count(*) AS cnt FROM feat WHERE sales_event = 'Festival' AND month IS NOT NULL GROUP BY month ORDER BY cnt DESC, month LIMIT 3)
  HAVING count(*) > 0
  UNION ALL
  SELECT 1, 4, 'Medium', 'Growth',
         printf('{texts.RECOMMENDATIONS["action 4"]}', b.zone, b.rev * 100 / NULLIF(t.rev, 0), t.zone),
         '{texts.RECOMMENDATIONS["impact 4"]}', 'Medium', 'Zone revenue share'
  FROM (SELECT zone, sum(revenue) AS rev FROM feat WHERE zone IS NOT NULL GROUP BY zone ORDER BY rev ASC, zone LIMIT 1) b,
       (SELECT zone, sum(revenue) AS rev FROM feat WHERE zone IS NOT NULL GROUP BY zone ORDER BY rev DESC, zone LIMIT 1) t
  UNION ALL
  SELECT 1, 5, 'Medium', 'Revenue Mix', '{texts.RECOMMENDATIONS["action 5"]}',
         printf('{texts.RECOMMENDATIONS["impact 5"]}', p), 'Low', 'Premium revenue %'
  FROM (SELECT sum(CASE WHEN brand_type = 'Premium' THEN 1 ELSE 0 END) * 100.0 / count(*) AS p FROM feat) WHERE p < 45
  UNION ALL
  SELECT 2, 6, 'Low', 'Retention', '{texts.RECOMMENDATIONS["action 6"]}',
         '{texts.RECOMMENDATIONS["impact 6"]}', 'High', 'Repeat purchase rate'
  UNION ALL
  SELECT 1, 7, 'Medium', 'Competitive', '{texts.RECOMMENDATIONS["action 7"]}',
         '{texts.RECOMMENDATIONS["impact 7"]}', 'Medium', 'Discount % in high-competition segments'
  FROM (SELECT sum(CASE WHEN competition_intensity = 'High' THEN 1 ELSE 0 END) * 1.0 / count(*) AS s FROM feat) WHERE s > 0.3
  UNION ALL
  SELECT 0, r, 'High', 'Pricing', printf('{texts.RECOMMENDATIONS["action pricing"]}', category),
         printf('{texts.RECOMMENDATIONS["impact pricing"]}', bp * 0.06 / 1e7), 'Low', 'Avg discount %'
  FROM (SELECT category, bp, row_number() OVER (ORDER BY c DESC, category) AS r FROM (
          SELECT category, count(*) AS n, corr(discount_percent, units_sold) AS c, sum(base_price) AS bp
          FROM feat WHERE category IS NOT NULL GROUP BY category) WHERE n >= 30 AND c > 0.1)
  WHERE r <= 2 AND (SELECT avg(discount_percent) FROM feat) > 30
) x"""))
def q_recommendations(spark, sf_dir):
    """Prioritised recommendation list (IN5, TK7)."""
    df = fact(spark, sf_dir, ["discount_percent", "brand_type", "competition_intensity", "sales_event",
                              "zone", "revenue", "category", "units_sold", "base_price", "order_date"])
    return IN.recommendations(df)


# ---------------------------------------------------------------- models (no SQL twin)
from souk.operators import ml as ML  # noqa: E402

_ML_COLS = [*ML.CAT_FEATURES, "customer_age", "base_price", "discount_percent", "revenue", "order_date",
            "order_id", "units_sold"]


@register("linear_model_metrics")
def q_linear_model_metrics(spark, sf_dir):
    """Standardised + one-hot linear regression of revenue, test RMSE/MAE/R2 on
    an 80/20 hash split (ML1-ML4)."""
    df = fact(spark, sf_dir, _ML_COLS)
    return rounded(ML.compare_models(df, ["order_id", "order_date", "units_sold", "revenue", "base_price"],
                                     names=["Linear Regression"]), 6)


@register("prediction_drift")
def q_prediction_drift(spark, sf_dir):
    """Boosted-tree prediction drift between reference and current windows (DR4)."""
    df = fact(spark, sf_dir, ["order_date", "revenue", "category", "zone", "brand_type", "sales_event",
                              "base_price", "discount_percent", "units_sold"])
    return ML.prediction_drift(df)


@register("revenue_forecast_by_zone")
def q_revenue_forecast_by_zone(spark, sf_dir):
    """Monthly revenue per zone with a 60-month trend + seasonality forecast
    and 80 % band (TS3)."""
    s = TS.monthly_series(fact(spark, sf_dir, ["order_date", "zone", "revenue"]), "revenue", "sum", by=["zone"])
    return TS.forecast(s, "month", "value", periods=60, by=["zone"], growth="piecewise")


_AN_COLS = ["order_id", "category", "customer_age", "base_price", "discount_percent", "final_price",
            "units_sold", "revenue"]


def _scored_orders(spark, sf_dir, written=None):
    df = fact(spark, sf_dir, _AN_COLS).withColumn("customer_age", F.col("customer_age").cast("double"))
    rs = AN.robust_scale(df, _RS_COLS)
    # only the columns the detectors and the per-category summary need travel
    # through the Python scorer
    keep = ["order_id", "category", *AN.ZSCORE_COLUMNS, "base_price", *[f"rs_{c}" for c in _RS_COLS]]
    return AN.isolation_forest(rs.select(*dict.fromkeys(keep)), [f"rs_{c}" for c in _RS_COLS],
                               key_cols=["order_id", "base_price", "units_sold", "discount_percent"], keep=written)


@register("isolation_forest_by_category")
def q_isolation_forest_by_category(spark, sf_dir):
    """Isolation-forest anomalies (150 trees, 0.8 % contamination) per category (AN3, AG17)."""
    return AN.anomalies_by(_scored_orders(spark, sf_dir, ["category"]), "is_anomaly", "category")


@register("anomaly_votes_by_category")
def q_anomaly_votes_by_category(spark, sf_dir):
    """Votes of isolation forest, z-score at 3.5 and DBSCAN noise (eps 0.5, 10 rows); orders confirmed by two per category
    (AN4, AN5, AG17)."""
    from souk.operators import density as DE
    scored = AN.zscore_flags(_scored_orders(spark, sf_dir), threshold=3.5)
    v = AN.votes(DE.dbscan(scored, [f"rs_{c}" for c in _RS_COLS], labels=False), min_votes=2)
    return AN.anomalies_by(v, "confirmed_anomaly", "category")


@register("violin_final_price_by_category", W(f"""
SELECT pts.category, {R('x', 9)} AS x,
       {R('sum(CAST(c AS DOUBLE) * exp(-0.5 * ((x - m) / bw) * ((x - m) / bw)) / (n * bw * 2.5066282746310002))', 12)} AS density
FROM pts JOIN centres USING (category)
GROUP BY pts.category, x""", extra="""
vb AS (SELECT category, CAST(final_price AS DOUBLE) AS vx FROM feat
       WHERE category IS NOT NULL AND final_price IS NOT NULL),
vst AS (SELECT category, min(vx) AS lo, max(vx) AS hi, count(*) AS n,
               stddev_samp(vx) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw FROM vb GROUP BY category),
binned AS (SELECT category, COALESCE(least(floor((vx - lo) / NULLIF((hi - lo) / 1000, 0)), 999), 0) AS bin,
                  count(*) AS c
           FROM vb JOIN vst USING (category) GROUP BY 1, 2),
centres AS (SELECT category, lo + (bin + 0.5) * ((hi - lo) / 1000) AS m, c, n, bw FROM binned JOIN vst USING (category)),
pts AS (SELECT category, lo + (hi - lo) * gi / 99 AS x FROM vst CROSS JOIN range(0, 100) t(gi))"""))
def q_violin_final_price_by_category(spark, sf_dir):
    """Binned Gaussian KDE of final price per category, 100 grid points (AG9)."""
    v = SU.violin_density(fact(spark, sf_dir, ["category", "final_price", "order_date"]),
                          "category", "final_price")
    return rounded(v, 9, {"density": 12})


@register("attention_counts", W("""
SELECT (SELECT CAST(sum(CASE WHEN risk_label = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) FROM scored) AS critical_customers,
       (SELECT CAST(sum(CASE WHEN alert_level IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END) AS BIGINT) FROM al) AS urgent_inventory_groups,
       (SELECT CAST(COALESCE(sum(CASE WHEN psi > 0.2 OR ks_p_value < 0.05 THEN 1 ELSE 0 END), 0) AS BIGINT) FROM res) AS drifted_features""",
    extra=_CUST_FEATURES_SQL + "," + _ALERT_SQL + "," + _DRIFT_SQL))
def q_attention_counts(spark, sf_dir):
    """Critical customers, CRITICAL/HIGH inventory groups, drifted features (AG22)."""
    df = fact(spark, sf_dir, ["customer_id", "order_date", "revenue", "discount_percent", "category", "zone",
                              "units_sold", "inventory_pressure", "base_price", "final_price"])
    scored = CU.churn_scores(CU.customer_features(df))
    return IN.attention_counts(scored, IV.alerts(df), DR.feature_drift(df))


@register("revenue_sarima_forecast_by_zone")
def q_revenue_sarima_forecast_by_zone(spark, sf_dir):
    """Seasonal ARIMA(1,1,1)(1,1,1)12 60-month forecast per zone with 80 % band (TS4)."""
    s = TS.monthly_series(fact(spark, sf_dir, ["order_date", "zone", "revenue"]), "revenue", "sum", by=["zone"])
    return TS.seasonal_arima_forecast(s, "month", "value", periods=60, by=["zone"])


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """Permutation importance (7 repeats) of the 14 inputs of the linear revenue
    model on the 20 % hash-split test set (ML7)."""
    df = fact(spark, sf_dir, _ML_COLS)
    keyed = df.select("order_id", "order_date", "units_sold", *ML.CAT_FEATURES, *ML.NUM_FEATURES, "revenue")
    key = ["order_id", "order_date", "units_sold", "revenue", "base_price"]
    train, test = ML.split(keyed, key)
    model = ML.fit(ML.model_input(train), ML.regressors()["Linear Regression"])
    test = test.select(*key, *[c for c in ML.CAT_FEATURES + ML.NUM_FEATURES if c not in key])
    test = test.withColumns({c: F.col(c).cast("double") for c in ML.NUM_FEATURES + ["revenue"]})
    return ML.permutation_importance(model, test, [*ML.CAT_FEATURES, *ML.NUM_FEATURES], key)


from souk.operators import lifetime as LT  # noqa: E402


@register("bgnbd_clv")
def q_bgnbd_clv(spark, sf_dir):
    """Model-based CLV: BG/NBD expected purchases x Gamma-Gamma value x margin,
    12-month horizon, with quartile tiers (CU6)."""
    df = fact(spark, sf_dir, ["customer_id", "order_date", "revenue"])
    return LT.bgnbd_clv(df).drop("model_params")


from souk.plans import more  # noqa: E402,F401  (registers its queries)

"""Price elasticity and discount optimisation (PR1-PR5, JN5).

The per-group log-log OLS is a declarative aggregate (``regr_*`` functions,
partial aggregation map-side) -- no per-group Python loop.  Only the slope's
p-value uses a vectorised UDF, on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import texts
from souk.functions import safe_div, np_round
from souk.functions.stats import t_pvalue_udf


def elasticity(df: DataFrame, group_cols: Sequence[str] = ("category",),
               price_col: str = "final_price", qty_col: str = "units_sold",
               min_obs: int = 50, precheck: bool = True, with_pvalue: bool = False,
               digits: int | None = 4) -> DataFrame:
    """Log-log price elasticity per group: slope of ln(qty) on ln(price), r2,
    n_obs (rows with price > 0 and qty > 0) and optionally the two-sided
    p-value of the slope.

    ``precheck`` also requires ``min_obs`` rows before the positivity filter.
    Groups whose log price is constant have no slope and are dropped; r2 is
    NULL when ln(qty) is constant.  Results are rounded to ``digits``.
    """
    g = list(group_cols)
    p, q = F.col(price_col), F.col(qty_col)
    pos = (p > 0) & (q > 0)
    lp = F.when(pos, F.ln(p.cast("double")))
    lq = F.when(pos, F.ln(q.cast("double")))
    keys_ok = F.lit(True)
    for c in g:
        keys_ok = keys_ok & F.col(c).isNotNull()
    agg = (df.where(keys_ok).groupBy(*g)
             .agg(F.count(F.lit(1)).alias("_rows"),
                  F.count(lq).alias("n_obs"),
                  F.regr_slope(lq, lp).alias("_slope"),
                  F.regr_sxx(lq, lp).alias("_sxx"),
                  F.regr_syy(lq, lp).alias("_syy")))
    keep = (F.col("n_obs") >= min_obs) & (F.col("_sxx") > 0)
    if precheck:
        keep = keep & (F.col("_rows") >= min_obs)
    out = agg.where(keep)
    slope = F.col("_slope")
    # r2 = slope^2 * sxx / syy (NULL when syy = 0)
    r2 = safe_div(slope * slope * F.col("_sxx"), F.col("_syy"))
    cols = [*g, slope.alias("elasticity"), r2.alias("r2"), F.col("n_obs").cast("long").alias("n_obs")]
    if with_pvalue:
        dof = F.col("n_obs") - 2
        sse = F.greatest(F.col("_syy") - slope * slope * F.col("_sxx"), F.lit(0.0))
        se = F.sqrt(safe_div(safe_div(sse, dof), F.col("_sxx")))
        t = safe_div(slope, se)
        t = F.when(se == 0, F.lit(float("inf"))).otherwise(t)
        cols.append(t_pvalue_udf(t, dof.cast("double")).alias("p_value"))
    res = out.select(*cols)
    if digits is not None:
        res = res.select(*g, *[np_round(c, digits).alias(c) if c in ("elasticity", "r2", "p_value") else F.col(c)
                              for c in res.columns if c not in g])
    return res


def elasticity_class(e="elasticity"):
    """Elastic (< -1), inelastic (-1 .. 0) or Giffen/luxury (>= 0) (PR2)."""
    e = F.col(e)
    return (F.when(e < -1, texts.ELASTICITY_CLASSES["elastic"]).when(e < 0, texts.ELASTICITY_CLASSES["inelastic"])
             .otherwise(texts.ELASTICITY_CLASSES["giffen"]))


def discount_advice(e="elasticity"):
    e = F.col(e)
    return (F.when(e < -1, texts.DISCOUNT_ADVICE["elastic"])
             .when(e < 0, texts.DISCOUNT_ADVICE["inelastic"])
             .otherwise(texts.DISCOUNT_ADVICE["giffen"]))


def with_classes(el: DataFrame) -> DataFrame:
    return el.withColumns({"elasticity_type": elasticity_class(), "advice": discount_advice()})


def optimal_discount(e, current, max_discount: float = 60.0) -> dict:
    """Revenue-maximising discount for an elasticity and current discount (PR4),
    as column expressions: optimal_discount, direction, revenue_impact_pct,
    rationale."""
    e, d = F.col(e) if isinstance(e, str) else e, F.col(current) if isinstance(current, str) else current
    a = F.abs(e)
    elastic_opt = F.least(d * safe_div(a, a - 0.5), F.lit(max_discount))
    inelastic_opt = F.greatest(d * 0.8, F.lit(0.0))
    opt = F.when(e >= 0, d).when(a > 1, elastic_opt).otherwise(inelastic_opt)
    direction = (F.when(e >= 0, "hold")
                  .when(a > 1, F.when(elastic_opt > d, "increase").otherwise("hold"))
                  .otherwise("decrease"))
    # percent of revenue: each point of discount moved is worth the elasticity's distance from one
    impact = F.when(e >= 0, F.lit(0.0)).otherwise((a - 1) * (F.when(a > 1, elastic_opt).otherwise(inelastic_opt) - d))
    rationale = (F.when(e >= 0, F.lit(texts.DISCOUNT_RATIONALE["giffen"]))
                  .otherwise(F.format_string(texts.DISCOUNT_RATIONALE["other"], e,
                                             F.when(a > 1, texts.DISCOUNT_RATIONALE["elastic"])
                                              .otherwise(texts.DISCOUNT_RATIONALE["inelastic"]))))
    return {
        "optimal_discount": np_round(F.least(F.greatest(opt, F.lit(0.0)), F.lit(max_discount)), 1),
        "direction": direction,
        "revenue_impact_pct": np_round(impact, 1),
        "rationale": rationale,
    }


def price_recommendations(df: DataFrame, min_obs: int = 30, default_discount: float = 30.0) -> DataFrame:
    """Per-category recommendation (PR5): elasticity (min_obs after the
    positivity filter) left-joined with the category's mean discount
    (default 30), optimal discount, change, direction, impact; sorted by
    impact descending."""
    el = elasticity(df, ["category"], min_obs=min_obs, precheck=False, with_pvalue=False)
    disc = (df.where(F.col("category").isNotNull()).groupBy("category")
              .agg(F.avg("discount_percent").alias("_cur")))
    j = el.join(disc, "category", "left").withColumn("_cur", F.coalesce(F.col("_cur"), F.lit(default_discount)))
    o = optimal_discount("elasticity", F.col("_cur"))
    out = j.select("category",
                   np_round(F.col("_cur"), 1).alias("current_discount"),
                   o["optimal_discount"].alias("optimal_discount"),
                   np_round(o["optimal_discount"] - F.col("_cur"), 1).alias("change"),
                   o["direction"].alias("direction"),
                   "elasticity",
                   o["revenue_impact_pct"].alias("revenue_impact_pct"),
                   o["rationale"].alias("rationale"))
    return out.orderBy(F.col("revenue_impact_pct").desc(), F.col("category").asc())


def total_impact(recs: DataFrame) -> DataFrame:
    return recs.agg(F.coalesce(F.sum("revenue_impact_pct"), F.lit(0.0)).alias("total_revenue_impact_pct"))

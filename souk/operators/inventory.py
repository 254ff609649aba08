"""Inventory health and alerts per category x zone (IV1-IV4, AG14).

One aggregate over the fact; thresholds (percentiles and max over the group
table) are a one-row table cross-joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import texts
from souk.functions import safe_div, np_round
from souk.operators.customers import _named_quantiles
from souk.operators.features import group_label
from souk.operators.ordered import materialize

# Fixed thresholds of the alert rules.
VELOCITY_HIGH_PCTILE = 0.80
VELOCITY_LOW_PCTILE = 0.20
CRITICAL_PRESSURE_PCT = 60.0
HIGH_PRESSURE_PCT = 30.0
CLEARANCE_DISCOUNT = 45.0
CLEARANCE_PRESSURE_PCT = 50.0
LOW_STOCK_PRESSURE = "High"

ALERT_LEVELS = ["CRITICAL", "HIGH", "CLEARANCE", "SLOW_MOVER", "HEALTHY"]


def group_health(df: DataFrame, rows: str = "category", cols: str = "zone") -> DataFrame:
    """avg/total units, avg discount, orders, high-pressure %, avg revenue (IV1)."""
    keys = F.col(rows).isNotNull() & F.col(cols).isNotNull()
    return (df.where(keys).groupBy(rows, cols)
            .agg(F.avg("units_sold").alias("avg_units_sold"),
                 F.coalesce(F.sum("units_sold"), F.lit(0)).cast("long").alias("total_units"),
                 F.avg("discount_percent").alias("avg_discount"),
                 F.count("revenue").alias("n_orders"),
                 (F.avg(F.when(F.col("inventory_pressure") == LOW_STOCK_PRESSURE, 1.0).otherwise(0.0)) * 100)
                 .alias("high_pressure_pct"),
                 F.avg("revenue").alias("avg_revenue")))


def alerts(df: DataFrame, rows: str = "category", cols: str = "zone",
           velocity_high: float = VELOCITY_HIGH_PCTILE, velocity_low: float = VELOCITY_LOW_PCTILE,
           critical_pressure: float = CRITICAL_PRESSURE_PCT, high_pressure: float = HIGH_PRESSURE_PCT,
           clearance_discount: float = CLEARANCE_DISCOUNT,
           clearance_pressure: float = CLEARANCE_PRESSURE_PCT) -> DataFrame:
    """Group health + velocity score + alert level + recommendation, sorted by
    level then velocity descending (IV1-IV3)."""
    g = materialize(group_health(df, rows, cols))
    th = _named_quantiles(g, {"_vhi": ("avg_units_sold", velocity_high),
                              "_vlo": ("avg_units_sold", velocity_low)})
    mx = g.agg(F.max("avg_units_sold").alias("_vmax"))
    x = g.crossJoin(F.broadcast(th)).crossJoin(F.broadcast(mx))
    u, hp, disc = F.col("avg_units_sold"), F.col("high_pressure_pct"), F.col("avg_discount")
    level = (F.when((u >= F.col("_vhi")) & (hp >= critical_pressure), "CRITICAL")
              .when((u >= F.col("_vhi")) & (hp >= high_pressure), "HIGH")
              .when((disc >= clearance_discount) & (hp >= clearance_pressure), "CLEARANCE")
              .when(u < F.col("_vlo"), "SLOW_MOVER")
              .otherwise("HEALTHY"))
    x = x.withColumns({
        "velocity_score": np_round(safe_div(u, F.col("_vmax")) * 100, 1),
        "alert_level": level,
    })
    r, c = F.col(rows), F.col(cols)
    lvl = F.col("alert_level")
    rec = (F.when(lvl == "CRITICAL", F.format_string(texts.ALERT_TEXTS["CRITICAL"], r, c))
            .when(lvl == "HIGH", F.format_string(texts.ALERT_TEXTS["HIGH"], r, c))
            .when(lvl == "CLEARANCE", F.format_string(texts.ALERT_TEXTS["CLEARANCE"], r, c))
            .when(lvl == "SLOW_MOVER", F.format_string(texts.ALERT_TEXTS["SLOW_MOVER"], r, c))
            .otherwise(F.lit(texts.ALERT_TEXTS["HEALTHY"])))
    out = x.withColumn("recommendation", rec).drop("_vhi", "_vlo", "_vmax")
    return out.orderBy(F.col("alert_level").asc(), F.col("velocity_score").desc(), r.asc(), c.asc())


def urgent_groups(alert_table: DataFrame, k: int = 15, rows: str = "category", cols: str = "zone") -> DataFrame:
    """CRITICAL / HIGH groups, first ``k`` in alert order, with a label (IV4)."""
    return (alert_table.where(F.col("alert_level").isin("CRITICAL", "HIGH"))
            .orderBy(F.col("alert_level").asc(), F.col("velocity_score").desc(), F.col(rows), F.col(cols))
            .limit(k)
            .withColumn("group", group_label(rows, cols)))

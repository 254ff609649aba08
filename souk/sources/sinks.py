"""Result sinks (SK1-SK6): persisted result tables with fixed schemas,
CSV/JSON exports and a multi-table report folder.

Writes are distributed (one file per task); appends partitioned by run date
let readers prune old runs.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.schema import AT_RISK_ALERT_SCHEMA, DRIFT_REPORT_SCHEMA, PRICE_RECOMMENDATION_SCHEMA


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast to the sink schema; missing columns become NULL,
    ``created_at`` defaults to the current time."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "created_at":
            cols.append(F.current_timestamp().cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_table(df: DataFrame, path: str, schema, fmt: str = "parquet") -> None:
    """Append rows conforming to ``schema`` partitioned by run date."""
    out = conform(df, schema).withColumn("run_date", F.to_date("created_at"))
    out.write.mode("append").partitionBy("run_date").format(fmt).save(path)


def save_price_recommendations(recs: DataFrame, path: str) -> None:
    """SK1."""
    append_table(recs, path, PRICE_RECOMMENDATION_SCHEMA)


def save_at_risk_alerts(alerts: DataFrame, path: str) -> None:
    """SK3: alert list with the sink's column names."""
    renamed = alerts.withColumnRenamed("days_since_last_order", "days_since_order")
    if "alert_generated_at" in renamed.columns:
        renamed = renamed.withColumnRenamed("alert_generated_at", "created_at")
    append_table(renamed, path, AT_RISK_ALERT_SCHEMA)


def save_drift_report(report: DataFrame, path: str) -> None:
    """SK2: the one-row drift summary (see ``operators.drift.drift_report``)."""
    append_table(report, path, DRIFT_REPORT_SCHEMA)


def export_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """SK4: CSV with header."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def export_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """SK6: JSON lines (the records form of a result table)."""
    df.write.mode("overwrite").option("compression", compression).json(path)


def export_report(path: str, kpis: DataFrame, insights: DataFrame, recommendations: DataFrame,
                  data: DataFrame, monthly: DataFrame, data_cap: int | None = None) -> None:
    """SK5: one report folder with five tables (Parquet): KPI row, insight
    texts, recommendations, all data rows and the monthly table.  Only a caller
    whose report format has a row limit passes ``data_cap``."""
    base = path.rstrip("/")
    kpis.write.mode("overwrite").parquet(f"{base}/kpis")
    insights.write.mode("overwrite").parquet(f"{base}/insights")
    recommendations.write.mode("overwrite").parquet(f"{base}/recommendations")
    data = data if data_cap is None else data.limit(data_cap)
    data.write.mode("overwrite").parquet(f"{base}/data")
    monthly.write.mode("overwrite").parquet(f"{base}/monthly")

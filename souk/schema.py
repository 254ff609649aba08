"""Explicit schemas of the order fact and of the persisted result tables.

Fixed values: column names, order and types are those of the files and tables.
"""

from pyspark.sql import types as T

# Raw order file as landed (order_date still text; it is parsed in cleaning).
RAW_ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand_type", T.StringType()),
    T.StructField("customer_gender", T.StringType()),
    T.StructField("customer_age", T.IntegerType()),
    T.StructField("base_price", T.DoubleType()),
    T.StructField("discount_percent", T.DoubleType()),
    T.StructField("sales_event", T.StringType()),
    T.StructField("competition_intensity", T.StringType()),
    T.StructField("inventory_pressure", T.StringType()),
    T.StructField("units_sold", T.IntegerType()),
    T.StructField("final_price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])

# Column sets used across analytics.
DIMENSIONS = ["category", "zone", "brand_type", "sales_event",
              "competition_intensity", "inventory_pressure"]
MEASURES = ["revenue", "final_price", "units_sold", "discount_percent"]
DRIFT_FEATURES = ["base_price", "discount_percent", "final_price", "units_sold", "revenue"]

# Persisted result tables (column order and types of the sink DDL).
PRICE_RECOMMENDATION_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("current_discount", T.DoubleType()),
    T.StructField("optimal_discount", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("revenue_impact_pct", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

AT_RISK_ALERT_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("churn_risk_score", T.DoubleType()),
    T.StructField("risk_label", T.StringType()),
    T.StructField("value_tier", T.StringType()),
    T.StructField("days_since_order", T.IntegerType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

DRIFT_REPORT_SCHEMA = T.StructType([
    T.StructField("features_drifted", T.IntegerType()),
    T.StructField("max_psi", T.DoubleType()),
    T.StructField("pred_r2_drop", T.DoubleType()),
    T.StructField("drift_alert", T.BooleanType()),
    T.StructField("report_json", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

"""Enrichment joins of the order fact with macro, FX and search-trend tables
(JN2, JN3, PJ10, PJ13) and the state -> ISO code mapping (PJ15).

All right-hand tables are small by construction (one row per year, one row,
one row per month, 32 states); each is aggregated to one row per join key
before the join so that no order row is duplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import np_round


def with_macro(orders: DataFrame, macro: DataFrame) -> DataFrame:
    """Left join on year (JN2); an empty macro table gives NULL columns.
    The macro table is reduced to one row per year first (the smallest known
    value where a year repeats; bounded by the number of years), then broadcast."""
    cols = [c for c in macro.columns if c != "year"]
    one = macro.groupBy("year").agg(*[F.min(c).alias(c) for c in cols])
    return orders.join(F.broadcast(one), "year", "left")


def with_fx(orders: DataFrame, rate: DataFrame) -> DataFrame:
    """USD conversion with the one-row rate table (PJ10): revenue_usd 2 dp,
    final_price_usd 4 dp."""
    return (orders.crossJoin(F.broadcast(rate.select("usd_inr_rate").limit(1)))
            .withColumns({"revenue_usd": np_round(F.col("revenue") / F.col("usd_inr_rate"), 2),
                          "final_price_usd": np_round(F.col("final_price") / F.col("usd_inr_rate"), 4)}))


def monthly_interest(trends_long: DataFrame) -> DataFrame:
    """Mean interest over keywords per date (NULLs skipped), then one value per
    month (PJ13): (year_month, ecommerce_search_interest)."""
    per_date = trends_long.groupBy("date").agg(F.avg("interest").alias("_i"))
    return (per_date.groupBy(F.date_format("date", "yyyy-MM").alias("year_month"))
            .agg(F.avg("_i").alias("ecommerce_search_interest")))


def with_trends(orders: DataFrame, trends_long: DataFrame) -> DataFrame:
    """Left join of the monthly search interest on year_month (JN3).

    Trend dates are aggregated to one row per month before the join, so the
    order row count is preserved (joining per-date rows on the month would
    repeat each order once per trend date in its month).
    """
    return orders.join(F.broadcast(monthly_interest(trends_long)), "year_month", "left")


# State name -> ISO 3166-2:IN code used by the choropleth.
STATE_ISO = [
    ("Andhra Pradesh", "IN-AP"), ("Arunachal Pradesh", "IN-AR"), ("Assam", "IN-AS"),
    ("Bihar", "IN-BR"), ("Chhattisgarh", "IN-CT"), ("Goa", "IN-GA"), ("Gujarat", "IN-GJ"),
    ("Haryana", "IN-HR"), ("Himachal Pradesh", "IN-HP"), ("Jharkhand", "IN-JH"),
    ("Karnataka", "IN-KA"), ("Kerala", "IN-KL"), ("Madhya Pradesh", "IN-MP"),
    ("Maharashtra", "IN-MH"), ("Manipur", "IN-MN"), ("Meghalaya", "IN-ML"), ("Mizoram", "IN-MZ"),
    ("Nagaland", "IN-NL"), ("Odisha", "IN-OR"), ("Punjab", "IN-PB"), ("Rajasthan", "IN-RJ"),
    ("Sikkim", "IN-SK"), ("Tamil Nadu", "IN-TN"), ("Telangana", "IN-TG"), ("Tripura", "IN-TR"),
    ("Uttar Pradesh", "IN-UP"), ("Uttarakhand", "IN-UT"), ("West Bengal", "IN-WB"),
    ("Delhi", "IN-DL"), ("Delhi NCR", "IN-DL"), ("Jammu and Kashmir", "IN-JK"), ("Ladakh", "IN-LA"),
]


def state_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_ISO, "state string, iso_code string")


def state_revenue_map(df: DataFrame, top: int | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Revenue per state with its ISO code; unmapped states dropped (PJ15).
    The 32-row code table is broadcast; ``codes`` (state, iso_code) replaces it.  ``top`` keeps the largest states
    (the chart fallback shows 20)."""
    codes = F.broadcast(state_codes(df.sparkSession)) if codes is None else codes
    agg = (df.where(F.col("state").isNotNull()).groupBy("state")
             .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")))
    out = agg.join(codes, "state", "inner")
    if top is not None:
        out = out.orderBy(F.col("revenue").desc(), F.col("state")).limit(top)
    return out

"""Readers for landed external payloads (SC6-SC8).

The live HTTP clients are not part of the library: payloads are landed as
files (by any fetcher) and read here as tables, so enrichment is a join
between Spark tables.

* Macro indicators: JSON files holding ``[meta, [{"date": "2023", "value":
  7.6, ...}, ...]]``; NULL values dropped, year as int.
* FX snapshots: rows ``(source, priority, payload)`` with the JSON response of
  each source; the rate is taken from the source's path, valid if > 50, first
  valid by priority, else the fallback.
* Search trends: wide CSV/Parquet (``date`` + keyword columns + optional
  ``isPartial``) turned into long ``(date, keyword, interest)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON paths of the USD->INR rate per FX source, in priority order.
FX_RATE_PATHS = {
    "fawazahmed0": "$.usd.inr",
    "frankfurter": "$.rates.INR",
    "open.er-api": "$.rates.INR",
}
FX_MIN_VALID = 50.0
FX_FALLBACK = 84.0

_RECORD = T.StructType([T.StructField("date", T.StringType()), T.StructField("value", T.DoubleType())])


def read_macro_payloads(spark: SparkSession, path: str, indicator: str | None = None) -> DataFrame:
    """(year int, value double, indicator string) from landed payload files.

    Each file is one JSON document; the second element is the record list.
    ``indicator`` defaults to the file name without extension.
    """
    raw = (spark.read.option("wholetext", True).text(path)
                .withColumn("_file", F.input_file_name()))
    records = F.from_json(F.get_json_object("value", "$[1]"), T.ArrayType(_RECORD))
    ind = (F.lit(indicator) if indicator is not None
           else F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1))
    return (raw.select(ind.alias("indicator"), F.explode_outer(records).alias("r"))
               .where(F.col("r.value").isNotNull())
               .select(F.col("r.date").cast("int").alias("year"), F.col("r.value").alias("value"),
                       "indicator"))


def macro_table(gdp: DataFrame, cpi: DataFrame) -> DataFrame:
    """Full outer join of two indicator series on year (JN1):
    (year, india_gdp_growth_pct, india_cpi_inflation_pct)."""
    g = gdp.select("year", F.col("value").alias("india_gdp_growth_pct"))
    c = cpi.select("year", F.col("value").alias("india_cpi_inflation_pct"))
    return g.join(c, "year", "full_outer")


def fx_rate(snapshots: DataFrame, paths: dict[str, str] = FX_RATE_PATHS,
            min_valid: float = FX_MIN_VALID, fallback: float = FX_FALLBACK) -> DataFrame:
    """One row ``usd_inr_rate``: the valid rate of the best-priority source
    (SC7).  ``snapshots`` has columns (source, priority, payload)."""
    rate = F.lit(None).cast("double")
    for src, jpath in paths.items():
        rate = F.when(F.col("source") == src, F.get_json_object("payload", jpath).cast("double")).otherwise(rate)
    valid = snapshots.select("priority", rate.alias("rate")).where(F.col("rate") > min_valid)
    return (valid.agg(F.min_by("rate", "priority").alias("_r"))
                 .select(F.coalesce(F.col("_r"), F.lit(fallback)).alias("usd_inr_rate")))


def read_trends(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Wide trend table with ``date`` and keyword columns; ``isPartial``
    dropped; repeated columns (batches aligned on date) kept once (SC8)."""
    df = (spark.read.option("header", True).option("inferSchema", True).csv(path)
          if fmt == "csv" else spark.read.parquet(path))
    seen, keep = set(), []
    for c in df.columns:
        if c == "isPartial" or c in seen:
            continue
        seen.add(c)
        keep.append(c)
    return df.select(*keep)


def trends_long(wide: DataFrame, keywords: Sequence[str] | None = None) -> DataFrame:
    """Wide -> long ``(date, keyword, interest)`` (PJ12)."""
    kws = list(keywords) if keywords else [c for c in wide.columns if c != "date"]
    return wide.unpivot(["date"], kws, "keyword", "interest").withColumn(
        "interest", F.col("interest").cast("double"))


def union_trend_batches(*batches: DataFrame) -> DataFrame:
    """Union of long trend batches with one row per (date, keyword): the first
    batch that has it counts, of equal rows within it the smallest value (JN6)."""
    tagged = [b.select("date", "keyword", "interest", F.lit(i).alias("_batch")) for i, b in enumerate(batches)]
    out = tagged[0]
    for b in tagged[1:]:
        out = out.unionByName(b)
    return out.groupBy("date", "keyword").agg(F.min(F.struct("_batch", "interest"))["interest"].alias("interest"))

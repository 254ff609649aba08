"""Cleaning, derived columns and enrichment of the order fact (row-local
projections: no shuffle, one codegen stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import (clip, clip_lower, fiscal_quarter, is_weekend, safe_div,
                            strip_all, year_month)

LOG_COLUMNS = ["base_price", "final_price", "units_sold", "revenue"]


def clean(df: DataFrame) -> DataFrame:
    """Parse the order date (bad text -> NULL), clip the discount to [0, 100]
    keeping NULL, strip whitespace of every string column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "order_date":
            if isinstance(f.dataType, T.StringType):
                c = F.try_to_timestamp(strip_all(c)).cast("timestamp_ntz")
        elif f.name == "discount_percent":
            c = clip(F.nanvl(c.cast("double"), F.lit(None).cast("double")), 0.0, 100.0)
        elif isinstance(f.dataType, T.StringType):
            c = strip_all(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def engineer(df: DataFrame) -> DataFrame:
    """Calendar, fiscal, price and log features of one order row.

    Features whose inputs are not in ``df`` are skipped, so a pruned fact
    (only the columns a query needs) can be passed.
    """
    have = set(df.columns)
    d = F.col("order_date")
    cols = {}
    if "order_date" in have:
        cols.update({
            "year": F.year(d),
            "month": F.month(d),
            "month_name": F.date_format(d, "MMMM"),
            "weekday": F.weekday(d),
            "is_weekend": is_weekend(d),
            "fiscal_quarter": fiscal_quarter(F.month(d)),
            "year_month": year_month(d),
        })
    if {"base_price", "final_price"} <= have:
        cols.update({
            "discount_amount": F.col("base_price") - F.col("final_price"),
            "discount_ratio": safe_div(F.col("base_price") - F.col("final_price"), F.col("base_price")),
        })
    if "final_price" in have:
        cols["revenue_per_unit"] = F.col("final_price")
    for c in LOG_COLUMNS:
        if c in have:
            cols[f"log_{c}"] = F.log1p(clip_lower(F.col(c).cast("double"), 0.0))
    return df.withColumns(cols) if cols else df


def prepare(df: DataFrame) -> DataFrame:
    """clean + engineer: the table every analytic starts from."""
    return engineer(clean(df))


def keep_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def filter_segments(df: DataFrame, **allowed: list[str] | None) -> DataFrame:
    """Set-membership filter per dimension, e.g. ``zone=[...], category=[...]``.
    ``None`` means no restriction; pushed to the Parquet scan when possible."""
    cond = F.lit(True)
    for col, values in allowed.items():
        if values is not None:
            cond = cond & F.col(col).isin(list(values))
    return df.filter(cond)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values of one dimension (filter options)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def group_label(a: str = "category", b: str = "zone") -> F.Column:
    return F.concat(F.col(a), F.lit(" / "), F.col(b))


def scatter_rows(df: DataFrame, x: str, y: str, color: str | None = None,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Row projection that feeds a scatter chart (PJ16): x, y, optional colour
    and hover columns, keeping only those present; rows with a NULL x or y
    are dropped.  A projection only -- pruned at the scan, no shuffle."""
    cols = [c for c in (x, y, color, *extra) if c]
    out = keep_available(df, list(dict.fromkeys(cols)))
    return out.where(F.col(x).isNotNull() & F.col(y).isNotNull())

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    """NaN is pandas' missing value; Spark's is NULL (trap T1)."""
    x = _c(x)
    return F.nanvl(x, F.lit(None).cast("double"))


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: NULL stays NULL (Spark greatest/least skip NULL, T2)."""
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def clip_lower(x, lo: float) -> Column:
    return clip(x, lo=lo)


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero or NULL denominator (T3)."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0)))


def safe_corr(a, b) -> Column:
    """Pearson correlation as an aggregate; NULL for constant input (T4).

    ``corr`` raises DIVIDE_BY_ZERO under ANSI for a constant column.  Moments
    are taken only on rows where both sides are present, like pandas.
    """
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(a2, b2),
                        F.nullif(F.stddev_samp(a2) * F.stddev_samp(b2), F.lit(0.0)))


def strip_all(x) -> Column:
    """Python ``str.strip``: removes every leading/trailing whitespace (T6)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def weekday_mon0(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (T8)."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return F.coalesce(F.weekday(_c(ts)) >= 5, F.lit(False))


def fiscal_quarter(month) -> Column:
    """April-start fiscal quarter with floored modulo (T7), as tinyint."""
    m = _c(month)
    return (F.floor(F.pmod(m - 4, F.lit(12)) / 3) + 1).cast("tinyint")


def year_month(ts) -> Column:
    """Month key 'yyyy-MM'; NULL for a NULL date (T21)."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_start(ts) -> Column:
    """First day of the month as DATE (T19)."""
    return F.trunc(F.to_date(_c(ts)), "month")


def months_between_keys(later, earlier) -> Column:
    """Whole-month distance between two month-start dates (pandas Period diff)."""
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def customer_key(state, gender, age, null_literal: bool = True) -> Column:
    """Synthetic customer id ``state_gender_age`` (T17).

    ``null_literal=True`` mimics ``astype(str)`` (missing -> 'nan');
    ``False`` propagates NULL like the plain string ``+`` of the cohort code.
    """
    parts = [_c(state), _c(gender), _c(age).cast("string")]
    if null_literal:
        parts = [F.coalesce(p.cast("string"), F.lit("nan")) for p in parts]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2])


def np_round(x, digits: int = 0) -> Column:
    """numpy / pandas ``round``: rint(x * 10^d) / 10^d (half to even on the
    scaled binary value; T5).  Spark's ``round`` is HALF_UP on the decimal
    representation and differs at ties."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(x) * scale) / scale

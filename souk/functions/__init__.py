"""Column helpers that encode the pandas semantics the analytics need.

Every helper returns a ``Column`` built only from Spark built-in functions, so
expressions stay inside whole-stage codegen.
"""

from souk.functions.columns import (  # noqa: F401
    clip,
    clip_lower,
    customer_key,
    fiscal_quarter,
    is_weekend,
    month_start,
    months_between_keys,
    nan_to_null,
    np_round,
    safe_corr,
    safe_div,
    strip_all,
    weekday_mon0,
    year_month,
)

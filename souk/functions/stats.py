"""Distribution tail probabilities as vectorised (Arrow) pandas UDFs.

They run on aggregated rows (one per group or feature), never per order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction 1 / (1 + d1 / (1 + d2 / (1 + ...))) of the incomplete
    beta function (DLMF 8.17.22), evaluated from the far end; the number of terms
    doubles until the value stands."""
    def term(k: int) -> float:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    last, terms = math.inf, 32
    while True:
        value = 1.0
        for k in range(terms, 0, -1):
            value = 1.0 + term(k) / value
        if abs(value - last) <= 4e-16 * abs(value) or terms > 1 << 20:
            return 1.0 / value
        last, terms = value, 2 * terms


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _beta_fraction(a, b, x) / a
    return 1.0 - bt * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or not np.isfinite(t) or dof <= 0:
        if t is not None and dof and dof > 0 and np.isinf(t):
            return 0.0
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def kolmogorov_sf(lam: float, terms: int = 100) -> float:
    """Asymptotic Kolmogorov survival function Q(lam) = 2 sum (-1)^(k-1) e^(-2 k^2 lam^2)."""
    if lam is None or not np.isfinite(lam):
        return float("nan")
    if lam <= 0:
        return 1.0
    k = np.arange(1, terms + 1)
    s = 2.0 * np.sum(((-1.0) ** (k - 1)) * np.exp(-2.0 * k * k * lam * lam))
    return float(min(max(s, 0.0), 1.0))


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, dof)], dtype="float64")

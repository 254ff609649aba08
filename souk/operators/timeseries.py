"""Monthly series, gap interpolation, additive seasonal decomposition and a
trend + seasonality forecast (TS1-TS3).

Series are tiny after aggregation (one row per month, or per month and
series key), so windows over the month order are cheap; the heavy part -- the
aggregation from orders to months -- is one partial + final hash aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import month_start


def monthly_series(df: DataFrame, col: str = "revenue", agg: str = "sum",
                   by: Sequence[str] = ()) -> DataFrame:
    """Aggregate ``col`` per month (``sum`` / ``mean`` / ``count``) on a gapless
    month spine from the first to the last month of each series, with
    missing months linearly interpolated (TS1).

    Output: by..., month (DATE, first of month), value, interpolated (bool).
    """
    by = list(by)
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    base = df.where(F.col("order_date").isNotNull())
    m = (base.groupBy(*by, month_start("order_date").alias("month"))
             .agg(fn(col).alias("value")))
    span = m.groupBy(*by).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    spine = span.select(*by, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    s = spine.join(m, [*by, "month"], "left")
    return interpolate(s, "month", "value", by)


def interpolate(s: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation of NULL values by position along ``key``."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(key)
    s = s.withColumn("_i", F.row_number().over(w))
    known_i = F.when(F.col(value).isNotNull(), F.col("_i"))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    s = s.select("*",
                 F.last(F.col(value), True).over(back).alias("_pv"),
                 F.last(known_i, True).over(back).alias("_pi"),
                 F.first(F.col(value), True).over(fwd).alias("_nv"),
                 F.first(known_i, True).over(fwd).alias("_ni"))
    frac = (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
               .when(F.col("_ni").isNull(), F.col("_pv"))     # trailing gap: last value
               .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * frac))
    return s.select(*by, key, filled.alias(value), F.col(value).isNull().alias("interpolated"))


def decompose(series: DataFrame, key: str = "month", value: str = "value", period: int = 12,
              by: Sequence[str] = ()) -> DataFrame:
    """Additive decomposition (TS2): centred 2 x ``period`` moving-average trend
    (NULL at the ends), seasonal = mean detrended value per position in the
    cycle, re-centred to sum to zero, residual = observed - trend - seasonal.
    Series shorter than two full cycles give no rows."""
    by = list(by)
    half = period // 2
    w = Window.partitionBy(*by).orderBy(key)
    s = series.select(*by, key, value,
                      (F.row_number().over(w) - 1).alias("_pos"),
                      F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_n"))
    s = s.where(F.col("_n") >= 2 * period)
    frame = w.rowsBetween(-half, half)
    full = F.count(F.col(value)).over(frame) == 2 * half + 1
    if period % 2 == 0:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        trend = (F.sum(value).over(frame) - 0.5 * ends) / period
    else:
        trend = F.avg(value).over(frame)
    s = s.withColumn("trend", F.when(full, trend))
    s = s.withColumn("_detr", F.col(value) - F.col("trend")).withColumn("_phase", F.col("_pos") % period)
    per_phase = s.groupBy(*by, "_phase").agg(F.avg("_detr").alias("_pa"))
    centred = per_phase.withColumn("seasonal", F.col("_pa") - F.avg("_pa").over(Window.partitionBy(*by)))
    out = s.join(centred.select(*by, "_phase", "seasonal"), [*by, "_phase"])
    return out.select(*by, key, F.col(value).alias("observed"), "trend", "seasonal",
                      (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def _trend_season(y, t, m, future, harmonics: int, changepoints: int, ridge: float):
    """Fits y = trend(t) * (1 + season(m)) by alternating ridge least squares.

    trend: piecewise linear, slope changes at evenly spaced months of the first
    80 %; season: yearly Fourier terms.  Works on the values themselves, so zero
    and negative months count like any other.  Returns the fit over ``future``
    (pairs of t and m) and the residual standard deviation."""
    import math

    import numpy as np

    span = max(float(t.max()), 1.0)
    knots = np.linspace(0, 0.8 * span, min(changepoints, max(len(y) // 4, 0)) + 1)[1:]
    trend_of = lambda x: np.column_stack([np.ones_like(x), x / span]
                                         + [np.maximum(x - k, 0) / span for k in knots])
    season_of = lambda x: np.column_stack([f(2 * math.pi * k * x / 12.0) for k in range(1, harmonics + 1)
                                           for f in (np.sin, np.cos)])
    scale = float(np.abs(y).max()) or 1.0
    v, x, z = y / scale, trend_of(t), season_of(m)
    px = np.diag([0.0, 0.0] + [ridge] * len(knots))
    pz = np.eye(z.shape[1]) * 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        w = x * (1 + z @ beta)[:, None]
        trend = np.linalg.lstsq(w.T @ w + px, w.T @ v, rcond=None)[0]
        g = x @ trend
        u = z * g[:, None]
        new = np.linalg.lstsq(u.T @ u + pz * max(float(g @ g) / len(g), 1e-12), u.T @ (v - g), rcond=None)[0]
        done = np.max(np.abs(new - beta), initial=0.0) < 1e-10
        beta = new
        if done:
            break
    resid = v - x @ trend * (1 + z @ beta)
    dof = max(len(v) - 2 - z.shape[1], 1)
    fit = trend_of(future[0]) @ trend * (1 + season_of(future[1]) @ beta)
    return fit * scale, float(np.sqrt(np.sum(resid ** 2) / dof)) * scale


def _log_linear(y, t, m, future, harmonics: int):
    """Least squares of ln(y) on a line and yearly Fourier terms: fit over ``future``
    and residual standard deviation, both of ln(y)."""
    import math

    import numpy as np

    def design(t, m):
        waves = [f(2 * math.pi * k * m / 12.0) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones_like(t), t, *waves])

    x = design(t, m)
    beta = np.linalg.lstsq(x, np.log(y), rcond=None)[0]
    resid = np.log(y) - x @ beta
    return design(*future) @ beta, float(np.sqrt(np.sum(resid ** 2) / max(len(y) - x.shape[1], 1)))


def forecast(series: DataFrame, key: str = "month", value: str = "value", periods: int = 60,
             by: Sequence[str] = (), harmonics: int = 3, interval: float = 0.80,
             growth: str = "piecewise", changepoints: int = 12, ridge: float = 0.05) -> DataFrame:
    """Trend + yearly seasonality, ``periods`` months beyond the last data month,
    with an ``interval`` band (TS3).

    ``growth="piecewise"``: piecewise-linear trend x (1 + seasonality), band
    +- z sigma.  Every month with a value counts, zero and negative ones too.
    ``growth="log_linear"``: ln(y) = line + seasonality, multiplicative band; a
    value that has no logarithm raises ValueError.
    Months without a value are predicted, not fitted.  Each series is one
    group of ``groupBy(by).applyInPandas``: one row per month, bounded by the
    calendar, not by the order count.
    Output: by..., month, yhat, yhat_lower, yhat_upper, is_forecast.
    """
    import numpy as np
    import pandas as pd
    from statistics import NormalDist

    if growth not in ("piecewise", "log_linear"):
        raise ValueError(f"unknown growth {growth!r}")
    by = list(by)
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    base = series.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("date").alias("month"),
                                                       F.col(value).cast("double").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        months = pd.to_datetime(pdf["month"])
        t0 = months.iloc[0]
        t = ((months.dt.year - t0.year) * 12 + months.dt.month - t0.month).to_numpy(float)
        last = int(t.max())
        ft = np.arange(0, last + periods + 1, dtype=float)
        fmonths = pd.date_range(t0, periods=len(ft), freq="MS")
        y, m = pdf["y"].to_numpy(float), months.dt.month.to_numpy(float)
        known = np.isfinite(y)
        future = (ft, fmonths.month.to_numpy(float))
        if not known.any():
            mu = low = high = np.full(len(ft), np.nan)
        elif growth == "piecewise":
            mu, sigma = _trend_season(y[known], t[known], m[known], future, harmonics, changepoints, ridge)
            low, high = mu - z * sigma, mu + z * sigma
        else:
            if (y[known] <= 0).any():
                raise ValueError('a value without logarithm: use growth="piecewise"')
            mu, sigma = _log_linear(y[known], t[known], m[known], future, harmonics)
            mu, low, high = np.exp(mu), np.exp(mu - z * sigma), np.exp(mu + z * sigma)
        out = pd.DataFrame({"month": fmonths.date, "yhat": mu, "yhat_lower": low,
                            "yhat_upper": high, "is_forecast": ft > last})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "month", "yhat", "yhat_lower", "yhat_upper", "is_forecast"]]

    schema = ", ".join([*[f"{c} {series.schema[c].dataType.simpleString()}" for c in by],
                        "month date", "yhat double", "yhat_lower double", "yhat_upper double",
                        "is_forecast boolean"])
    if not by:
        # a single series: one group keyed by a constant
        return base.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fit, schema)
    return base.groupBy(*by).applyInPandas(fit, schema)


def _innovations(params, w, s: int):
    """One-step errors of (1 - fB)(1 - FB^s) w = (1 + tB)(1 + TB^s) e, values before the first being 0."""
    import numpy as np

    f, fs, t, ts = params
    n, pad = len(w), s + 1
    wp, e = np.concatenate([np.zeros(pad), w]), np.zeros(n + pad)
    ar = wp[pad:] - f * wp[pad - 1:-1] - fs * wp[1:n + 1] + f * fs * wp[:n]
    for i in range(n):
        j = i + pad
        e[j] = ar[i] - t * e[j - 1] - ts * e[j - s] - t * ts * e[j - s - 1]
    return e[pad:]


def _sarima_css(y, periods: int, s: int = 12, z: float = 1.2815515655446004):
    """Seasonal ARIMA(1,1,1)(1,1,1)_s in its multiplicative form, fitted by
    conditional sum of squares on w = (1-B)(1-B^s) y (damped Gauss-Newton over the
    four parameters, kept inside the unit interval by tanh); forecast ``periods``
    steps with a +-z sigma band from the impulse response.  Returns (mean, lower,
    upper), or None below two full seasons (no double difference to fit)."""
    import numpy as np
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * s:
        return None
    w = y[s + 1:] - y[s:-1] - y[1:-s] + y[:-s - 1]
    scale = float(np.abs(w).max()) or 1.0
    v = w / scale
    bounded = lambda u: 0.98 * np.tanh(u)
    best, errors = None, None
    for start in ((0.1, 0.1, -0.1, -0.1), (0.5, 0.1, -0.5, -0.5), (-0.3, -0.1, 0.1, -0.3)):
        u, damp = np.arctanh(np.array(start) / 0.98), 1e-2
        e = _innovations(bounded(u), v, s)
        for _ in range(60):
            jac = np.column_stack([(_innovations(bounded(u + h), v, s) - e) / 1e-6 for h in np.eye(4) * 1e-6])
            step = np.linalg.solve(jac.T @ jac + damp * np.eye(4), -jac.T @ e)
            trial = _innovations(bounded(u + step), v, s)
            if trial @ trial < e @ e:
                gain = 1 - (trial @ trial) / max(e @ e, 1e-300)
                u, e, damp = u + step, trial, damp / 3
                if gain < 1e-9:
                    break
            elif damp > 1e8:
                break
            else:
                damp *= 4
        if errors is None or e @ e < errors @ errors:
            best, errors = bounded(u), e
    f, fs, t, ts = best
    errors = errors * scale
    sigma = float(np.sqrt(np.sum(errors ** 2) / max(len(errors) - 4, 1)))
    at = lambda a, i: a[i] if i >= 0 else 0.0

    def extend(ws, es, ys, steps, shock=0.0):
        for k in range(steps):
            i = len(ws)
            es.append(shock if k == 0 else 0.0)
            ws.append(f * at(ws, i - 1) + fs * at(ws, i - s) - f * fs * at(ws, i - s - 1)
                      + es[i] + t * at(es, i - 1) + ts * at(es, i - s) + t * ts * at(es, i - s - 1))
            j = len(ys)
            ys.append(ws[i] + at(ys, j - 1) + at(ys, j - s) - at(ys, j - s - 1))
        return ys
    mean = np.array(extend(list(w), list(errors), list(y), periods)[n:])
    psi = np.array(extend([], [], [], periods, shock=1.0))
    sd = sigma * np.sqrt(np.cumsum(psi ** 2))
    return mean, mean - z * sd, mean + z * sd


def seasonal_arima_forecast(series: DataFrame, key: str = "month", value: str = "value",
                            periods: int = 60, by: Sequence[str] = (), interval: float = 0.80) -> DataFrame:
    """Seasonal ARIMA(1,1,1)(1,1,1)12 forecast per series with an ``interval``
    band (TS4): multiplicative model fitted by conditional sum of squares, so
    values differ slightly from an exact-likelihood fit.  Missing months and months
    without a value between known ones are interpolated linearly (TS1), those before
    the first and after the last known one take no part.  One ``applyInPandas`` group
    per series (one row per month).
    Output: by..., month, yhat, yhat_lower, yhat_upper (future months only;
    none for series shorter than 24 months, two full seasons)."""
    import pandas as pd
    from statistics import NormalDist

    by = list(by)
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    base = series.where(F.col(key).isNotNull()).select(*by, F.trunc(F.col(key).cast("date"), "month").alias("month"),
                                                       F.col(value).cast("double").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "month", "yhat", "yhat_lower", "yhat_upper"]
        y = pd.Series(pdf["y"].to_numpy(float), pd.to_datetime(pdf["month"])).dropna().sort_index()
        if len(y):
            y = y.reindex(pd.date_range(y.index[0], y.index[-1], freq="MS")).interpolate()
        res = _sarima_css(y.to_numpy(float), periods, 12, z) if len(y) else None
        if res is None:
            return pd.DataFrame(columns=cols)
        mean, lo, hi = res
        last = y.index[-1]
        months = pd.date_range(last + pd.offsets.MonthBegin(1), periods=periods, freq="MS").date
        out = pd.DataFrame({"month": months, "yhat": mean, "yhat_lower": lo, "yhat_upper": hi})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[cols]

    schema = ", ".join([*[f"{c} {series.schema[c].dataType.simpleString()}" for c in by],
                        "month date", "yhat double", "yhat_lower double", "yhat_upper double"])
    if not by:
        return base.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fit, schema)
    return base.groupBy(*by).applyInPandas(fit, schema)

"""BG/NBD purchase model and Gamma-Gamma spend model for customer lifetime
value (CU6), after Fader, Hardie & Lee (2005) and Fader & Hardie (2013).

Definitions (published ones): per customer, with purchase days as periods,
``x`` = repeat purchase days (days with an order - 1), ``t_x`` = weeks from
the first to the last purchase day, ``T`` = weeks from the first purchase
day to the end of the data, ``m`` = mean revenue of the repeat days.

Fitting at scale: customers are compressed to (x, t_x, T) and (x, m) cells with a
count; m is kept to 1 / ``SPEND_CELLS`` of its size, which changes a customer's
log-likelihood in the second order only (by some (p x + q) / (24 SPEND_CELLS^2)).
Each optimiser pass is one vector aggregate over the cells: ``mapInPandas`` sums the
weighted log-likelihood, its analytic gradient and the curvature of a few candidate
steps per task, Spark adds the sums up, and the driver holds the parameters and one
vector per candidate.  The search is Newton's with a convergence test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import np_round

WEEKS_PER_MONTH = 4.33
SPEND_CELLS = 1_000


def _lgamma(x):
    """Vectorised log-gamma for x > 0: shift to >= 7 by the recurrence, then
    the Stirling series (absolute error below 1e-12)."""
    y = np.asarray(x, float)
    shift = np.zeros(np.broadcast(y).shape)
    for _ in range(7):
        small = y < 7
        shift = shift + np.where(small, np.log(y), 0.0)
        y = np.where(small, y + 1.0, y)
    yi = 1.0 / y
    yi2 = yi * yi
    series = yi * (1.0 / 12 - yi2 * (1.0 / 360 - yi2 * (1.0 / 1260 - yi2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _digamma(x):
    """Vectorised derivative of log-gamma for x > 0, by the same shift and series."""
    y = np.asarray(x, float)
    shift = np.zeros(np.broadcast(y).shape)
    for _ in range(7):
        small = y < 7
        shift = shift + np.where(small, 1.0 / y, 0.0)
        y = np.where(small, y + 1.0, y)
    yi = 1.0 / y
    yi2 = yi * yi
    return np.log(y) - yi / 2 - yi2 * (1.0 / 12 - yi2 * (1.0 / 120 - yi2 * (1.0 / 252 - yi2 * (1.0 / 240 - yi2 / 132)))) - shift


def _bgnbd_parts(params, x, tx, t):
    """log of the two terms that are added: still buying at the end, or gone after the last purchase."""
    r, alpha, a, b = params
    alive = -(r + x) * np.log(alpha + t)
    with np.errstate(divide="ignore", invalid="ignore"):
        gone = np.where(x > 0, np.log(a) - np.log(np.maximum(b + x - 1, 1e-300)) - (r + x) * np.log(alpha + tx), -np.inf)
    return alive, gone


def bgnbd_loglik(params, x, tx, t):
    """Per-customer BG/NBD log-likelihood for params (r, alpha, a, b)."""
    r, alpha, a, b = params
    x, tx, t = np.asarray(x, float), np.asarray(tx, float), np.asarray(t, float)
    a1 = _lgamma(r + x) - _lgamma(r) + r * np.log(alpha)
    a2 = _lgamma(a + b) + _lgamma(b + x) - _lgamma(b) - _lgamma(a + b + x)
    a3, a4 = _bgnbd_parts(params, x, tx, t)
    mx = np.maximum(a3, a4)
    return a1 + a2 + mx + np.log(np.exp(a3 - mx) + np.exp(a4 - mx))


def bgnbd_gradient(params, x, tx, t):
    """Derivatives of ``bgnbd_loglik`` by r, alpha, a and b."""
    r, alpha, a, b = params
    x, tx, t = np.asarray(x, float), np.asarray(tx, float), np.asarray(t, float)
    a3, a4 = _bgnbd_parts(params, x, tx, t)
    mx = np.maximum(a3, a4)
    p4 = np.exp(a4 - mx) / (np.exp(a3 - mx) + np.exp(a4 - mx))
    p3 = 1 - p4
    both = _digamma(a + b) - _digamma(a + b + x)
    return (_digamma(r + x) - _digamma(r) + np.log(alpha) - p3 * np.log(alpha + t) - p4 * np.log(alpha + tx),
            r / alpha - (r + x) * (p3 / (alpha + t) + p4 / (alpha + tx)),
            both + p4 / a,
            both + _digamma(b + x) - _digamma(b) - p4 / np.where(x > 0, b + x - 1, 1.0))


def gamma_gamma_loglik(params, x, m):
    """Per-customer Gamma-Gamma log-likelihood for params (p, q, v), x > 0."""
    p, q, v = params
    x, m = np.asarray(x, float), np.asarray(m, float)
    return (_lgamma(p * x + q) - _lgamma(p * x) - _lgamma(q) + q * np.log(v)
            + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v))


def gamma_gamma_gradient(params, x, m):
    """Derivatives of ``gamma_gamma_loglik`` by p, q and v."""
    p, q, v = params
    x, m = np.asarray(x, float), np.asarray(m, float)
    rest = np.log(x * m + v)
    return (x * (_digamma(p * x + q) - _digamma(p * x) + np.log(m) + np.log(x) - rest),
            _digamma(p * x + q) - _digamma(q) + np.log(v) - rest,
            q / v - (p * x + q) / (x * m + v))


# log-likelihood, its gradient, columns of the cells, number of parameters
MODELS = {"bgnbd": (bgnbd_loglik, bgnbd_gradient, ["x", "t_x", "T"], 4),
          "gamma_gamma": (gamma_gamma_loglik, gamma_gamma_gradient, ["x", "m"], 3)}
_STEPS = (1.0, 0.5, 0.125, 1 / 64)      # shares of a Newton step that a pass tries
_NUDGE = 1e-4


def loglik(cells: DataFrame, model: str, params) -> DataFrame:
    """One row (customers, loglik): the summed log-likelihood of ``cells`` (with weight ``w``)."""
    of, _, cols, _ = MODELS[model]
    params = [float(p) for p in params]

    def run(it):
        for pdf in it:
            w = pdf["w"].to_numpy(float)
            yield pd.DataFrame({"customers": [w.sum()], "loglik": [of(params, *[pdf[c].to_numpy(float) for c in cols]) @ w]})
    return cells.select(*cols, "w").mapInPandas(run, "customers double, loglik double").agg(
        F.sum("customers").cast("long").alias("customers"), F.sum("loglik").alias("loglik"))


def _pass(cells: DataFrame, model: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed log-likelihood, gradient and curvature by the log-parameters at each point."""
    of, gradient, cols, k = MODELS[model]
    names = [f"v{i}" for i in range(1 + k + k * k)]
    points = np.asarray(points, float)

    def at(u, arrays):
        return np.array(gradient(np.exp(u), *arrays)) * np.exp(u)[:, None]

    def run(it):
        for pdf in it:
            w, arrays = pdf["w"].to_numpy(float), [pdf[c].to_numpy(float) for c in cols]
            rows = []
            with np.errstate(all="ignore"):
                for i, u in enumerate(points):
                    value = of(np.exp(u), *arrays)
                    value = np.where(np.isfinite(value), value, -1e12) @ w
                    curve = [(at(u + _NUDGE * e, arrays) @ w - at(u - _NUDGE * e, arrays) @ w) / (2 * _NUDGE) for e in np.eye(k)]
                    rows.append([i, value, *(at(u, arrays) @ w), *np.ravel(curve)])
            yield pd.DataFrame(rows, columns=["point", *names])

    schema = "point long, " + ", ".join(f"{n} double" for n in names)
    got = cells.select(*cols, "w").mapInPandas(run, schema).groupBy("point").agg(*[F.sum(n).alias(n) for n in names]) \
        .toPandas().sort_values("point")
    v = got[names].to_numpy()
    curve = v[:, 1 + k:].reshape(-1, k, k)
    return v[:, 0], v[:, 1:1 + k], (curve + curve.transpose(0, 2, 1)) / 2


def fit(cells: DataFrame, model: str, penalizer: float, passes: int = 60, tol: float = 1e-7,
        told: list | None = None) -> np.ndarray:
    """Parameters that maximise mean log-likelihood - penalizer * sum(params^2).

    Newton's method on the log-parameters from 1; where the curvature isn't that of a
    maximum, its eigenvalues are made so.  A pass tries a few lengths of the step at once.  Ends when
    the gradient vanishes (``tol``) or no length improves; raises RuntimeError if it
    is still improving after ``passes``.  Without any cell the start is returned.
    ``told`` gets an entry per pass."""
    k = MODELS[model][3]
    total = cells.agg(F.sum("w")).first()[0] or 0
    u = np.zeros(k)
    if total == 0:
        return np.exp(u)

    def objective(points: np.ndarray):
        value, grad, curve = _pass(cells, model, points)
        if told is not None:
            told.append(len(points))
        own = np.exp(2 * points)
        return (value / total - penalizer * own.sum(axis=1), grad / total - 2 * penalizer * own,
                curve / total - 4 * penalizer * own[:, :, None] * np.eye(k))

    value, grad, curve = (x[0] for x in objective(u[None, :]))
    for _ in range(passes):
        if np.max(np.abs(grad)) < tol:
            return np.exp(u)
        e, q = np.linalg.eigh(-curve)
        move = q @ ((q.T @ grad) / np.maximum(np.abs(e), 1e-6))
        move *= min(1.0, 2.0 / np.linalg.norm(move))
        points = u + np.outer(_STEPS, move)
        values, grads, curves = objective(points)
        best = int(np.argmax(values))
        if values[best] <= value + 1e-13:
            return np.exp(u)
        u, value, grad, curve = points[best], values[best], grads[best], curves[best]
    raise RuntimeError(f"no convergence within {passes} passes (gradient {np.max(np.abs(grad)):.2g})")


def customer_cells(df: DataFrame) -> DataFrame:
    """Per customer: x, t_x (weeks), T (weeks), m (mean repeat-day revenue)."""
    day = F.to_date("order_date")
    days = (df.where(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
              .groupBy("customer_id", day.alias("day"))
              .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("rev")))
    end = df.agg(F.max(F.to_date("order_date")).alias("_end"))
    # the first day's revenue is known with it, so repeat days need no second look
    per = days.groupBy("customer_id").agg(
        (F.count(F.lit(1)) - 1).alias("x"), F.min("day").alias("_first"), F.max("day").alias("_last"),
        F.sum("rev").alias("_all"), F.min_by("rev", "day").alias("_rev1"))
    per = per.withColumn("m", F.try_divide(F.col("_all") - F.col("_rev1"), F.nullif("x", F.lit(0))))
    return (per.crossJoin(F.broadcast(end))
               .select("customer_id", F.col("x").cast("double").alias("x"),
                       (F.datediff("_last", "_first") / 7.0).alias("t_x"),
                       (F.datediff("_end", "_first") / 7.0).alias("T"), "m"))


def purchase_cells(cust: DataFrame) -> DataFrame:
    """(x, t_x, T, w): customers with equal histories."""
    return cust.groupBy("x", "t_x", "T").agg(F.count(F.lit(1)).cast("double").alias("w"))


def spend_cells(cust: DataFrame) -> DataFrame:
    """(x, m, w): repeat customers by frequency and mean spend, m to 1 / ``SPEND_CELLS`` of its size."""
    m = F.log("m")
    return (cust.where((F.col("x") > 0) & (F.col("m") > 0)).groupBy("x", F.floor(m * SPEND_CELLS).alias("_c"))
            .agg(F.exp(F.avg(m)).alias("m"), F.count(F.lit(1)).cast("double").alias("w")).drop("_c"))


def _hyp2f1(a, b, c, z, terms: int = 100_000):
    a, b, c, z = (np.asarray(v, float) for v in (a, b, c, z))
    term = np.ones_like(z)
    total = np.ones_like(z)
    for k in range(terms):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if np.all(np.abs(term) < 1e-15 * np.abs(total)):
            return total
    raise RuntimeError(f"the series has not converged after {terms} terms")


def expected_purchases(params, t, x, tx, T_):
    """BG/NBD conditional expected purchases in the next ``t`` weeks."""
    r, alpha, a, b = params
    a = a if abs(a - 1) > 1e-6 else 1 + 1e-6        # the formula's limit at a = 1
    x, tx, T_ = (np.asarray(v, float) for v in (x, tx, T_))
    z = t / (alpha + T_ + t)
    hyp = _hyp2f1(r + x, b + x, a + b + x - 1, z)
    num = (a + b + x - 1) / (a - 1) * (1 - ((alpha + T_) / (alpha + T_ + t)) ** (r + x) * hyp)
    den = 1 + np.where(x > 0, a / np.maximum(b + x - 1, 1e-300) * ((alpha + T_) / (alpha + tx)) ** (r + x), 0.0)
    return num / den


def bgnbd_clv(df: DataFrame, horizon_months: int = 12, margin: float = 0.20,
              penalizer: float = 0.001) -> DataFrame:
    """Model-based CLV per customer (CU6): expected purchases over the horizon
    (BG/NBD) x expected average value (Gamma-Gamma for customers with repeat
    purchases, else their mean) x margin, 2 dp, with quartile tiers."""
    from souk.operators.customers import add_clv_tiers
    from souk.operators.ordered import materialize

    from souk.operators.customers import with_customer_id

    cust = materialize(customer_cells(with_customer_id(df)))
    # the cell tables are read once per optimiser pass: materialise them
    cells, gg_cells = materialize(purchase_cells(cust)), materialize(spend_cells(cust))
    # the two fits are independent: their passes run as concurrent Spark jobs
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=2) as pool:
        f_bg = pool.submit(fit, cells, "bgnbd", penalizer)
        f_gg = pool.submit(fit, gg_cells, "gamma_gamma", penalizer)
        bg, gg = f_bg.result(), f_gg.result()
    t = horizon_months * WEEKS_PER_MONTH
    bgp, ggp = [float(v) for v in bg], [float(v) for v in gg]

    @F.pandas_udf(T.DoubleType())
    def purchases(x: pd.Series, tx: pd.Series, tt: pd.Series) -> pd.Series:
        return pd.Series(expected_purchases(bgp, t, x, tx, tt))

    p, q, v = ggp
    # the expectation exists only for p * x + q > 1; else the own mean counts
    avg_value = F.when((F.col("x") > 0) & (F.col("m") > 0) & (p * F.col("x") + q > 1),
                       (p * (v + F.col("x") * F.col("m"))) / (p * F.col("x") + q - 1))
    out = cust.select("customer_id", F.col("x").alias("frequency"), F.col("t_x").alias("recency_weeks"),
                      F.col("T").alias("T_weeks"), F.col("m").alias("monetary"),
                      purchases("x", "t_x", "T").alias("predicted_purchases"),
                      avg_value.alias("_gg"))
    out = out.withColumn("predicted_avg_value", F.coalesce("_gg", "monetary", F.lit(0.0))).drop("_gg")
    out = out.withColumn("clv", np_round(F.col("predicted_purchases") * F.col("predicted_avg_value") * margin, 2))
    params = F.create_map(*[x for k, val in zip(["r", "alpha", "a", "b", "p", "q", "v"], bgp + ggp)
                            for x in (F.lit(k), F.lit(val))])
    return add_clv_tiers(out).withColumn("model_params", params)

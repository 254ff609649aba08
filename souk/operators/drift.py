"""Feature drift between a reference and a current time window (DR1-DR3, SK2).

One plan serves all features: the fact is unpivoted to (feature, side, x)
rows, so breakpoints, bucket counts, value counts and KS prefix sums are each
one grouped job over all features.  Reference breakpoints are exact quantiles
(distributed ranking); the KS statistic uses distributed prefix sums over
distinct values -- no global sort into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import np_round

from souk.operators.ordered import materialize, prefix_sum, quantiles_from_prefix
from souk.schema import DRIFT_FEATURES

PSI_THRESHOLD = 0.2
PSI_HIGH = 0.25
KS_P_THRESHOLD = 0.05
PSI_FLOOR = 1e-6


def window_bounds(df: DataFrame, reference_months: int = 6, current_months: int = 3) -> DataFrame:
    """One row: cut (start of current window) and start (of reference window).
    Month arithmetic clamps at month end."""
    mx = F.max("order_date")
    cut = mx - F.expr(f"INTERVAL {int(current_months)} MONTH")
    return (df.agg(cut.alias("cut"))
              .withColumn("start", F.col("cut") - F.expr(f"INTERVAL {int(reference_months)} MONTH")))


def tag_windows(df: DataFrame, reference_months: int = 6, current_months: int = 3) -> DataFrame:
    """Rows of the two windows with ``side`` = 'ref' | 'cur' (others dropped).

    The two bounds (one row) are fetched first, so that the window is a filter by
    literals, which reaches the Parquet scan and skips row groups."""
    b = window_bounds(df, reference_months, current_months)
    found = b.select(F.col("cut").cast("string"), F.col("start").cast("string")).first()
    kind = df.schema["order_date"].dataType
    cut, start = (F.lit(found[c]).cast(kind) for c in ("cut", "start"))       # null without any date: no rows
    d = F.col("order_date")
    return df.where(d >= start).withColumns({"cut": cut, "start": start, "side": F.when(d >= cut, "cur").otherwise("ref")})


def kolmogorov_p(lam) -> F.Column:
    """Asymptotic Kolmogorov tail 2 sum_{k=1..100} (-1)^(k-1) exp(-2 k^2 lam^2),
    clamped to [0, 1]; 1 for lam <= 0 (JVM-side higher-order function)."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                    lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * s, F.lit(0.0)), F.lit(1.0)))


def feature_drift(df: DataFrame, features: Sequence[str] = DRIFT_FEATURES,
                  reference_months: int = 6, current_months: int = 3,
                  buckets: int = 10, min_rows: int = 50, min_values: int = 10,
                  digits: bool = True) -> DataFrame:
    """Per-feature PSI, KS statistic and p-value, drift flag, severity, means
    and mean shift; features missing from ``df`` are skipped; no rows when a
    window has fewer than ``min_rows`` rows; sorted by PSI descending."""
    feats = [f for f in features if f in df.columns]
    t = tag_windows(df.select("order_date", *feats), reference_months, current_months)
    gate = t.agg(F.sum(F.when(F.col("side") == "ref", 1).otherwise(0)).alias("_nref_rows"),
                 F.sum(F.when(F.col("side") == "cur", 1).otherwise(0)).alias("_ncur_rows"))
    long = (t.select("side", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in feats
    ])).alias("_kv")).select("side", "_kv.feature", "_kv.x").where(F.col("x").isNotNull()))

    # value counts per (feature, x) with one column per side, computed once
    vc = materialize(long.groupBy("feature", "x")
                     .agg(F.sum(F.when(F.col("side") == "ref", 1).otherwise(0)).cast("long").alias("n_ref"),
                          F.sum(F.when(F.col("side") == "cur", 1).otherwise(0)).cast("long").alias("n_cur")))
    # one distributed prefix sum serves the reference quantiles and KS
    ps = prefix_sum(vc, "x", ["n_ref", "n_cur"], by=["feature"])

    # PSI: interior breakpoints = reference quantiles 1/b .. (b-1)/b
    probs = [i / buckets for i in range(1, buckets)]
    bq = quantiles_from_prefix(ps, "x", "n_ref", probs, by=["feature"])
    bps = bq.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_bp"))
    bps = bps.select("feature", F.transform("_bp", lambda s: s["value"]).alias("bps"))
    bucket = F.size(F.filter(F.col("bps"), lambda b: b <= F.col("x")))
    # one row per feature: bounded, broadcast
    bc = (vc.join(F.broadcast(bps), "feature")
            .groupBy("feature", bucket.alias("bucket"))
            .agg(F.sum("n_ref").alias("b_ref"), F.sum("n_cur").alias("b_cur")))

    stats = (vc.groupBy("feature")
               .agg(F.sum("n_ref").alias("N_ref"), F.sum("n_cur").alias("N_cur"),
                    (F.sum(F.col("x") * F.col("n_ref")) / F.sum("n_ref")).alias("ref_mean"),
                    (F.sum(F.col("x") * F.col("n_cur")) / F.sum("n_cur")).alias("cur_mean")))
    e = F.greatest(F.col("b_ref") / F.col("N_ref"), F.lit(0.0))
    a = F.greatest(F.col("b_cur") / F.col("N_cur"), F.lit(0.0))
    e = F.when(e == 0, F.lit(PSI_FLOOR)).otherwise(e)
    a = F.when(a == 0, F.lit(PSI_FLOOR)).otherwise(a)
    psi = (bc.join(F.broadcast(stats.select("feature", "N_ref", "N_cur")), "feature")
             .groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi")))

    # KS: max |F_ref - F_cur| over distinct values
    ks = (ps.groupBy("feature")
            .agg(F.max(F.abs(F.col("cum_n_ref") / F.col("total_n_ref")
                             - F.col("cum_n_cur") / F.col("total_n_cur"))).alias("ks_statistic")))

    out = (stats.join(psi, "feature").join(ks, "feature").crossJoin(F.broadcast(gate))
                .where((F.col("_nref_rows") >= min_rows) & (F.col("_ncur_rows") >= min_rows)
                       & (F.col("N_ref") >= min_values) & (F.col("N_cur") >= min_values)))
    m, n = F.col("N_ref").cast("double"), F.col("N_cur").cast("double")
    en = F.sqrt(m * n / (m + n))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks_statistic")
    out = out.withColumn("ks_p_value", kolmogorov_p(lam))
    # flags use the unrounded statistics; only the reported values are rounded
    detected = (F.col("psi") > PSI_THRESHOLD) | (F.col("ks_p_value") < KS_P_THRESHOLD)
    severity = (F.when(~detected, "None").when(F.col("psi") > PSI_HIGH, "High")
                 .when(F.col("psi") > PSI_THRESHOLD, "Medium").otherwise("Low"))
    shift = (F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_mean") + 1e-9) * 100

    def rnd(c, k):
        return np_round(c, k) if digits else c

    res = out.select("feature", rnd(F.col("psi"), 4).alias("psi"),
                     rnd(F.col("ks_statistic"), 4).alias("ks_statistic"),
                     rnd(F.col("ks_p_value"), 4).alias("ks_p_value"),
                     detected.alias("drift_detected"), severity.alias("severity"),
                     rnd(F.col("ref_mean"), 2).alias("ref_mean"),
                     rnd(F.col("cur_mean"), 2).alias("cur_mean"),
                     rnd(shift, 1).alias("mean_shift_pct"))
    return res.orderBy(F.col("psi").desc(), F.col("feature"))


def drift_report(drift: DataFrame, pred_r2_drop=None, pred_alert=None) -> DataFrame:
    """One summary row for the drift-report sink (SK2): features drifted, max
    PSI, prediction R2 drop, alert flag, the feature rows as JSON, time.
    The feature table has one row per feature, so collecting it is bounded."""
    r2 = F.lit(pred_r2_drop).cast("double")
    alert = F.lit(bool(pred_alert)) if pred_alert is not None else F.lit(False)
    return drift.agg(
        F.sum(F.col("drift_detected").cast("int")).cast("int").alias("features_drifted"),
        F.max("psi").alias("max_psi"),
        r2.alias("pred_r2_drop"),
        alert.alias("drift_alert"),
        F.to_json(F.sort_array(F.collect_list(F.struct(*drift.columns)))).alias("report_json"),
        F.current_timestamp().alias("created_at"))

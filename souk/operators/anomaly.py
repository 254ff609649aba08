"""Anomaly detectors over order rows (AN1, AN2, AN5, AG17).

Scalars that every row needs (medians, IQRs, means, standard deviations) are
one-row tables broadcast to the rows -- the fact is scanned once for the
statistics and once for the flags; nothing is collected to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import safe_div
from souk.operators.ordered import column_quantiles

# fixed values: the detectors' columns
SCALED_FEATURES = ["customer_age", "log_base_price", "discount_percent",
                   "log_final_price", "log_units_sold", "log_revenue"]
ZSCORE_COLUMNS = ["revenue", "units_sold", "discount_percent"]


def robust_stats(df: DataFrame, cols: Sequence[str] = SCALED_FEATURES) -> DataFrame:
    """One row: median and IQR (q75 - q25, 0 -> 1) of each column (exact)."""
    q = column_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs = []
    for c in cols:
        sel = F.col("feature") == c
        aggs += [F.max(F.when(sel & (F.col("q") == 0.5), F.col("value"))).alias(f"_med_{c}"),
                 F.max(F.when(sel & (F.col("q") == 0.75), F.col("value"))).alias(f"_q3_{c}"),
                 F.max(F.when(sel & (F.col("q") == 0.25), F.col("value"))).alias(f"_q1_{c}")]
    return q.agg(*aggs)


def robust_scale(df: DataFrame, cols: Sequence[str] = SCALED_FEATURES, prefix: str = "rs_") -> DataFrame:
    """(x - median) / IQR for each column; a zero IQR divides by 1 (AN1)."""
    st = robust_stats(df, cols)
    out = df.crossJoin(F.broadcast(st))
    scaled = {}
    for c in cols:
        iqr = F.col(f"_q3_{c}") - F.col(f"_q1_{c}")
        iqr = F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
        scaled[f"{prefix}{c}"] = (F.col(c) - F.col(f"_med_{c}")) / iqr
    out = out.withColumns(scaled)
    return out.drop(*st.columns)


def zscore_flags(df: DataFrame, cols: Sequence[str] = ZSCORE_COLUMNS, threshold: float = 3.5,
                 out: str = "zscore_anomaly") -> DataFrame:
    """True if any present column has |x - mean| / sample std > threshold
    (AN2); missing columns are skipped, NULL counts as not anomalous."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.withColumn(out, F.lit(False))
    st = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"_mu_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"))])
    flag = F.lit(False)
    for c in cols:
        z = F.abs(safe_div(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")))
        # a non-zero deviation over a zero std is infinite
        z = F.when((F.col(f"_sd_{c}") == 0) & (F.col(c) != F.col(f"_mu_{c}")), F.lit(float("inf"))).otherwise(z)
        flag = flag | F.coalesce(z > threshold, F.lit(False))
    return df.crossJoin(F.broadcast(st)).withColumn(out, flag).drop(*st.columns)


def votes(df: DataFrame, flags: Sequence[str] = ("is_anomaly", "zscore_anomaly", "dbscan_anomaly"),
          min_votes: int = 2) -> DataFrame:
    """Sum of detector flags and ``confirmed_anomaly`` = votes >= min_votes (AN5)."""
    present = [f for f in flags if f in df.columns]
    v = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in present), F.lit(0))
    return df.withColumn("anomaly_votes", v).withColumn("confirmed_anomaly", F.col("anomaly_votes") >= min_votes)


def anomalies_by(df: DataFrame, flag: str, key: str = "category") -> DataFrame:
    """Flagged rows per key with the flagged share of the key's rows (AG17)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum(F.col(flag).cast("int")).cast("long").alias("anomalies"),
                 F.count(F.lit(1)).alias("orders"))
            .withColumn("anomaly_rate_pct", safe_div(F.col("anomalies") * 100.0, F.col("orders"))))


# ---------------------------------------------------------------- isolation forest (AN3)
def _c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def isolation_forest(df: DataFrame, cols: Sequence[str], key_cols: Sequence[str],
                     n_trees: int = 150, sample_size: int = 256, contamination: float = 0.008,
                     seed: int = 42, keep: Sequence[str] | None = None) -> DataFrame:
    """Isolation forest (AN3) over ``cols`` (e.g. robust-scaled features).

    * Sampling: rows whose hash falls under a rate sized for
      ``n_trees * sample_size`` rows form a pool; each tree draws its own
      min(``sample_size``, rows) rows from the pool by a hash of tree and row.
    * Building: ``groupBy(tree).applyInPandas`` grows each tree on its sample
      (random feature, uniform split between the node's min and max, depth
      limit ceil(log2(sample_size))).
    * Scoring: the forest, padded to complete trees (``n_trees * 2 ** depth`` places,
      a fixed bound), is broadcast; a vectorised UDF over the feature columns alone
      walks all trees of a batch level by level; score s = 2^(-E[h] / c(psi)),
      psi = rows per tree.
    * Threshold: the exact (1 - contamination) quantile of s; rows above are
      anomalies.  Adds ``iso_score`` (s), ``iso_label`` (-1 anomaly / 1) and
      ``is_anomaly`` to the columns ``keep`` (all, if not given); no others are
      written with the scores.
    """
    cols = list(cols)
    def dealt(*parts):
        return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)).cast("double") / float(1 << 40)

    # a pool of bounded size, from which every tree draws its own rows
    n = df.count()
    pool_rows = 1.3 * n_trees * sample_size
    pool = (df.withColumn("_u", dealt(F.lit(seed), *[F.col(c) for c in key_cols]))
              .where(F.col("_u") < min(1.0, pool_rows / max(n, 1))).select(*cols, "_u"))
    pool = pool.withColumn("_k", F.monotonically_increasing_id())
    from souk.operators.ordered import materialize, quantile_row
    pool = materialize(pool)
    n_pool = pool.count()
    psi = min(sample_size, n_pool)
    rate = min(1.0, (psi + 8 * math.sqrt(psi) + 8) / max(n_pool, 1))
    drawn = (pool.select(*cols, "_u", "_k", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
                 .withColumn("_v", dealt(F.lit(seed + 1), F.col("tree"), F.col("_u"), F.col("_k"))).where(F.col("_v") < rate))
    rn = F.row_number().over(Window.partitionBy("tree").orderBy("_v", "_k"))
    samples = drawn.withColumn("_r", rn).where(F.col("_r") <= sample_size).select(*cols, "tree")
    max_depth = int(math.ceil(math.log2(max(sample_size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        x = pdf[cols].to_numpy(float)
        x = np.where(np.isnan(x), 0.0, x)
        nodes = []

        def grow(idx, depth):
            nid = len(nodes)
            nodes.append([tree, nid, -1, 0.0, -1, -1, len(idx)])
            if depth >= max_depth or len(idx) <= 1:
                return nid
            sub = x[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            feats = np.flatnonzero(hi > lo)
            if len(feats) == 0:
                return nid
            f = int(rng.choice(feats))
            thr = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < thr]
            right = idx[sub[:, f] >= thr]
            nodes[nid][2], nodes[nid][3] = f, thr
            nodes[nid][4] = grow(left, depth + 1)
            nodes[nid][5] = grow(right, depth + 1)
            return nid

        grow(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    forest = samples.groupBy("tree").applyInPandas(
        build, "tree int, node int, feature int, threshold double, left int, right int, size long")
    # bounded model: n_trees * (2 * sample_size - 1) nodes at most
    model = forest.toPandas().sort_values(["tree", "node"])
    c_psi = float(_c_factor([max(psi, 2)])[0])
    bc = df.sparkSession.sparkContext.broadcast(_padded(model, max_depth))

    @F.pandas_udf(T.DoubleType())
    def iso_score(*xs: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([s.to_numpy(float) for s in xs]), nan=0.0, posinf=np.inf, neginf=-np.inf)
        return pd.Series(np.power(2.0, -_path_lengths(x, *bc.value) / c_psi))

    # only the features travel through Python
    score = iso_score(*[F.col(c).cast("double") for c in cols]).alias("iso_score")
    scored = materialize(df.select(*(df.columns if keep is None else keep), score))
    th = quantile_row(scored, "iso_score", {"_thr": 1.0 - contamination})
    out = scored.crossJoin(F.broadcast(th))
    flag = F.col("iso_score") > F.col("_thr")
    return (out.withColumn("is_anomaly", flag)
               .withColumn("iso_label", F.when(flag, F.lit(-1)).otherwise(F.lit(1)))
               .drop("_thr"))


def _padded(model, depth: int):
    """The trees as arrays of complete binary trees: (features, thresholds) of the inner
    places, level by level, and the path length at each place of the last level.  Below a
    leaf all places hold the leaf's path length, so whichever way a row goes there is right."""
    trees = [g.reset_index(drop=True) for _, g in model.groupby("tree")]
    feature = np.zeros((len(trees), 2 ** depth - 1), np.int64)
    threshold = np.zeros((len(trees), 2 ** depth - 1))
    path = np.zeros((len(trees), 2 ** depth))
    for k, g in enumerate(trees):
        rows = list(zip(g["feature"], g["threshold"], g["left"], g["right"], _c_factor(g["size"].to_numpy())))
        todo = [(0, 0, 0)]                      # node, its place, its level
        while todo:
            node, place, level = todo.pop()
            f, thr, left, right, rest = rows[node]
            if f >= 0:
                feature[k, place], threshold[k, place] = f, thr
                todo += [(left, 2 * place + 1, level + 1), (right, 2 * place + 2, level + 1)]
            else:
                span = 2 ** (depth - level)
                first = (place - (2 ** level - 1)) * span
                path[k, first:first + span] = level + rest
    return feature, threshold, path


def _path_lengths(x, feature, threshold, path, rows: int = 1024):
    """Mean path length of each row over all trees, all trees walked at once."""
    n_trees, inner = feature.shape
    base = (np.arange(n_trees) * inner)[None, :]
    feature, threshold = feature.ravel(), threshold.ravel()
    out = np.empty(len(x))
    for lo in range(0, len(x), rows):
        part = np.ascontiguousarray(x[lo:lo + rows])
        flat, at = part.ravel(), (np.arange(len(part)) * x.shape[1])[:, None]
        place = np.zeros((len(part), n_trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = place + base
            place = 2 * place + 1 + (flat[at + feature[node]] >= threshold[node])
        place -= inner
        out[lo:lo + rows] = path.ravel()[place + (np.arange(n_trees) * (inner + 1))[None, :]].mean(axis=1)
    return out

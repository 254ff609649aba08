"""Ordered operators: distributed prefix sums, exact quantiles, Pareto, Lorenz,
ECDF, rolling statistics and lag-based growth.

A global ``Window.orderBy`` without ``partitionBy`` moves every row into one
task.  ``prefix_sum`` avoids that: rows are range-partitioned on the ordering
key (hot groups are split across partitions by value) into pieces whose number
follows the counted rows, sorted, and scanned in the same stage; per-piece totals
-- one row per group and piece -- give the offsets that are added back.  The
scanned rows are checkpointed, so that both readers see the same pieces and the
job resumes from them after an executor loss.

``quantiles`` ranks only a small part of the rows: an approximate pass brackets
every target rank, a second pass counts the rows below each bracket, and only
rows inside the brackets are counted by value and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.session import ensure_checkpoint_dir

PIECE_ROWS = 250_000        # rows of a range piece, on average
BROADCAST_ROWS = 100_000    # largest counted table that is broadcast
ACCURACY = 1_000            # an approximate quantile is off by 1 / ACCURACY of the rows at most
SMALL_GROUP = 4_096         # groups up to this size are bracketed by their minimum and maximum


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose rows were counted; none above ``BROADCAST_ROWS``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _group_starts(b: pa.RecordBatch, n_by: int) -> np.ndarray:
    """Rows of the batch, beyond the first, whose first ``n_by`` columns differ from the row before."""
    change = np.zeros(max(b.num_rows - 1, 0), bool)
    for i in range(n_by):
        codes = b.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.flatnonzero(change) + 1


def _scan(n_by: int, weights: Sequence[int], names: Sequence[str]):
    """Adds the piece and the running sum of each weight column within each run of equal groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, carry = TaskContext.get().partitionId(), None, [0] * len(weights)
        for b in batches:
            if not b.num_rows:
                continue
            starts = _group_starts(b, n_by)
            ends = [*starts.tolist(), b.num_rows]
            first = repr([b.column(i)[0].as_py() for i in range(n_by)])
            if first != last:
                carry = [0] * len(weights)
            last = repr([b.column(i)[b.num_rows - 1].as_py() for i in range(n_by)])
            sums = []
            for k, w in enumerate(weights):
                x = b.column(w).fill_null(0).to_numpy(zero_copy_only=False)
                x = x.astype(np.int64) if x.dtype.kind in "iu" else x.astype(np.float64)
                x[0] += carry[k]
                out, lo = np.empty_like(x), 0
                for hi in ends:
                    np.cumsum(x[lo:hi], out=out[lo:hi])
                    lo = hi
                carry[k] = out[-1]
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, piece, np.int32)), *sums], names=list(names))
    return run


def scanned_pieces(df: DataFrame, order: Sequence, weights: Sequence[str], by: Sequence[str], p: int) -> DataFrame:
    """``df`` in p sorted range pieces with ``_piece`` and the running sums ``_local_<w>``
    inside each (group, piece): one exchange, the scan runs in its reading stage."""
    cols = [*by, *[c for c in df.columns if c not in by]]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    local = [T.StructField(f"_local_{w}", T.LongType() if isinstance(kinds[w], T.IntegralType) else T.DoubleType()) for w in weights]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in cols] + [T.StructField("_piece", T.IntegerType()), *local])
    ranged = df.select(cols).repartitionByRange(p, *[F.col(c) for c in by], *order) \
        .sortWithinPartitions(*[F.col(c) for c in by], *order)
    return ranged.mapInArrow(_scan(len(by), [cols.index(w) for w in weights], schema.names), schema)


def prefix_sum(df: DataFrame, order, weights: Sequence[str],
               by: Sequence[str] = (), partitions: int | None = None,
               prefix: str = "cum_") -> DataFrame:
    """Add inclusive running sums ``cum_<w>`` of each weight column (whole numbers
    or doubles; null counts as 0) within each ``by`` group, ordered by ``order`` (a
    column name, a Column, or a list of them, e.g. ``[F.desc('v'), F.asc('k')]``),
    plus group totals ``total_<w>``.

    ``(by, order)`` should be unique (compress with a ``groupBy`` first); then
    the result is deterministic.
    """
    by, weights = list(by), list(weights)
    order = [F.col(o) if isinstance(o, str) else o
             for o in (order if isinstance(order, (list, tuple)) else [order])]
    df = materialize(df)        # counted, sampled for the ranges, and then moved
    p = partitions or max(1, -(-df.count() // PIECE_ROWS))
    scanned = materialize(scanned_pieces(df, order, weights, by, p))

    pieces = scanned.groupBy(*by, "_piece").agg(*[F.sum(w).alias(f"_piece_{w}") for w in weights])
    w_off = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = pieces.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_piece").alias("_at"),
        *[F.coalesce(F.sum(f"_piece_{w}").over(w_off), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_piece_{w}").over(w_all).alias(f"total_{w}") for w in weights])
    if not by:
        # One row per range piece: a proven bound, safe to broadcast.
        offsets = F.broadcast(offsets)
    on = F.col("_piece") == F.col("_at")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return scanned.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"_local_{w}") + F.col(f"_off_{w}")).alias(f"{prefix}{w}") for w in weights],
        *[F.col(f"total_{w}") for w in weights])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), weight: str = "w") -> DataFrame:
    """(by, value, count) with NULL values dropped; map-side combined."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(*by, col).agg(F.count(F.lit(1)).alias(weight)))


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
              partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas/numpy default, DuckDB
    ``quantile_cont``) of ``col`` per ``by`` group: one row per (group, q)
    with columns ``by..., q, value``.  Rows of a null group take no part."""
    return column_quantiles(df, {col: probs}, by, partitions).drop("feature")


def column_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]], by: Sequence[str] = (),
                     partitions: int | None = None) -> DataFrame:
    """Exact quantiles of several columns at once: (by..., feature, q, value).

    Three scans of the columns, none of which shuffles rows: approximate quantiles
    bracket every target rank, map-side counts place the brackets, and the rows
    inside (some 4 / ``ACCURACY`` of them per target, equal values counted) are ranked.
    Groups whose bracket misses its target are ranked in full."""
    by, cols = list(by), list(probs)
    kept = [F.col(c).isNotNull() for c in by]
    df = df.select(*by, *cols)
    for k in kept:
        df = df.where(k)
    one_type = len(cols) == 1
    xs = {c: F.col(c) if one_type else F.col(c).cast("double") for c in cols}
    targets = [(t, c, q) for t, (c, q) in enumerate((c, float(q)) for c in cols for q in probs[c])]

    margin = 2 / ACCURACY
    aggs = []
    for i, c in enumerate(cols):
        asked = [min(max(q + s * margin, 0.0), 1.0) for _, d, q in targets if d == c for s in (-1, 1)]
        aggs += [F.count(xs[c]).alias(f"_n{i}"), F.min(xs[c]).alias(f"_min{i}"), F.max(xs[c]).alias(f"_max{i}"),
                 F.percentile_approx(xs[c], asked, ACCURACY).alias(f"_a{i}")]
    rough = df.groupBy(*by).agg(*aggs)
    brackets, at = [F.col(f"_n{i}") for i in range(len(cols))], dict.fromkeys(cols, 0)
    for t, c, _ in targets:
        i, k = cols.index(c), at[c]
        at[c] += 2
        small_group = F.col(f"_n{i}") <= SMALL_GROUP
        brackets += [F.when(small_group, F.col(f"_min{i}")).otherwise(F.get(f"_a{i}", F.lit(k))).alias(f"_lo{t}"),
                     F.when(small_group, F.col(f"_max{i}")).otherwise(F.get(f"_a{i}", F.lit(k + 1))).alias(f"_hi{t}")]
    rough = materialize(rough.select(*by, *brackets))
    groups = rough.count() if by else 1

    placed = _attach(df, rough, groups, by)
    below = placed.groupBy(*by).agg(
        *[F.count_if(xs[c] < F.col(f"_lo{t}")).alias(f"_below{t}") for t, c, _ in targets],
        *[F.count_if(xs[c] <= F.col(f"_hi{t}")).alias(f"_upto{t}") for t, c, _ in targets])
    facts = materialize(_attach(rough, below, groups, by))
    missed, inside_rows = F.lit(False), F.lit(0).cast("long")
    for t, c, q in targets:
        h = F.lit(q) * (F.col(f"_n{cols.index(c)}") - 1)
        missed |= (F.col(f"_n{cols.index(c)}") > 0) & ((F.floor(h) < F.col(f"_below{t}")) | (F.ceil(h) >= F.col(f"_upto{t}")))
        inside_rows += F.col(f"_upto{t}") - F.col(f"_below{t}")
    told = facts.agg(F.count_if(missed).alias("missed"), F.sum(inside_rows).alias("inside")).first()

    # a value counts once for its column, whichever brackets it lies in
    lo, hi = ({t: F.col(f"_{end}{t}") for t, _, _ in targets} for end in ("lo", "hi"))
    each = []
    for i, c in enumerate(cols):
        inside = F.lit(False)
        for t in (t for t, d, _ in targets if d == c):
            inside |= xs[c].between(lo[t], hi[t])
        each.append(F.when(inside, F.struct(F.lit(i).alias("c"), xs[c].alias("x"))))
    rows = _attach(df, facts.where(~missed), groups, by).select(*by, F.explode(F.array(*each)).alias("_e")).where(F.col("_e").isNotNull())
    counts = rows.groupBy(*by, F.col("_e.c").alias("_c"), F.col("_e.x").alias("_x")).agg(F.count(F.lit(1)).alias("_w"))
    n_counts = told["inside"] or 0
    if n_counts > PIECE_ROWS or partitions:
        counts = materialize(counts)
        n_counts = counts.count() * max(len(probs[c]) for c in cols)
    goals = facts.where(~missed).select(*by, F.explode(F.array(*[
        F.struct(F.lit(t).alias("_t"), F.lit(cols.index(c)).alias("_c"), F.lit(c).alias("feature"), F.lit(q).alias("q"),
                 lo[t].alias("_lo"), hi[t].alias("_hi"), F.col(f"_below{t}").alias("_below"),
                 (F.lit(q) * (F.col(f"_n{cols.index(c)}") - 1)).alias("_h")) for t, c, q in targets])).alias("_g")).select(*by, "_g.*")
    placed = counts.join(small(goals, groups * len(targets)), [*by, "_c"]).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    placed = placed.select(*by, "_t", "feature", "q", "_x", "_w", "_below", "_h")
    if n_counts <= PIECE_ROWS and not partitions:
        w = Window.partitionBy(*by, "_t").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = placed.withColumn("cum__w", F.sum("_w").over(w))        # counted: a single piece at most
    else:
        ranked = prefix_sum(placed, "_x", ["_w"], [*by, "_t"], partitions)
    before = F.col("_below") + F.col("cum__w")
    out = _interpolated(ranked, F.col("_x"), before - F.col("_w"), before - 1, F.col("_h"), [*by, "feature", "q"])
    if told["missed"]:
        left = df.join(small(facts.where(missed).select(*by), groups), by, "left_semi") if by else df
        for c in cols:
            ps = prefix_sum(value_counts(left, c, by, "_w"), c, ["_w"], by, partitions)
            exact = quantiles_from_prefix(ps, c, "_w", list(probs[c]), by)
            out = out.unionByName(exact.select(*by, F.lit(c).alias("feature"), "q", "value"))
    return out


def _attach(df: DataFrame, facts: DataFrame, rows: int, by: Sequence[str]) -> DataFrame:
    """``df`` with its group's row of ``facts`` (of ``rows`` rows; a single one without groups)."""
    return df.join(small(facts, rows), list(by)) if by else df.crossJoin(F.broadcast(facts))


def _interpolated(rows: DataFrame, x, start, end, h, keys: Sequence[str]) -> DataFrame:
    """(keys..., value): a row of value x holds the ranks start to end; h is the rank asked for."""
    lo, hi = F.floor(h), F.ceil(h)
    hit_lo, hit_hi = (lo >= start) & (lo <= end), (hi >= start) & (hi <= end)
    agg = rows.where(hit_lo | hit_hi).groupBy(*keys).agg(
        F.max(F.when(hit_lo, x)).alias("_xlo"), F.max(F.when(hit_hi, x)).alias("_xhi"), F.first(h).alias("_h0"))
    frac = F.col("_h0") - F.floor("_h0")
    return agg.select(*keys, (F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * frac).alias("value"))


def quantiles_from_prefix(ps: DataFrame, col: str, weight: str, probs: Sequence[float],
                          by: Sequence[str] = ()) -> DataFrame:
    """Quantiles from a ``prefix_sum`` result over (by, value) counts: a value
    holds the 0-based ranks [cum - w, cum - 1]; rows with weight 0 hold none,
    so one prefix sum with several weight columns serves several samples."""
    by = list(by)
    n = F.col(f"total_{weight}")
    targets = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (n - 1)).alias("h"))
        for q in probs])
    t = (ps.where(F.col(weight) > 0)
           .select(*by, col, (F.col(f"cum_{weight}") - F.col(weight)).alias("_s"), (F.col(f"cum_{weight}") - 1).alias("_e"),
                   F.explode(targets).alias("_t"))
           .select(*by, F.col(col).alias("_x"), "_s", "_e", F.col("_t.q").alias("q"), F.col("_t.h").alias("_h")))
    return _interpolated(t, F.col("_x"), F.col("_s"), F.col("_e"), F.col("_h"), [*by, "q"])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster checkpoint folder and read it back:
    cuts the lineage (an executor loss resumes from here) and lets several
    consumers share one computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dematerialize(df: DataFrame) -> None:
    """Delete the files of a table as ``materialize`` returned it, which is not read again:
    not every session removes unreferenced checkpoints."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def quantile_row(df: DataFrame, col: str, probs: dict[str, float]) -> DataFrame:
    """One-row table of named global quantiles, e.g. ``{'p95': .95}``."""
    q = quantiles(df, col, list(probs.values()))
    return q.agg(*[F.max(F.when(F.col("q") == float(v), F.col("value"))).alias(k)
                   for k, v in probs.items()])


def pareto(df: DataFrame, group_col: str, value_col: str = "revenue",
           threshold: float = 80.0) -> DataFrame:
    """Group totals sorted descending with cumulative share (%) and the rank at
    which the share first reaches ``threshold`` (``crosses_80``).

    Ranks and running sums come from ``prefix_sum`` over the aggregated table,
    so a high-cardinality key (e.g. customers) is not sorted in one task.
    """
    agg = (df.where(F.col(group_col).isNotNull())
             .groupBy(group_col).agg(F.coalesce(F.sum(value_col), F.lit(0.0)).alias(value_col),
                                     F.lit(1).alias("_one")))
    order = [F.col(value_col).desc(), F.col(group_col).asc()]
    ps = prefix_sum(agg, order, [value_col, "_one"])
    cum, total = F.col(f"cum_{value_col}"), F.col(f"total_{value_col}")
    out = ps.select(group_col, value_col, F.col("cum__one").cast("int").alias("rank"),
                    F.try_divide(cum * 100, total).alias("cumulative_pct"),
                    F.try_divide((cum - F.col(value_col)) * 100, total).alias("_prev_pct"))
    return out.select(group_col, value_col, "rank", "cumulative_pct",
                      ((F.col("_prev_pct") < threshold) & (F.col("cumulative_pct") >= threshold))
                      .alias("crosses_80"))


def lorenz(df: DataFrame, col: str = "revenue") -> DataFrame:
    """Ascending Lorenz curve: one point per distinct value (the end of its run
    of ties) with the cumulative share of rows and of the value total."""
    vc = (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("s")))
    ps = prefix_sum(vc, col, ["n", "s"])
    return ps.select(col, (F.col("cum_n") / F.col("total_n")).alias("population_share"),
                     F.try_divide(F.col("cum_s"), F.col("total_s")).alias("value_share"))


def gini(df: DataFrame, col: str = "revenue") -> DataFrame:
    """One row: ``gini`` from the ascending Lorenz curve through (0, 0) and
    (i/n, L_i); ``reference_gini`` = 1 - 2 * trapezoid area of the descending
    cumulative share over n equally spaced points (the printed formula, which
    is <= 0 for any non-constant input); ``n`` rows, ``total``.
    """
    vc = (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("s")))
    ps = prefix_sum(vc, col, ["n"])
    w, x = F.col("n").cast("double"), F.col(col)
    p = F.col("cum_n") - F.col("n")                      # first ascending position (0-based)
    # sum over the run of positions a = p..p+w-1 of (a + 1)
    asc_weight = w * p + w * (w + 1) / 2
    agg = ps.agg(
        F.sum(x * asc_weight).alias("_sa"),              # sum_a (a+1) * v_(a)
        F.sum(x * w).alias("total"),
        F.sum("n").alias("n"),
        F.max(x).alias("_max"))
    n = F.col("n").cast("double")
    total = F.col("total")
    std = F.try_divide(2 * F.col("_sa"), n * total) - (n + 1) / n
    # descending cumulative shares: sum_i S'_i = sum_a (a+1) v_(a)
    trap = F.try_divide(F.try_divide(F.col("_sa"), total) - (F.try_divide(F.col("_max"), total) + 1) / 2,
                        n - 1)
    return agg.select(std.alias("gini"), (1 - 2 * trap).alias("reference_gini"),
                      F.col("n"), total.alias("total"))


def ecdf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Empirical CDF of several columns in one job: (feature, value, ecdf)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("_kv")).select("_kv.feature", "_kv.value")
    vc = value_counts(long, "value", ["feature"], "n")
    ps = prefix_sum(vc, "value", ["n"], ["feature"])
    return ps.select("feature", "value", (F.col("cum_n") / F.col("total_n")).alias("ecdf"))


def rolling_stats(series: DataFrame, key: str, value: str, width: int = 3) -> DataFrame:
    """Centered rolling mean and sample std over an ordered (small) series;
    NULL unless the frame is full (pandas min_periods = window)."""
    half = width // 2
    w = Window.orderBy(key).rowsBetween(-half, width - 1 - half)
    full = F.count(F.col(value)).over(w) == width
    return series.select(key, value,
                         F.when(full, F.avg(value).over(w)).alias("rolling_mean"),
                         F.when(full, F.stddev_samp(value).over(w)).alias("rolling_std"))


def growth(series: DataFrame, key: str, value: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Period-over-period growth in percent (NULL for the first period or a
    zero previous value)."""
    w = Window.partitionBy(*partition_by).orderBy(key)
    prev = F.lag(value).over(w)
    return series.select(*partition_by, key, value, prev.alias("previous"),
                         F.try_divide((F.col(value) - prev) * 100, F.nullif(prev, F.lit(0)))
                         .alias("growth_pct"))


def latest_delta(series: DataFrame, key: str, value: str) -> DataFrame:
    """Last value and its change from the previous one (one row)."""
    g = growth(series, key, value)
    w = Window.orderBy(F.col(key).desc())
    return (g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
             .select(key, value, (F.col(value) - F.col("previous")).alias("delta")))


def last_k(series: DataFrame, key: str, k: int) -> DataFrame:
    """The k latest rows of a series (a top-k on the key)."""
    return series.orderBy(F.col(key).desc()).limit(k)


def first_in_group(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    """Attach the smallest ``col`` of each ``group`` to every row.

    A map-side-combined ``min`` per group joined back on the group key (rather
    than a window over the group, which would put a hot group in one task);
    AQE splits a skewed key on the fact side of the join.
    """
    firsts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(col).alias(out))
    return df.join(firsts, on=group, how="inner")


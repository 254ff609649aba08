"""Regression models on the order fact with ``pyspark.ml`` (ML1-ML6, ML8, DR4,
SO1).

* Feature pipeline: numeric columns standardised, categorical columns one-hot
  encoded; a category unseen at fit time encodes to all zeros (the indexer
  puts it in an extra last bucket, which the encoder drops).
* Train/test split by a hash of the row, not a shuffled index: stable under
  re-partitioning and executor retries.
* Metrics (RMSE, MAE, R2) are one aggregate over (label, prediction).

Differences from single-machine libraries, kept on purpose: the scaler uses
the sample standard deviation; tree learners bin continuous features
(``maxBins``); boosted trees are those of Spark's GBT (squared loss).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions import np_round
from souk.operators import trees as TR
from souk.operators.ordered import materialize
from souk.session import ensure_checkpoint_dir

# fixed values: the model's input columns
CAT_FEATURES = ["state", "zone", "category", "brand_type", "customer_gender",
                "sales_event", "competition_intensity", "inventory_pressure"]
NUM_FEATURES = ["customer_age", "base_price", "discount_percent", "year", "month", "weekday"]
TARGET = "revenue"


def feature_stages(cat: Sequence[str] = CAT_FEATURES, num: Sequence[str] = NUM_FEATURES,
                   out: str = "features") -> list:
    """Indexers, one-hot encoder, numeric assembler + scaler, final assembler (ML1).

    ``model_input`` leaves out rows that lack a number, as a scaler can't use them."""
    cat, num = list(cat), list(num)
    num_vec = VectorAssembler(inputCols=num, outputCol="__num", handleInvalid="keep")
    scaler = StandardScaler(inputCol="__num", outputCol="__num_s", withMean=True, withStd=True)
    if not cat:
        return [num_vec, scaler, VectorAssembler(inputCols=["__num_s"], outputCol=out)]
    # one multi-column indexer: all label sets are found in a single pass
    idx = [StringIndexer(inputCols=cat, outputCols=[f"{c}__idx" for c in cat], handleInvalid="keep",
                         stringOrderType="alphabetAsc")]
    # the indexer's "keep" bucket is the last category; dropping the last
    # one-hot slot makes an unseen value all zeros while every seen value
    # keeps its own slot
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__oh" for c in cat],
                        dropLast=True)
    final = VectorAssembler(inputCols=["__num_s", *[f"{c}__oh" for c in cat]], outputCol=out)
    return [*idx, ohe, num_vec, scaler, final]


def model_input(df: DataFrame, cat=CAT_FEATURES, num=NUM_FEATURES, target: str = TARGET) -> DataFrame:
    """The model's columns, numbers as doubles.  Rows without target or without one of
    the numbers (null or NaN) are left out: one of them would turn the scaler's mean,
    and with it every prediction, into NaN.  A null category is a value of its own."""
    numbers = [*num, target]
    out = df.select(*cat, *[F.col(c).cast("double").alias(c) for c in numbers])
    for c in numbers:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    return out


def split(df: DataFrame, key_cols: Sequence[str], train_pct: int = 80, seed: int = 42):
    """Deterministic hash split on the row key: (train, test) (ML2)."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]), F.lit(100))
    return df.where(bucket < train_pct), df.where(bucket >= train_pct)


def regressors(seed: int = 42, trees: int = 100) -> dict:
    """The four model families and their settings (ML3); ``trees`` is that of both ensembles."""
    return {
        "Linear Regression": LinearRegression(featuresCol="features", labelCol=TARGET),
        "Decision Tree": DecisionTreeRegressor(featuresCol="features", labelCol=TARGET, maxDepth=8, seed=seed),
        "Random Forest": RandomForestRegressor(featuresCol="features", labelCol=TARGET, numTrees=trees,
                                               maxDepth=10, featureSubsetStrategy="all", seed=seed),
        "Boosted Trees": GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=trees, maxDepth=6,
                                      stepSize=0.1, seed=seed),
    }


def fit(train: DataFrame, estimator, cat=CAT_FEATURES, num=NUM_FEATURES) -> PipelineModel:
    return Pipeline(stages=[*feature_stages(cat, num), estimator]).fit(train)


def metrics(pred: DataFrame, label: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, R2 of one prediction table as a one-row aggregate (ML4)."""
    y, p = F.col(label), F.col(prediction)
    a = pred.agg(F.sum((y - p) * (y - p)).alias("_sse"), F.sum(F.abs(y - p)).alias("_sae"),
                 F.count(F.lit(1)).alias("_n"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return a.select(F.sqrt(F.col("_sse") / F.nullif(F.col("_n"), F.lit(0))).alias("rmse"),
                    F.try_divide(F.col("_sae"), F.col("_n")).alias("mae"),
                    (1 - F.try_divide(F.col("_sse"), F.nullif(F.col("_sst"), F.lit(0.0)))).alias("r2"),
                    F.col("_n").alias("n"))


def residuals(pred: DataFrame, label: str = TARGET, prediction: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    """Actual vs predicted with residual = actual - predicted, after the columns ``keep`` (ML5)."""
    return pred.select(*keep, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                       (F.col(label) - F.col(prediction)).alias("residual"))


def _grown(rows: DataFrame, lay: TR.Layout, estimators: dict, seed: int) -> dict[str, tuple[list[TR.Tree], list[float]]]:
    """Trees and their weights of each estimator over ``rows`` (``trees.blocks``), with its settings."""
    out, depths, bag, parts = {}, [], [], {}
    for name, est in estimators.items():
        if isinstance(est, GBTRegressor):
            out[name] = TR.boost(rows, lay, est.getMaxIter(), est.getMaxDepth(), est.getStepSize())
            continue
        n = est.getNumTrees() if isinstance(est, RandomForestRegressor) else 1
        parts[name] = (len(depths), len(depths) + n)
        depths += [est.getMaxDepth()] * n
        bag += [seed + k for k in range(n)] if isinstance(est, RandomForestRegressor) else [None]
    trees = TR.grow(rows, lay, depths, bag) if depths else []
    return out | {name: (trees[lo:hi], [1 / (hi - lo)] * (hi - lo)) for name, (lo, hi) in parts.items()}


def compare_models(df: DataFrame, key_cols: Sequence[str], names: Sequence[str] | None = None,
                   seed: int = 42, trees: int = 100) -> DataFrame:
    """Fit the chosen model families on the 80 % split and report test
    metrics per model (ML2-ML4).

    Labels, scaling and encoding are fitted once, and the encoded table is written
    once: all families read it, and the models' predictions are told together in one
    aggregate over the test rows.  Trees are grown by ``trees.grow`` with the
    estimators' settings: over the label indexes instead of their one-hot slots, and
    the single tree and the forest level by level together."""
    spark, folder = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/models-{uuid.uuid4().hex}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    keyed = written(df.select(*key_cols, *[c for c in (*CAT_FEATURES, *NUM_FEATURES, TARGET) if c not in key_cols]), "keyed")
    train, test = split(keyed, key_cols, seed=seed)
    train, test = model_input(train), model_input(test)
    encoder = Pipeline(stages=feature_stages()).fit(train)
    wanted = {name: est for name, est in regressors(seed, trees).items() if names is None or name in names}
    indexes = [f"{c}__idx" for c in CAT_FEATURES]
    grown = {f"_p{i}": est for i, est in enumerate(wanted.values()) if not isinstance(est, LinearRegression)}
    inputs = [*NUM_FEATURES, *indexes] if grown else []
    train, test = (written(encoder.transform(x).select("features", TARGET, *inputs), name) for x, name in ((train, "train"), (test, "test")))
    for i, est in enumerate(wanted.values()):
        if f"_p{i}" not in grown:
            test = est.setPredictionCol(f"_p{i}").fit(train.select("features", TARGET)).transform(test)
    test = test.drop("features")
    if grown:
        labels = [len(x) for x in encoder.stages[0].labelsArray]
        lay = TR.layout(train, NUM_FEATURES, indexes, labels, next(iter(grown.values())).getMaxBins(), seed)
        test = TR.predict(test, lay, _grown(TR.blocks(train, lay, TARGET), lay, grown, seed))
    out = None
    y = F.col(TARGET)
    sums = [a for i in range(len(wanted)) for a in (F.sum((y - F.col(f"_p{i}")) ** 2).alias(f"_sse{i}"),
                                                    F.sum(F.abs(y - F.col(f"_p{i}"))).alias(f"_sae{i}"))]
    told = materialize(test.agg(F.count(F.lit(1)).alias("n"), (F.var_pop(y) * F.count(y)).alias("_sst"), *sums))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for i, name in enumerate(wanted):
        m = told.select(F.lit(name).alias("model"), F.sqrt(F.try_divide(f"_sse{i}", F.nullif("n", F.lit(0)))).alias("rmse"),
                        F.try_divide(f"_sae{i}", "n").alias("mae"),
                        (1 - F.try_divide(f"_sse{i}", F.nullif("_sst", F.lit(0.0)))).alias("r2"), "n")
        out = m if out is None else out.unionByName(m)
    return out


def score(model: PipelineModel, orders: DataFrame, cat=CAT_FEATURES, num=NUM_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring of order rows (ML6): the model's inputs, the columns ``keep`` and
    ``predicted_revenue``.  Rows that lack one of the numbers are not scored."""
    rows = orders.select(*keep, *[c for c in cat if c not in keep], *[F.col(c).cast("double").alias(c) for c in num if c not in keep])
    for c in num:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return model.transform(rows).select(*rows.columns, F.col("prediction").alias("predicted_revenue"))


def linear_attribution(model: PipelineModel, data: DataFrame, top_n: int = 15, num=NUM_FEATURES) -> DataFrame:
    """Mean |coef * (x - mean)| per encoded feature of a linear model (exact
    additive attribution under feature independence) (ML8), the ``top_n`` largest:
    (feature, mean_abs).

    One row of means and one row of mean deviations, each a plain aggregate over
    the encoded slots (their number is that of the model's coefficients)."""
    from pyspark.ml.functions import vector_to_array
    coefs = [float(c) for c in model.stages[-1].coefficients]   # one per encoded feature
    enc = model.transform(data)
    names = _slot_names(enc.schema["features"].metadata, len(coefs), list(num))
    x = enc.select(vector_to_array("features").alias("x"))
    used = [j for j, c in enumerate(coefs) if c != 0.0]
    if not used:
        return data.sparkSession.createDataFrame([], "feature string, mean_abs double")
    means = x.agg(*[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in used])
    parts = x.crossJoin(F.broadcast(means)).agg(
        *[F.avg(F.abs(F.get("x", F.lit(j)) - F.col(f"m{j}"))).alias(f"d{j}") for j in used])
    rows = F.array(*[F.struct(F.lit(names[j]).alias("feature"), (F.col(f"d{j}") * abs(coefs[j])).alias("mean_abs")) for j in used])
    return parts.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.col("mean_abs").desc(), "feature").limit(top_n)


def _slot_names(metadata: dict, n: int, num: list[str]) -> list[str]:
    """Names of the encoded slots from the assembler's attributes; the scaled
    numeric vector numbers its slots in the order of ``num``."""
    names = [f"slot {j}" for j in range(n)]
    for group in metadata.get("ml_attr", {}).get("attrs", {}).values():
        for a in group:
            name = a.get("name", names[a["idx"]])
            scaled = name.removeprefix("__num_s_")
            names[a["idx"]] = num[int(scaled)] if scaled != name and scaled.isdigit() else name
    return names


# fixed values: the drift model's input columns
PRED_DRIFT_NUM = ["base_price", "discount_percent", "units_sold", "month", "weekday"]
PRED_DRIFT_CAT = ["category", "zone", "brand_type", "sales_event"]


def label_codes(df: DataFrame, cols: Sequence[str] = PRED_DRIFT_CAT) -> DataFrame:
    """(feature, label, code): the labels of each column over all rows given, numbered
    from 0 in alphabetical order (SO1).  Null is no label.

    One row per label; the indexer's model is what numbers them, so these are the codes
    that a model trained on the columns has seen."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_enc" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep")
    found = idx.fit(df).labelsArray
    rows = [(c, label, k) for c, labels in zip(cols, found) for k, label in enumerate(labels)]
    return df.sparkSession.createDataFrame(rows, "feature string, label string, code int")


def prediction_drift(df: DataFrame, reference_months: int = 6, current_months: int = 3,
                     min_ref: int = 100, min_cur: int = 50, r2_alert: float = 0.05,
                     seed: int = 42) -> DataFrame:
    """Boosted trees (50 trees, depth 4) trained on the reference window and
    scored on both windows: R2 / MAE per window, R2 drop and alert (DR4).
    Category codes are fitted on both windows together (SO1: the union is
    the tagged table itself).  No rows when a window is too small."""
    from souk.operators.drift import tag_windows
    from souk.operators.ordered import materialize
    # the two windows are read by the size gate, the indexer, the boosted
    # trees (many passes) and both metric passes: materialise them once
    t = materialize(tag_windows(df.select("order_date", TARGET, *PRED_DRIFT_CAT,
                                          *[c for c in PRED_DRIFT_NUM if c in df.columns]),
                                reference_months, current_months))
    sizes = t.groupBy().agg(F.sum((F.col("side") == "ref").cast("int")).alias("n_ref"),
                            F.sum((F.col("side") == "cur").cast("int")).alias("n_cur")).first()
    if sizes is None or (sizes.n_ref or 0) < min_ref or (sizes.n_cur or 0) < min_cur:
        return df.sparkSession.createDataFrame(
            [], "ref_r2 double, cur_r2 double, ref_mae double, cur_mae double, r2_drop double, drift_alert boolean")
    idx = [StringIndexer(inputCols=PRED_DRIFT_CAT, outputCols=[f"{c}_enc" for c in PRED_DRIFT_CAT],
                         stringOrderType="alphabetAsc", handleInvalid="keep")]
    enc = Pipeline(stages=idx).fit(t)
    te = enc.transform(t).withColumn(TARGET, F.col(TARGET).cast("double"))
    for c in PRED_DRIFT_NUM:
        te = te.withColumn(c, F.col(c).cast("double"))
    asm = VectorAssembler(inputCols=[*PRED_DRIFT_NUM, *[f"{c}_enc" for c in PRED_DRIFT_CAT]],
                          outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=50, maxDepth=4, stepSize=0.1,
                       seed=seed)
    model = Pipeline(stages=[asm, gbt]).fit(te.where(F.col("side") == "ref"))
    return window_drift(model.transform(te), r2_alert)


def window_drift(pred: DataFrame, r2_alert: float = 0.05) -> DataFrame:
    """R2 and MAE of predictions on the reference and the current rows (``side``), the
    drop of R2 and the alert: one row, from one aggregate over both windows (DR4)."""
    y, p = F.col(TARGET), F.col("prediction")
    sides = pred.groupBy("side").agg(
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    j = sides.agg(of("ref", "r2"), of("ref", "mae"), of("cur", "r2"), of("cur", "mae"))
    drop = F.col("ref_r2") - F.col("cur_r2")
    return j.select(np_round("ref_r2", 3).alias("ref_r2"), np_round("cur_r2", 3).alias("cur_r2"),
                    np_round("ref_mae", 0).alias("ref_mae"), np_round("cur_mae", 0).alias("cur_mae"),
                    np_round(drop, 3).alias("r2_drop"), (drop > r2_alert).alias("drift_alert"))


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str],
                           key_cols: Sequence[str], repeats: int = 7, seed: int = 42,
                           label: str = TARGET) -> DataFrame:
    """Mean and std over ``repeats`` of the R2 drop when one input column is
    permuted (ML7).  Linear models of ``feature_stages`` take an exact
    shortcut: a permuted prediction is the prediction minus the feature's
    contribution plus the donor row's contribution, so only per-row
    contributions are permuted; other models are re-scored."""
    from pyspark.ml.regression import LinearRegressionModel
    if isinstance(model.stages[-1], LinearRegressionModel):
        return _linear_permutation_importance(model, test, features, key_cols, repeats, seed, label)
    return _rescored_permutation_importance(model, test, features, key_cols, repeats, seed, label)


def _permuted(df: DataFrame, columns: Sequence[str], key_cols: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """``df`` once per repeat (column ``r``) with a permuted copy ``_perm_<c>`` of every column.

    Rows are dealt to partitions and ordered there by hashes of their key -- the only
    exchange, whatever the number of columns and repeats -- so each batch that a task
    reads is a random sample of the rows, and every column is permuted on its own
    within the batch.  The same rows and partitions give the same permutations."""
    columns = list(columns)
    keys = [F.col(c) for c in key_cols]
    dealt = df.repartition(F.xxhash64(F.lit(seed), *keys)).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            for r in range(repeats):
                rng = np.random.default_rng([seed, part, k, r])
                moved = [b.column(i).take(pa.array(rng.permutation(b.num_rows))) for i in at]
                yield pa.RecordBatch.from_arrays([*b.columns, *moved, pa.array(np.full(b.num_rows, r, np.int32))],
                                                 names=[*b.schema.names, *(f"_perm_{c}" for c in columns), "r"])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_perm_{c}", kinds[c]) for c in columns], T.StructField("r", T.IntegerType())])
    return dealt.mapInArrow(run, schema)


def _importance(per: DataFrame, base: DataFrame) -> DataFrame:
    """From (feature, r, sse) and the one-row table (sse, sst) of the unchanged columns."""
    drop = F.try_divide(F.col("sse") - F.col("_sse"), F.nullif(F.col("_sst"), F.lit(0.0)))
    return (per.crossJoin(F.broadcast(base)).groupBy("feature")
            .agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
            .orderBy(F.col("importance_mean").desc(), "feature"))


def _errors(scored: DataFrame, label: str) -> DataFrame:
    y, p = F.col(label), F.col("prediction")
    return scored.agg(F.sum((y - p) * (y - p)).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))


def _linear_permutation_importance(model, test, features, key_cols, repeats, seed, label):
    from pyspark.ml.functions import vector_to_array
    from souk.operators.ordered import materialize
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients]
    # slot ranges of each raw feature in the assembled vector: scaled numerics
    # first (one slot each), then one one-hot block per categorical column
    # (labels + the kept unknown bucket - the dropped last slot)
    indexer = model.stages[0]
    ranges, pos = {}, 0
    for c in model.stages[2].getInputCols():
        ranges[c] = (pos, 1)
        pos += 1
    for c, lab in zip(indexer.getInputCols(), indexer.labelsArray):
        ranges[c] = (pos, len(lab))
        pos += len(lab)
    names = [f for f in features if f in ranges]
    scored = model.transform(test).withColumn("_x", vector_to_array("features"))
    coef = F.array(*[F.lit(c) for c in coefs])
    contrib = [F.aggregate(F.slice(F.zip_with("_x", coef, lambda a, b: a * b), ranges[f][0] + 1, ranges[f][1]),
                           F.lit(0.0), lambda acc, v: acc + v).alias(f"_c{i}") for i, f in enumerate(names)]
    per_row = materialize(scored.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], F.col(label).alias(label),
                                        "prediction", *contrib))
    moved = _permuted(per_row, [f"_c{i}" for i in range(len(names))], [f"_k{i}" for i in range(len(key_cols))], repeats, seed)
    error = [F.col(label) - F.col("prediction") + F.col(f"_c{i}") - F.col(f"_perm__c{i}") for i in range(len(names))]
    sums = moved.groupBy("r").agg(*[F.sum(e * e).alias(f"_s{i}") for i, e in enumerate(error)])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_s{i}").alias("sse")) for i, f in enumerate(names)])
    return _importance(sums.select("r", F.explode(each).alias("_e")).select("r", "_e.*"), _errors(per_row, label))


def _rescored_permutation_importance(model, test, features, key_cols, repeats, seed, label):
    """Generic path: the model scores a copy of the test set per (feature, repeat)."""
    features = list(features)
    moved = _permuted(test, features, key_cols, repeats, seed)
    moved = moved.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    moved = moved.select(*[F.when(F.col("feature") == c, F.col(f"_perm_{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
                           for c in test.columns], "feature", "r")
    y, p = F.col(label), F.col("prediction")
    sums = model.transform(moved).groupBy("feature", "r").agg(F.sum((y - p) * (y - p)).alias("sse"))
    return _importance(sums, _errors(model.transform(test), label))

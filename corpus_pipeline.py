"""Corpus preparation: the stages that turn ``documents`` into training text.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns the columns of ``documents``; the last returns (doc_id, ids,
n_tokens, text): the tokens and what they decode to.  Rows are judged one by
one; null or empty texts have no language and go in the first stage; an empty
table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import bpe, decontaminate, lang_id, pii, simhash
from souk.llm.common import materialize, remove, scratch, shared_path, table
from souk.llm.queries import byte_bpe
from souk.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# share of a text's n-grams, beyond chance, that its language must explain
MIN_LANG_SCORE = 0.3
# several stages have no SQL form (trained language filters, byte-pair encoding)
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told go; a missing lang takes the predicted one."""
    configure(spark)
    model = lang_id.train(spark, docs.where(lang_id.train_rows(F.col("doc_id"))))
    known = lang_id.judged(docs, model).where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    configure(spark)
    return simhash.first_of_each(spark, docs, shingle=3, radius=2).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whether it has an id or not."""
    configure(spark)
    found = decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(spark, found.where("contaminated").select(F.col("doc_id").alias("bad_id"), "key").distinct(), "contaminated")
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    return keyed.join(bad, (keyed["key"] == bad["key"]) & keyed["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span is replaced by its kind."""
    configure(spark)
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text): token ids and the text that they decode to."""
    configure(spark)
    encoded = bpe.encode(docs, byte_bpe(), decoded=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.  What a stage made on
    its way, and its input, go once its result is written; the last stage's input stays
    for as long as the result is read."""
    configure(spark)
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read:
            remove(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)

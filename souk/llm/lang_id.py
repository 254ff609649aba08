"""Language identification by n-gram filters with language bitmasks.

Training counts character n-grams (1 to 4 letters, words padded by a space) per
language in a bounded sample of labelled rows.  A language keeps the n-grams that
make up at least ``MIN_SHARE`` of its own n-grams and at least ``MIN_RATIO`` of
the share they have in any other language.  The sets go into one bit-sliced
Bloom filter: each slot is a mask with a bit per language, and the AND of an
n-gram's slots names all languages that contain it.  A text's n-grams are looked
up by vectorised gathers; the hits per language, less the false positives that
the language's fill predicts, decide.

Bounds: ``SAMPLE_ROWS`` rows per language (in expectation, by a hash of id and
text) train; at most 1 / MIN_SHARE n-grams per language and length survive.  What
reaches the driver and is broadcast grows with the number of labels only, not with
the rows: a name and a count per label, its surviving n-grams, and one array of
slots for every 64 labels, of at most 2^22 slots of 64 bits (32 MB; some 4 MB for
the n-grams that 4,000 rows of prose leave).  A thousand labels make half a gigabyte
at most.  Every label trains.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so
is every text if nothing was learned; equal evidence goes to the language with
more labelled rows, then the smaller name; repeated rows are judged alike;
empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import give_back, small, small_batches

SAMPLE_ROWS = 4_000
MIN_SHARE = 2e-5
MIN_RATIO = 0.25
LENGTHS = (1, 2, 3, 4)
HASHES = 2
BITS_PER_GRAM = 12
CHUNK = 1 << 18             # code points of a text that are looked up at a time
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, every other run one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep = _is_letter(cp)
    out = np.where(keep, cp, np.uint32(32))
    space = out == 32
    out = out[~(space & np.concatenate(([True], space[:-1])))] if len(out) else out
    return out if not len(out) else np.concatenate(([np.uint32(32)], out, [np.uint32(32)])).astype(np.uint64)


_LETTER = np.zeros(0x110000, dtype=bool)
_LETTER_KNOWN = np.zeros(0x110000, dtype=bool)


def _is_letter(cp: np.ndarray) -> np.ndarray:
    new = np.unique(cp[~_LETTER_KNOWN[cp]])
    if len(new):
        _LETTER[new] = [chr(x).isalpha() for x in new]
        _LETTER_KNOWN[new] = True
    return _LETTER[cp]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(cp: np.ndarray, starts: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes) of the n-grams of the padded code points that start before
    ``starts`` (default: all), those of one space left out.  An n-gram's hash
    continues that of its first n - 1 letters."""
    starts = len(cp) if starts is None else starts
    h = np.zeros(len(cp), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            if len(cp) < n:
                break
            h = _mix(h[:len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1:] + np.uint64(1))
            if n in LENGTHS:
                yield n, h[:starts][cp[:starts] != 32] if n == 1 else h[:starts]


def _counted(masks: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks that occur, and how often."""
    if languages > 12:
        return np.unique(masks, return_counts=True)
    return np.arange(1 << languages, dtype=np.uint64), np.bincount(masks.astype(np.int64), minlength=1 << languages)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    slots: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))     # one row per 64 languages
    fill: np.ndarray = field(default_factory=lambda: np.zeros(0))       # share of n-grams that pass by chance

    def masks(self, h: np.ndarray, group: int = 0) -> np.ndarray:
        """Bit i is set if language 64 * group + i contains the n-gram (or it passes by chance)."""
        slots = self.slots[group]
        m = np.uint64(len(slots) - 1)
        out = slots[h & m]
        for _ in range(HASHES - 1):
            h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
            out = out & slots[h & m]
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        cp = letters(text) if text else np.zeros(0, np.uint64)
        if not self.languages or not (cp != 32).any():
            return UNKNOWN, 0.0
        hits, total = np.zeros(len(self.languages)), 0
        with np.errstate(over="ignore"):
            for lo in range(0, len(cp), CHUNK):
                for _, h in grams(cp[lo:lo + CHUNK + max(LENGTHS) - 1], CHUNK):
                    total += len(h)
                    for group in range(len(self.slots)):
                        some = hits[64 * group:64 * group + 64]
                        masks, times = _counted(self.masks(h, group), len(some))
                        for i in range(len(some)):
                            some[i] += times[(masks >> np.uint64(i)) & np.uint64(1) == 1].sum()
        true = np.clip((hits - total * self.fill) / (1 - self.fill), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / max(1, total)))


def train_rows(id_col: Column) -> Column:
    """Rows that may train: those whose crc32(id as text) mod 3 is not 1."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the labelled rows of ``docs`` (the caller leaves held-out rows out)."""
    small_batches(spark)
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return Model()
    shares = spark.createDataFrame([(k, min(1.0, sample_rows / n)) for k, n in sizes.items()], "lang string, part double")
    dealt = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(small(shares, len(sizes)), "lang").where(dealt < F.col("part"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                of: dict[int, list[np.ndarray]] = {n: [] for n in LENGTHS}
                for t in texts:
                    for n, h in grams(letters(t)):
                        of[n].append(h)
                for n, found in of.items():
                    if found:
                        h, times = np.unique(np.concatenate(found), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "len": n, "gram": h.view(np.int64), "times": times})
        give_back()

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, len int, gram long, times long")
    counts = counts.groupBy("lang", "len", "gram").agg(F.sum("times").alias("times"))
    totals = counts.groupBy("lang", "len").agg(F.sum("times").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "len"]).withColumn("share", F.col("times") / F.col("total"))
    common = shares.where(F.col("share") >= MIN_SHARE)          # at most 1 / MIN_SHARE rows per language and length
    top = common.groupBy("len", "gram").agg(F.max("share").alias("top"))
    kept = common.join(top, ["len", "gram"]).where(F.col("share") >= MIN_RATIO * F.col("top"))
    return _model(list(sizes), kept.select("lang", "gram").toPandas())


def _model(languages: list[str], kept: pd.DataFrame) -> Model:
    # a language fills only its own bit of the slots, so the largest one sets the size
    most = int(kept["lang"].value_counts().max()) if len(kept) else 1
    size = 1 << max(10, math.ceil(math.log2(most * BITS_PER_GRAM)))
    model = Model(languages, np.zeros((math.ceil(len(languages) / 64), size), np.uint64), np.zeros(len(languages)))
    m = np.uint64(size - 1)
    of = dict(iter(kept.groupby("lang")["gram"]))
    with np.errstate(over="ignore"):
        for i, lang in enumerate(languages):
            slots, bit = model.slots[i // 64], np.uint64(i % 64)
            h = of[lang].to_numpy(dtype=np.int64).view(np.uint64) if lang in of else np.zeros(0, np.uint64)
            for _ in range(HASHES):
                np.bitwise_or.at(slots, h & m, np.uint64(1) << bit)
                h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
            used = ((slots >> bit) & np.uint64(1)).mean()
            model.fill[i] = used ** HASHES
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            found = [model.judge(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"].astype("Int64") if kind in ("bigint", "int") else b["id"],
                                "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of those names are replaced)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.judge(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [x for x, _ in found], "score": [y for _, y in found]})
        give_back()

    out = docs.withColumn("_v", verdict(F.col(text_col)))
    return out.withColumn("lang_pred", F.col("_v.lang_pred")).withColumn("score", F.col("_v.score")).drop("_v")

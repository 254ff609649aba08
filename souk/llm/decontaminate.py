"""Benchmark decontamination by a positional inverted index (DataFrame functions only).

``build_index`` stores the training table's postings (document, position, term)
for the terms of the benchmark; one closing posting per row holds its word count.
The lengths of the terms' lists, counted from the index, tell which terms of a
benchmark window are rare: in a window of which ``near`` of 10 words must agree, one
of its 10 - near + 1 rarest terms does (``anchors``).  ``matches`` meets the lists of
the anchors, offset-adjusted to where the window would start, with those of the next
rarer terms of that window: at least one of them agrees at its own offset, or there
is no match.  This and the count of all agreeing words are taken from the row's own
words, so nothing is written or shuffled for a candidate that fails.  An alignment
is met once, through its rarest agreeing anchor.  Windows that agree in full are
exact phrase matches, the others proximity matches.

Scale: postings stay in document order and are never shuffled; the windows'
anchors are broadcast in blocks of ``BLOCK_ANCHORS`` rows, one pass over the texts
per block.  A frequent term's list is scanned, never gathered; a hot document costs as
many rows as it has words.

Defined cases: null or wordless texts have no words; items without words take no
part; items with a null id count for n_hit, contaminated and n_near, but have no id to
be listed; an item shorter than a window is one window, near if ``near`` of its words
agree, or all if it has fewer; repeated documents each have a row, repeated items count
once; a window may hang over either end of a text if enough of it is inside; empty
tables give no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import ascii_lower, materialize, small

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
NEAR = 8
CLOSING = -1        # term id of the posting that holds a row's word count
BLOCK_ANCHORS = 100_000


def words(text) -> Column:
    """Lower-case words; splitting leaves an empty string at most at either end."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATOR), ""), F.array().cast("array<string>"))


def item_terms(spark: SparkSession, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(item, item_id, w, off, word, term) of every item word, and the number of rows."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).distinct().select(
        F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.posexplode("w").alias("off", "word"))
    items = materialize(spark, items.withColumn("term", F.xxhash64("word")), "decon-items")
    return items, items.count()


def build_index(spark: SparkSession, docs: DataFrame, items: DataFrame, n_items: int,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, key, pos, term) of all rows of ``docs``; (doc, key) names a text."""
    vocabulary = materialize(spark, items.select("word", "term").distinct()
                             .union(spark.createDataFrame([("", CLOSING)], "word string, term long")), "decon-terms")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("key"),
                       F.explode(F.array(F.concat(words(F.col(text_col)), F.array(F.lit(""))))).alias("w"))    # a plain column
    rows = rows.select("doc", "key", F.posexplode("w").alias("pos", "word"))
    return materialize(spark, rows.join(small(vocabulary, n_items), "word").select("doc", "key", "pos", "term"), "decon-postings")


def windows(spark: SparkSession, items: DataFrame, n_items: int, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, size, by_rarity): the distinct windows and their words (n, off, word), rarest first."""
    lengths = postings.where(F.col("term") != CLOSING).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = item_windows(items, window).select("win").distinct().select("win", F.posexplode("win").alias("off", "word"))
    each = each.join(small(lengths, n_items), F.xxhash64("word") == F.col("term"), "left")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "word")))
    return materialize(spark, each.groupBy("win").agg(rare.alias("by_rarity")).select("win", F.size("win").alias("size"), "by_rarity"),
                       "decon-windows")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, win) of every window of every item."""
    size = F.least(F.size("w"), F.lit(window))
    starts = items.where(F.col("off") <= F.size("w") - size)        # a window starts at each of these words
    return starts.select("item", "item_id", F.slice("w", F.col("off") + 1, size).alias("win")).distinct()


def anchors(spark: SparkSession, wins: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """A row per window and each of its size - need + 1 rarest words: (word, off, win, size, need, block),
    the rarer words before it (b0, b1, ..) and the next ones (a0, a1, ..), as (off, word) relative to its own offset."""
    need = F.least(F.lit(near), F.col("size"))
    spare = window - min(near, window)
    rows = wins.withColumn("need", need).select("*", F.posexplode(F.slice("by_rarity", 1, F.col("size") - F.col("need") + 1)).alias("rank", "own"))

    def other(at: Column, wanted: Column) -> Column:
        o = F.get("by_rarity", at)
        return F.when(wanted, F.struct((o["off"] - F.col("own.off")).alias("step"), o["word"].alias("word")))
    before = [other(F.lit(j), F.col("rank") > j).alias(f"b{j}") for j in range(spare)]
    after = [other(F.col("rank") + 1 + j, (F.col("size") - F.col("need") - F.col("rank") >= j) & (F.col("rank") + 1 + j < F.col("size")))
             .alias(f"a{j}") for j in range(spare + 1)]
    rows = rows.select(F.col("own.word").alias("anchor"), F.col("own.off").alias("off"), "win", "size", "need", *before, *after)
    return materialize(spark, rows.withColumn("row", F.monotonically_increasing_id()), "decon-anchors")


def matches(spark: SparkSession, docs: DataFrame, wins: DataFrame, window: int = WINDOW, near: int = NEAR,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, start, win, size, exact): every place where enough words of a window agree."""
    lists = anchors(spark, wins, window, near)
    blocks = max(1, -(-lists.count() // BLOCK_ANCHORS))
    spare = window - min(near, window)
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("key"),
                        F.explode(F.array(words(F.col(text_col)))).alias("w"))      # a plain column
    texts = texts.select("doc", "key", "w", F.posexplode("w").alias("pos", "anchor"))

    def agrees(other: str) -> Column:
        return F.coalesce(F.get("w", F.col("pos") + F.col(f"{other}.step")) == F.col(f"{other}.word"), F.lit(False))
    fresh, some = F.lit(True), F.col("a0").isNull()
    for j in range(spare):
        fresh &= ~agrees(f"b{j}")
    for j in range(spare + 1):
        some |= agrees(f"a{j}")
    start = F.col("pos") - F.col("off")
    # no lambda here: generated code keeps the row's words in place, else they were copied for every candidate
    same = sum((F.when(F.get("w", start + i) == F.get("win", F.lit(i)), 1).otherwise(0) for i in range(window)), F.lit(0))
    found = None
    for k in range(blocks):
        part = lists.where(F.pmod("row", F.lit(blocks)) == k).drop("row")
        hits = texts.join(F.broadcast(part), "anchor").where(fresh & some).where(same >= F.col("need"))
        hits = hits.select("doc", "key", start.alias("start"), "win", "size", (same == F.col("size")).alias("exact"))
        found = hits if found is None else found.union(hits)
    return materialize(spark, found, "decon-matches")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, n_near (items with an exact or proximity match), key (xxhash64 of id and text)."""
    items, n_items = item_terms(spark, benchmark)
    postings = build_index(spark, docs, items, n_items, id_col, text_col)
    found = matches(spark, docs, windows(spark, items, n_items, postings, window), window, near, id_col, text_col)
    exact = found.where("exact").select("doc", "key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
    hit = exact.distinct().groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    # whether an item occurs in full, before ids are listed: one row per text and item
    owners = item_windows(items, window)
    named = found.groupBy("doc", "key", "win").agg(F.max("exact").alias("exact")).join(small(owners, n_items), "win")
    named = named.groupBy("doc", "key", "item_id", F.when(F.col("item_id").isNull(), F.col("item")).alias("unnamed")) \
        .agg(F.max("exact").alias("exact"))
    ids = named.groupBy("doc", "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("ids"),
        F.count(F.lit(1)).alias("n_near"))
    told = materialize(spark, ids.alias("i").join(hit.alias("h"), (F.col("i.key") == F.col("h.key"))
                                                  & F.col("i.doc").eqNullSafe(F.col("h.doc")), "left")
                       .select("i.doc", "i.key", "ids", "n_near", "n_hit"), "decon-found")
    rows = postings.where(F.col("term") == CLOSING).select("doc", "key", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.alias("r").join(told.alias("f"), (F.col("r.key") == F.col("f.key"))
                                & F.col("r.doc").eqNullSafe(F.col("f.doc")), "left").select(
        F.col("r.doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("r.key").alias("key"))

"""Importance resampling towards a target: hashed n-gram features, Gumbel top-k.

A text's features are its runs of 1 to ``n`` words; a feature's bucket is the
CRC-32 of its bytes modulo ``buckets``.  CRC-32 is linear: the value of a span is
the exclusive-or of one contribution per byte, which depends only on the byte and
its distance from the span's end, and of a constant of the span's length.  The
contributions come from a table of ``TABLE`` distances, are gathered for all spans
of a batch at once and combined with ``bitwise_xor.reduceat``.  Longer spans are
cut into blocks of that size from their end, and neighbouring blocks are folded:
the earlier one is moved on by the later one's length, level by level.

All documents and all target texts are counted per bucket; a bucket's gain is the
log ratio of their smoothed shares; a text's weight is the sum of its features'
gains.  Noise drawn from a hash of the id makes the highest scores a weighted
sample without replacement.

Scale: texts are read twice (counting, weighing) and never shuffled.  A task emits
one count per bucket; the gains (``buckets`` numbers) are all that tasks share.
Scores, a few numbers per document, are range-partitioned by rank with the row's
number as the last key, so a third of all rows being alike still spreads; each
piece numbers its sorted rows, and one count per piece gives the ranks.

Defined cases: a null text has no words and weight 0; a null id is hashed as the
empty string and loses ties; rows of one id share their noise and are ranked by
number of features next, equal rows in any order, each with its own rank; empty
tables: without documents no rows, without target texts all targets are the
smoothing alone; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import bounded_batches, give_back, materialize

TABLE = 64
_CHUNK = 1 << 20          # bytes of spans gathered at once
_BYTES = np.arange(256)
# lower case for A-Z, and which bytes belong to words: 0-9, a-z and all beyond ASCII
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128)


def _positions(n: int) -> np.ndarray:
    """Contribution of a byte at distances 0 to n - 1 from the end: (n, 256)."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((n, 256), np.uint32)
    out[0] = one
    for k in range(1, n):
        out[k] = (out[k - 1] >> np.uint32(8)) ^ one[out[k - 1] & np.uint32(255)]
    return out


_AT = _positions(TABLE)
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(TABLE + 1)], np.uint32)


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as a table per byte, of every x."""
    out = tables[0][x & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _moved_by_table() -> np.ndarray:
    """Tables of the map that moves a value on by ``TABLE`` bytes."""
    out = np.array([_BYTES << (8 * k) for k in range(4)]).astype(np.uint32)
    for _ in range(TABLE):
        out = (out >> np.uint32(8)) ^ _AT[0][out & np.uint32(255)]
    return out


_MOVES = [_moved_by_table()]


def _move(level: int) -> np.ndarray:
    """Tables that move a value on by ``TABLE`` * 2 ** level bytes."""
    while len(_MOVES) <= level:
        _MOVES.append(_apply(_MOVES[-1], _MOVES[-1]))
    return _MOVES[level]


def _fold(values: np.ndarray, span: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One value per span of its blocks' values (rows by span, then falling block; block 0 is the last)."""
    level = 0
    while len(block) and block.max() > 0:
        odd = (block & 1).astype(bool)
        values = np.where(odd, _apply(_move(level), values), values)
        block = block >> 1
        first = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (block[1:] != block[:-1])]))
        values, span, block, level = np.bitwise_xor.reduceat(values, first), span[first], block[first], level + 1
    return values


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for every span (spans may overlap, none is empty)."""
    out = np.empty(len(starts), np.uint32)
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _CHUNK, side="right")) - 1)
        out[lo:hi] = _crc32_chunk(data, starts[lo:hi], ends[lo:hi])
        lo = hi
    return out


def _crc32_chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    to = np.cumsum(size)
    first = to - size
    each = np.arange(to[-1])
    byte = data[each + np.repeat(starts - first, size)]
    left = np.repeat(to - 1, size) - each
    long = size > TABLE
    if not long.any():
        parts = _AT.ravel()[(left << 8) + byte]
        return np.bitwise_xor.reduceat(parts, first) ^ _ZEROS[size]
    parts = _AT.ravel()[(left % TABLE << 8) + byte]
    block, span = left // TABLE, np.repeat(np.arange(len(size)), size)
    cut = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (block[1:] != block[:-1])]))
    values = _fold(np.bitwise_xor.reduceat(parts, cut), span[cut], block[cut])
    zeros = {int(n): zlib.crc32(bytes(int(n))) for n in np.unique(size[long])}
    return values ^ np.array([zeros[n] if n > TABLE else _ZEROS[n] for n in size.tolist()], np.uint32)


def _features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, for each length of a run: (text, bucket) of every feature)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])      # an array of its own, without an offset
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    data = _LOWER[raw]
    inside = _IN_WORD[data]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edges = at[(at > 0) & (at < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    upto = np.searchsorted(starts, at, side="left")
    words = np.diff(upto)
    text = np.repeat(np.arange(len(words)), words)
    out = [(text, crc32_spans(data, starts, ends) % np.uint32(buckets))] if len(starts) else [(text, np.zeros(0, np.uint32))]
    if n > 1 and len(starts):
        # words joined by one space, whatever stood between them
        size = ends - starts
        to = np.cumsum(size + 1)
        begin = to - size - 1
        joined = np.full(to[-1], 32, np.uint8)
        move = np.repeat(begin - starts, size)
        src = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        joined[src + move] = data[src]
        for k in range(2, n + 1):
            same = np.flatnonzero(text[k - 1:] == text[:len(text) - k + 1]) if len(text) >= k else np.zeros(0, np.int64)
            if len(same):
                out.append((text[same], crc32_spans(joined, begin[same], begin[same + k - 1] + size[same + k - 1]) % np.uint32(buckets)))
    return words, out


def _slices(b: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all rows in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _slices(b, 0):
                for _, found in _features(part.column(0), n, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])
        give_back()

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    with bounded_batches(texts.sparkSession):
        rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()       # at most one row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                words, found = _features(part.column(1), n, len(gain))
                weight, features = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for text, bucket in found:
                    edge = np.searchsorted(text, np.arange(len(words) + 1))
                    total = np.concatenate([[0], np.cumsum(gain[bucket])])
                    weight += np.diff(total[edge])
                    features += np.diff(edge)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                                 names=["id", "n_words", "n_features", "weight"])
        give_back()
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """floor(1000 * Gumbel noise) drawn from a hash of the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10,
             min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for those not drawn."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets))
    with bounded_batches(spark):
        scored = weighed(docs, gain, n, id_col, text_col).withColumns(
            {"score": F.col("weight") + noise(seed, F.col("id")), "fit": F.col("n_words") >= min_words,
             "row": F.monotonically_increasing_id()})
        scored = materialize(spark, scored, "resample-scores")
    by = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("row")]
    # the number counts on within a piece, and pieces follow each other in order
    pieces = scored.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("number", F.monotonically_increasing_id())
    pieces = materialize(spark, pieces, "resample-ranked")
    piece = F.shiftright("number", 33)
    before, offsets = 0, []
    for r in pieces.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit")) \
            .orderBy("piece").collect():        # one row per piece
        offsets.append((r["piece"], before, r["fit"]))
        before += r["n"]
    drawn = percent * sum(o[2] for o in offsets) // 100
    offsets = spark.createDataFrame([o[:2] for o in offsets], "piece long, before long")
    rank = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return pieces.withColumn("piece", piece).join(F.broadcast(offsets), "piece").select(
        F.col("id").alias(id_col), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))

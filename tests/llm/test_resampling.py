import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from souk.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    feats = [[zlib.crc32(g.encode()) % buckets for g in grams(t, n)] for _, t in docs]
    s, t = Counter(b for f in feats for b in f), Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(x, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (i, text), f in zip(docs, feats):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    rows.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * sum(r[4] for r in rows) // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(rows)), key=str)


def texts(rng, n):
    vocabulary = ["the", "The", "naïve", "ÉTÉ", "x9", "a", "Z", "straße", "日本語", "long" * 40, "w" * 5000, "it's", "e-mail"]
    out = []
    for _ in range(n):
        sep = rng.choice([" ", "  ", "\n", ", ", "\t"])
        out.append(sep.join(rng.choice(vocabulary) for _ in range(rng.randrange(60))))
    return out


def test_query_against_brute_force(spark, docs, sf):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))]
    rows += [(500, None), (501, ""), (None, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (502, "-- !!"),
             (503, " ".join(["the"] * 30_000))]
    target = texts(rng, 12) + [None, ""]
    path = sf(documents=docs(rows, extra=("row", "rank", "weight", "piece")),
              benchmark=spark.createDataFrame([(i, t, "own") for i, t in enumerate(target)], "item_id long, text string, weight string"))
    got = sorted((tuple(r) for r in queries.op13_importance_resampling(spark, path).collect()), key=str)
    assert got == brute(rows, target)


@pytest.mark.parametrize("n", [2, 3])
def test_longer_runs_of_words(spark, docs, n):
    rng = random.Random(n)
    rows, target = [(i, t) for i, t in enumerate(texts(rng, 60))], texts(rng, 5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(spark, docs(rows), bench, n=n, buckets=64, percent=40, min_words=5, seed=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, target, n, 64, 40, 5, 3)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(spark, docs([]), none).collect() == []
    rows = [(i, "a b c " * 10) for i in range(20)]
    got = resampling.resample(spark, docs(rows), none).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, [])


def test_target_like_documents_are_drawn(spark, docs):
    rng = random.Random(4)
    plain, wanted = [f"w{k}" for k in range(300)], [f"t{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choices(wanted if i % 10 == 0 else plain, k=80))) for i in range(400)]
    bench = spark.createDataFrame([(" ".join(rng.choices(wanted, k=200)),)], "text string")
    drawn = [r["doc_id"] for r in resampling.resample(spark, docs(rows), bench).collect() if r["rank"]]
    assert len(drawn) == 40 and all(i % 10 == 0 for i in drawn)


def test_ranks_of_many_equal_rows(spark, docs):
    rows = [(None, "one two three " * 10)] * 300 + [(i, "four five six " * 10) for i in range(100)]
    got = resampling.resample(spark, docs(rows).repartition(7), spark.createDataFrame([("six",)], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41))
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, ["six"])


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    for size in ([1, 2, 7], [63, 64, 65, 127, 128, 129], [1, 64, 5_000, 100_000], [64 * 64, 64 * 64 + 1]):
        n = rng.choice(size, 200)
        at = rng.integers(0, len(data) - max(size), 200)
        assert resampling.crc32_spans(data, at, at + n).tolist() == [zlib.crc32(data[a:a + k].tobytes()) for a, k in zip(at, n)]


def test_batches_with_an_offset_and_nulls():
    t = pa.array(["skipped words", None, "Ab ab", "", "ÄB ab", "tail"]).slice(1, 4)
    found, (first,) = resampling._features(t, 1, 10_000)
    assert found.tolist() == [0, 2, 0, 2]
    assert list(zip(*(x.tolist() for x in first))) == [(k, zlib.crc32(w.encode()) % 10_000) for k, w in
                                                      [(1, "ab"), (1, "ab"), (3, "Äb"), (3, "ab")]]

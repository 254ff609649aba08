import hashlib
import random
import re

from souk.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            x = words(x)
            m = min(10, len(x))
            if not m:
                continue
            grams = {tuple(x[s:s + m]) for s in range(len(x) - m + 1)}
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in grams:
                    ids |= {str(i)} - {"None"}
                    hit.update(range(s, s + m))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), near_brute(t, items)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(9)
    vocab = ["the", "a", "of", "It", "É"] * 6 + [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(10, 40))) for i in range(12)] + [(12, "short item"), (13, "One"), (14, ""), (15, None), (None, text(20)),
                                                                 (3, text(15)), (16, "same " * 14)]
    items.append(items[2])
    rows = []
    for i in range(60):
        t = text(r.randint(0, 120)).split()
        if i % 3 == 0:
            x = words(r.choice(items)[1])
            a = r.randint(0, len(x))
            at = r.randint(0, len(t))
            t[at:at] = x[a:a + r.randint(8, 30)]
        rows.append((i, ", ".join(t)))
    rows += [(100, None), (101, ""), (102, "..."), (103, "same " * 400 + "one"), (104, (items[4][1] + " ") * 300), (None, items[5][1]),
             (None, None), rows[3], rows[3], (3, "another text"), (105, items[6][1][:40] + "x" * 30_000)]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in items], "item_id long, text string, term string, word string")


def test_query_against_brute_force(spark, sf, docs):
    rows, items = corpus()
    got = queries.op4_benchmark_decontamination(spark, sf(documents=docs(rows), benchmark=bench(spark, items)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


def test_shuffled_tables_and_anchors_in_blocks_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df, rows: df)
    monkeypatch.setattr(decontaminate, "BLOCK_ANCHORS", 40)
    rows, items = corpus()
    got = decontaminate.decontaminate(spark, docs(rows), bench(spark, items))
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == brute(rows, items)


def test_proximity_allows_other_words_between(spark, docs):
    item = [f"w{i}" for i in range(12)]
    changed = item[:4] + ["other"] + item[5:]
    rows = [(1, " ".join(item)), (2, " ".join(changed)), (3, " ".join(item[:6])), (4, " ".join(reversed(item))),
            (5, " ".join(item[2:10])), (6, " ".join(item[3:10]))]
    got = {r["doc_id"]: (r["contaminated"], r["n_near"])
           for r in decontaminate.decontaminate(spark, docs(rows), bench(spark, [(1, " ".join(item))])).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 0), 4: (False, 0), 5: (False, 1), 6: (False, 0)}


def test_empty_tables(spark, docs):
    rows, items = corpus()
    assert decontaminate.decontaminate(spark, docs([]), bench(spark, items)).count() == 0
    got = decontaminate.decontaminate(spark, docs(rows[:5]), bench(spark, []))
    assert [r["n_hit"] for r in got.collect()] == [0] * 5


def near_brute(t, items):
    """Number of items with an alignment at which 8 words of a window agree (all words of a short item)."""
    w, ids = words(t), set()
    for i, x in items:
        x = words(x)
        for shift in range(-len(x), len(w) + 1):
            same = [0 <= o + shift < len(w) and w[o + shift] == x[o] for o in range(len(x))]
            m = min(10, len(x))
            if m and any(sum(same[s:s + m]) >= min(8, m) for s in range(len(x) - m + 1)):
                ids.add(i if i is not None else tuple(x))
    return len(ids)


def test_near_copies_with_any_one_or_two_words_changed(spark, sf, docs):
    r = random.Random(4)
    item = [f"q{i}" for i in range(12)]
    mixed = [r.choice(["the", "of", "a", "q3", "z1", "z2"]) for _ in range(15)]
    items = [(1, " ".join(item)), (2, " ".join(mixed)), (3, " ".join(item[:9])), (4, "two words")]
    texts = []
    for x in (item, mixed):
        for a in range(len(x)):
            for b in range(a, len(x)):
                t = list(x)
                t[a], t[b] = "altered", "changed"
                texts.append("before " + " ".join(t) + " after")
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "the of a " * 40), (1001, None)]
    path = sf(documents=docs(rows), benchmark=bench(spark, items))
    got = queries.op4_benchmark_decontamination(spark, path).collect()
    assert {x["doc_id"]: x["n_near"] for x in got} == {i: near_brute(t, items) for i, t in rows}
    short = queries.op4_benchmark_proximity(spark, path).collect()
    assert sorted((x["doc_id"], x["contaminated"], x["n_near"]) for x in got) == sorted(tuple(x) for x in short)


def test_items_without_id_count_but_are_not_listed(spark, sf, docs):
    item = " ".join(f"n{i}" for i in range(12))
    got = queries.op4_benchmark_decontamination(spark, sf(documents=docs([(1, "a " + item + " b")]), benchmark=bench(spark, [(None, item)])))
    r = got.first()
    assert (r["n_hit"], r["n_items"], r["contaminated"], r["n_near"]) == (12, 0, True, 1)
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest()

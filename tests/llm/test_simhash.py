import random
import re

import numpy as np
import xxhash

from souk.llm import queries, simhash


def fp(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    g = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """Lists of row numbers that are linked."""
    f = [fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return f, list(out.values())


def smallest(rows, group):
    return min((rows[i][0] for i in group if rows[i][0] is not None), default=None)


def brute(rows):
    f, groups = classes(rows)
    return sorted(((rows[i][0], f"{f[i]:016x}", smallest(rows, g)) for g in groups for i in g), key=str)


def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(r.choice(vocab) for _ in range(400))) for i in range(40)]
    for i in range(40):                 # near copies: one word changed, several hops apart
        w = out[i % 8][1].split()
        for _ in range(i // 8):
            w[r.randrange(400)] = "new"
        out.append((100 + i, " ".join(w)))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (None, "one two"),
            (None, "É lone É\x85x y z"), (3, out[3][1]), (3, out[3][1]), (3, "other text of the same id"), (207, "Ä b c d " * 30_000)]
    return out


def test_query_against_brute_force(spark, sf, docs):
    rows = texts()
    got = queries.op5_simhash_near_dedup(spark, sf(documents=docs(rows)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_links_with_small_blocks(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2 ** 63, 30, dtype=np.uint64)
    vals = sorted({int(x) ^ m for x in base for m in (0, 1, 3, 1 << 63, 7, (1 << 20) | 1)})
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in vals], "fp long")
    got = {(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64)))
           for a, b in simhash.links(df, 2, tile=3, neighbours=4).collect()}
    exp = {(a, b) for a in vals for b in vals if a != b and (a ^ b).bit_count() <= 2
           and np.uint64(a).view(np.int64) < np.uint64(b).view(np.int64)}
    assert got == exp and len(exp) > 20


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["fp"]: r["label"] for r in simhash.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_one_row_of_each_component_stays(spark, docs):
    rows = texts()
    kept = simhash.first_of_each(spark, docs(rows)).collect()
    assert len({(r["doc_id"], r["text"]) for r in kept}) == len(kept)
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted((smallest(rows, g) for g in classes(rows)[1]), key=str)
    assert kept[0]["key"] == "own key"


def test_empty(spark, sf, docs):
    assert queries.op5_simhash_near_dedup(spark, sf(documents=docs([]))).count() == 0
    assert simhash.first_of_each(spark, docs([])).count() == 0

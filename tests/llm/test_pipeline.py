"""Each stage, and all of them, against brute-force versions on a small corpus."""

import random

import corpus_pipeline as P
import pytest
from test_decontaminate import brute as contaminated
from test_pii import brute as spans
from test_simhash import classes, smallest
from test_tokens import library

STAGES = dict(P.STAGES)


def corpus():
    r = random.Random(8)
    vocab = {"en": [f"the{a}{b}" for a in "bcdfgh" for b in "aeiou"], "de": [f"und{a}{b}" for a in "kmnprs" for b in "äöüei"]}
    text = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    items = [(i, text("en", 14)) for i in range(3)]
    rows = [(i, text(lang, 150), lang) for i in range(40) for lang in [r.choice(["en", "de"])]]
    rows += [(50, rows[3][1], rows[3][2]), (51, rows[4][1].replace(" ", "\n", 1), rows[4][2]),
             (52, text("en", 60) + " " + items[1][1] + " " + text("en", 60), "en"),
             (53, text("de", 80) + " mail a.b@example.org or 4111 1111 1111 1111", "de"),
             (54, text("en", 90), None), (55, None, "en"), (56, "", "en"), (57, "123 456 !!", "de"), (None, text("en", 80), "en"),
             rows[7], (7, text("de", 70), "de"), (58, text("de", 20_000), "de")]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture
def env(spark, sf, docs):
    rows, items = corpus()
    return docs(rows), sf(documents=docs(rows), benchmark=bench(spark, items)), rows, items


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.where("doc_id is not null").collect())


def test_language_stage_drops_only_what_has_none(spark, env):
    df, path, rows, _ = env
    out = STAGES["language_id"](spark, df, path)
    assert out.columns == P.COLUMNS
    assert pairs(out) == sorted((i, t) for i, t, *_ in rows if i is not None and t and any(c.isalpha() for c in t))
    assert out.where("doc_id = 54").first()["lang"] == "en"


def test_near_duplicate_stage(spark, env):
    df, path, rows, _ = env
    out = STAGES["simhash_near_dedup"](spark, df, path)
    rows = [(i, t) for i, t, *_ in rows]
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == P.COLUMNS
    assert sorted(kept, key=str) == sorted((smallest(rows, g) for g in classes(rows)[1]), key=str)


def test_contamination_stage(spark, env):
    df, path, rows, items = env
    rows = [(i, t) for i, t, *_ in rows]
    out = STAGES["benchmark_decontamination"](spark, df, path)
    bad = {r[0] for r in contaminated(rows, items) if r[5]}
    assert bad == {52} and out.columns == P.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted((x for x in rows if x[0] != 52), key=str)


def test_personal_data_stage(spark, env):
    df, path, rows, _ = env
    out = {r["doc_id"]: r for r in STAGES["pii"](spark, df, path).collect()}
    assert len(out) == len({i for i, *_ in rows})
    assert out[53]["text"].endswith(" mail [EMAIL] or [CARD]") and out[53]["n_chars"] == len(out[53]["text"])
    assert not spans(out[53]["text"]) and out[55]["text"] is None


def test_encoding_stage(spark, env):
    df, path, rows, _ = env
    lib = library("byte_bpe_50k.json")
    out = STAGES["bpe"](spark, df, path).collect()
    assert len(out) == len(rows)
    for r in out:
        assert lib.decode(r["ids"], skip_special_tokens=False) == r["text"] and len(r["ids"]) == r["n_tokens"]
        assert r["ids"] == lib.encode(r["text"], add_special_tokens=False).ids


def test_all_stages(spark, env):
    _, path, rows, _ = env
    got = {r["doc_id"]: r["text"] for r in P.run(spark, path).collect()}
    gone = {50, 51, 52, 55, 56, 57}
    assert set(got) == {i for i, *_ in rows} - gone
    assert got[53].endswith(" mail [EMAIL] or [CARD]")


def test_empty_tables(spark, sf, docs):
    path = sf(documents=docs([]), benchmark=bench(spark, []))
    assert P.run(spark, path).count() == 0


def test_contamination_stage_knows_items_without_id(spark, sf, docs):
    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(1, "before " + passage + " after"), (2, "nothing of it")]
    path = sf(documents=docs(rows), benchmark=bench(spark, [(None, passage), (3, "another item of some length")]))
    assert pairs(STAGES["benchmark_decontamination"](spark, docs(rows), path)) == [(2, "nothing of it")]

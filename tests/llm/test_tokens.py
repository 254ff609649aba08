"""Byte-pair encoding and token files against the tokenizers library."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from souk.llm import bpe, queries, token_codec

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"
ALPHABET = "abcdefghijklmnopqrstuvwxyz   ''\n\t\r\x1c\x85\xa0 éüñßÀÖİΣς中文字𝄞😀١٢½²0123456789.,!?-_<>|​́ "


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    r = random.Random(1)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2ff), r.randint(0x300, 0xd7ff), r.randint(0xe000, 0x1ffff)])) for _ in range(20))
            for _ in range(300)]
    return out + [None, "", " ", "  a", "a   b", "a \n b", "\n\n a", "a<|endoftext|>b  <|endoftext|> c<|startoftext|>", "x" * 3000,
                  "ab" * 3000, " " * 2000 + "a", "the" * 2000, "don't they'll we've I'M THE", "thethethe" * 20 + " of"]


def test_bpe_query_against_the_library(spark, sf, docs):
    rows = list(enumerate(texts())) + [(5, texts()[5]), (None, "null id")]
    lib = library("byte_bpe_50k.json")
    exp = []
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        d = lib.decode(e, skip_special_tokens=False)
        exp.append((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()))
    got = queries.op7_bpe_round_trip(spark, sf(documents=docs(rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exp))


def test_decoding_apart_from_encoding(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in enumerate(texts()) if i % 7 == 0] + [(9_999, None)]
    apart = bpe.decode(bpe.encode(docs(rows), path), path)
    assert apart.columns == ["doc_id", "ids", "text"]
    assert {r["doc_id"]: r["text"] for r in apart.collect()} == {i: t or "" for i, t in rows}


def test_failing_words_are_merged_exactly():
    b = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 40))).encode() for _ in range(2000)]
    exact = [b.merge(w) for w in words]
    assert [np.frombuffer(x, np.uint32).tolist() for x in b.encode_words(words)] == [b.ids[e].tolist() for e in exact]
    flat, word = b.propose(words)
    greedy = [flat[word == i].tolist() for i in range(len(words))]
    assert [b"".join(b.bytes[t] for t in g) for g in greedy] == words
    assert sum(g != e for g, e in zip(greedy, exact)) > 200       # speculation fails often enough to matter
    assert b.encode_words([]) == []


def test_token_file_query_against_the_library(spark, sf, docs):
    rows = list(enumerate(texts()))
    rows += [(7, "second text of an id"), (None, "null id"), (7, texts()[7])]
    random.Random(4).shuffle(rows)
    lib = library("word_bpe_49k.json")
    got = queries.op8_token_files(spark, sf(documents=docs(rows))).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    seen = []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    exp = []
    for i, t in rows:
        e = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        exp.append((i, len(e), zlib.crc32(e.tobytes())))
    assert sorted(map(str, seen)) == sorted(map(str, exp))


def test_each_word_of_latin_letters_goes_through_the_library_once():
    tok = token_codec.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    lib, asked = tok.library, []

    class Counting:
        def encode_batch_fast(self, x, add_special_tokens):
            asked.extend(w for t in x for w in t.split())
            return lib.encode_batch_fast(x, add_special_tokens=add_special_tokens)

    tok.library = Counting()
    rows = ["Größe, größe. GRÖSSE größe! (größe) große's", None, "größe\x0bÀ1ÿ2 don't!'s 'Tis l'été", "a<|endoftext|>b ÷ µm été\xa0x"] * 3
    got = [np.frombuffer(x, np.uint32).tolist() for x in tok.encode(rows, 2)]
    assert got == [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in rows]
    assert asked.count("größe") == 1 and "größe," not in asked
    first = len(asked)
    assert len(list(tok.encode(rows, 2))) == len(rows) and len(asked) == first


def test_groups_end_with_the_document_that_fills_them(spark, docs, monkeypatch):
    from souk.llm.common import shared_path

    monkeypatch.setattr(token_codec, "GROUP_IDS", 10)
    rows = [(i, "one two three " * (i % 5)) for i in range(60)]
    path = shared_path(spark, "t-groups")
    token_codec.write(docs(rows).coalesce(1), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    groups = [r["lengths"] for r in spark.read.parquet(path).select("lengths").collect()]
    assert sum(map(len, groups)) == 60 and sum(map(sum, groups)) == sum(3 * (i % 5) + 1 for i in range(60))
    assert all(sum(g[:-1]) < 10 for g in groups)
    got = {r["doc_id"]: len(r["ids"]) for r in token_codec.read_ids(spark, path).collect()}
    assert got == {i: 3 * (i % 5) + 1 for i, _ in rows}


def test_blocks_round_trip_and_damage_shows():
    r = np.random.default_rng(1)
    for x in (np.zeros(0), [5], r.integers(0, 1 << 20, 3000), np.zeros(5000), r.integers(0, 50, 4000), np.tile(np.arange(37), 120)):
        x = np.array(x, np.uint32)
        tree, coded = token_codec.encode_blocks(x, block=512, lanes=3)
        assert (token_codec.decode_blocks(tree, coded, lanes=2) == x).all()
        if len(coded) > 2:      # blocks are independent
            assert (token_codec.decode_blocks(tree, coded[1:2]) == x[512:1024]).all()
    n, crc, data = coded[0]
    with pytest.raises(ValueError, match="damaged"):
        token_codec.decode_blocks(tree, [(n, crc, bytes([data[0] ^ 1]) + data[1:])])
    with pytest.raises(ValueError, match="2 \\*\\* 20"):
        token_codec.encode_blocks(np.array([1 << 20], np.uint32))


def test_jvm_codes_to_the_same_bytes(spark):
    r = np.random.default_rng(5)
    some = [np.zeros(0), [5], [(1 << 20) - 1] * 9, r.integers(0, 1 << 20, 3000), np.zeros(5000), r.integers(0, 50, 4000), r.integers(0, 9000, 9000),
            r.zipf(1.3, 30_000).clip(1, 49_000)]
    some = [np.array(x, np.uint32) for x in some]
    coded = [token_codec.encode_blocks(x, block=512) for x in some]
    df = spark.createDataFrame([(i, x.tobytes(), c[0]) for i, (x, c) in enumerate(zip(some, coded))], "i int, ids binary, tree binary")
    df = df.withColumn("c", token_codec._coder(spark, "Encode", "sizes array<int>, crcs array<long>, blocks array<binary>", "ids", "tree", F.lit(512)))
    df = df.select("*", token_codec._coder(spark, "Decode", "binary", "tree", "c.sizes", "c.crcs", "c.blocks").alias("back"))
    for x, (_, blocks), got in zip(some, coded, df.orderBy("i").collect()):
        assert [(n, crc, bytes(b)) for n, crc, b in zip(got.c.sizes, got.c.crcs, got.c.blocks)] == blocks
        assert bytes(got.back) == x.tobytes()


def test_damaged_files_are_noticed(spark, docs):
    from souk.llm.common import shared_path

    path = shared_path(spark, "t-damage")
    token_codec.write(docs([(i, f"text of number {i} " * 50) for i in range(40)]).coalesce(1), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    whole = spark.read.parquet(path)
    worse = whole.withColumn("blocks", F.transform("blocks", lambda b: F.concat(F.lit(b"\x01\x02"), F.substring(b, 3, 1 << 20))))
    worse.write.parquet(f"{path}-2")
    assert token_codec.read(spark, path).count() == 40
    for read in (token_codec.read, token_codec.read_ids):
        with pytest.raises(Exception, match="damaged"):
            read(spark, f"{path}-2").collect()


def test_coding_a_group_takes_no_python_time(spark, docs, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("coded in Python")

    from souk.llm.common import shared_path
    monkeypatch.setattr(token_codec, "encode_blocks", refused)
    monkeypatch.setattr(token_codec, "decode_blocks", refused)
    path = shared_path(spark, "t-jvm")
    token_codec.write(docs([(1, "one two"), (2, "three")]), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    plan = token_codec.read(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("souk_token_Told(") == 1
    assert token_codec.read(spark, path).count() == 2


def test_repeating_ids_take_little_room():
    x = np.tile(np.random.default_rng(2).integers(0, 49_000, 200), 20).astype(np.uint32)
    assert sum(len(b[2]) for b in token_codec.encode_blocks(x)[1]) < len(x) * 2 / 5


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="test tables not present")
def test_real_texts_take_less_than_their_order_0_entropy():
    texts = pq.read_table(DOCUMENTS, columns=["doc_id", "text"]).sort_by("doc_id").column("text").to_pylist()[:1200]
    tok = token_codec.load(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.frombuffer(b"".join(tok.encode(texts, 2)), np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    tree, coded = token_codec.encode_blocks(ids)
    bits = 8 * (len(tree) + sum(len(b[2]) for b in coded)) / len(ids)
    assert len(ids) > 400_000 and bits < 8.0 and bits < -(p * np.log2(p)).sum() - 0.4
    assert (token_codec.decode_blocks(tree, coded) == ids).all()


def test_leaves_are_where_their_lengths_say():
    r = np.random.default_rng(3)
    for counts in ([7], [0, 0, 3], [1, 1], r.integers(0, 50, 400), 2 ** np.arange(20), np.ones(37, int)):
        lengths = token_codec.code_lengths(np.array(counts))
        tree = token_codec._Tree(lengths)
        for i in np.flatnonzero(counts):
            steps, node = range(tree.start[i], tree.start[i + 1]), 0
            for s in steps:
                assert tree.node[s] == node and tree.last[s] == (s == steps[-1])
                node = tree.child[2 * node + tree.bit[s]]
            assert node == ~i and len(steps) == lengths[i]


def test_empty_tables(spark, sf, docs):
    path = sf(documents=docs([]))
    assert queries.op7_bpe_round_trip(spark, path).count() == 0
    assert queries.op8_token_files(spark, path).count() == 0


def test_written_ids_come_back(spark, docs):
    from souk.llm.common import shared_path

    path = shared_path(spark, "t-tokens")
    token_codec.write(docs([(2, "two words"), (1, "one"), (3, None)]), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    lib = library("word_bpe_49k.json")
    got = {r["doc_id"]: r["ids"] for r in token_codec.read_ids(spark, path).collect()}
    assert got == {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in ((1, "one"), (2, "two words"), (3, ""))}

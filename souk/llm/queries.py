"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import (bpe, decontaminate, lang_id, licenses, pii, quality, resampling, simhash, token_codec, topk,
                      url_filter, warc, whitening)
from souk.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


_TOPK_SQL = """
WITH e AS (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@_query("op1_exact_topk", _TOPK_SQL)
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), topk.quantised(F.col("embedding")).alias("vec"))
    return topk.top_k(rows.where(F.col("id") % 20 == 0), rows, 20)


_LICENSE_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LICENSE_SQL = f"""
WITH v(license, text) AS (VALUES {_LICENSE_VALUES}),
tw AS (SELECT license, regexp_extract_all(translate(text, {_LOWER}), '[a-z0-9]+') w FROM v),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') g FROM (SELECT *, unnest(range(1, len(w) - 3)) i FROM tw)),
tn AS (SELECT license, count(*) n, (2 ** floor(log2(count(*)) + 1e-9))::BIGINT s FROM ts GROUP BY license),
d AS (SELECT row_number() OVER () rid, doc_id, w FROM (SELECT DISTINCT doc_id, text,
        regexp_extract_all(translate(text, {_LOWER}), '[a-z0-9]+') w FROM documents WHERE text IS NOT NULL)),
ds AS (SELECT rid, i - 1 pos, array_to_string(w[i:i + 4], ' ') g FROM (SELECT *, unnest(range(1, len(w) - 3)) i FROM d)),
h AS (SELECT rid, license, n, s, pos, g FROM ds JOIN ts USING (g) JOIN tn USING (license)),
x AS (SELECT *, unnest(range(greatest(pos // s - 2, 0), pos // s + 1)) win FROM h),
c AS (SELECT rid, license, win * s AS first_shingle, count(DISTINCT g) / any_value(n) share FROM x GROUP BY rid, license, win, s),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY share DESC, first_shingle) r FROM c WHERE share >= 0.8),
f AS (SELECT rid, license, share, first_shingle, n FROM b JOIN tn USING (license) WHERE r = 1),
k AS (SELECT a.license a, b.license b FROM ts a JOIN ts b ON a.g = b.g AND a.license <> b.license
      JOIN tn x ON x.license = a.license JOIN tn y ON y.license = b.license
      GROUP BY a.license, b.license HAVING count(*)::DOUBLE / any_value(least(x.n, y.n)) >= 0.8)
SELECT doc_id, license, share containment, first_shingle::BIGINT shingle,
       NOT EXISTS (SELECT 1 FROM f g JOIN k ON k.a = f.license AND k.b = g.license
                   WHERE g.rid = f.rid AND (g.share, g.n, g.license) > (f.share, f.n, f.license)) most_specific
FROM f JOIN d USING (rid)"""


@_query("op2_license_scan", _LICENSE_SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
m AS (SELECT h, max(page_id) m FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(p.h))::BIGINT payload_bytes, sha1(p.h) payload_digest,
       CASE WHEN m.m IS NOT NULL AND page_id IS DISTINCT FROM m.m THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN m.m IS NOT NULL AND page_id IS DISTINCT FROM m.m THEN m.m END refers_to
FROM p LEFT JOIN m ON p.h = m.h"""


@_query("op3_warc_normaliser", _WARC_SQL)
def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono, out = shared_path(spark, "warc-monolithic"), shared_path(spark, "warc")
    warc.write_monolithic(warc.with_revisits(table(spark, sf_dir, "pages")), mono)
    warc.normalise(spark, mono, out)
    return warc.read_archives(spark, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECON_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(regexp_extract_all(translate(text, {_LOWER}), '{_WORD}'), []) w
           FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, {_LOWER}), '{_WORD}') w FROM benchmark),
c AS (SELECT row_number() OVER () bid, *, least(10, len(w)) m FROM b WHERE len(w) > 0),
i AS (SELECT bid, m, w, unnest(range(1, len(w) - m + 2)) s FROM c),
g AS (SELECT DISTINCT bid, m, array_to_string(w[s:s + m - 1], ' ') gram FROM i),
p AS (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) s FROM d, (SELECT DISTINCT m FROM c)),
o AS (SELECT rid, s, p.m, bid FROM p JOIN g ON g.m = p.m AND g.gram = array_to_string(w[s:s + p.m - 1], ' ')),
h AS (SELECT rid, count(DISTINCT pos) n_hit FROM (SELECT rid, unnest(range(s, s + m)) pos FROM o) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids
      FROM o JOIN c USING (bid) GROUP BY rid),
dw AS (SELECT rid, unnest(w) word, generate_subscripts(w, 1) pos FROM d),
bw AS (SELECT bid, len(w) n, m, unnest(w) word, generate_subscripts(w, 1) pos FROM c),
a AS (SELECT rid, bid, n, m, dw.pos - bw.pos shift, bw.pos pos FROM dw JOIN bw USING (word)),
l AS (SELECT *, count(*) OVER (PARTITION BY rid, bid, shift) same FROM a),
k AS (SELECT rid, bid, m, shift, unnest(range(greatest(1, pos - m + 1), least(pos, n - m + 1) + 1)) s FROM l WHERE same >= least(8, m)),
r AS (SELECT DISTINCT rid, bid FROM (SELECT rid, bid FROM k GROUP BY rid, bid, m, shift, s HAVING count(*) >= least(8, m))),
e AS (SELECT rid, count(DISTINCT CASE WHEN item_id IS NULL THEN 'unnamed ' || bid ELSE item_id::VARCHAR END) n_near
      FROM r JOIN c USING (bid) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_near, 0)::BIGINT n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN e USING (rid)"""


@_query("op4_benchmark_decontamination", _DECON_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


@_query("op4_benchmark_proximity", f"SELECT doc_id, contaminated, n_near FROM ({_DECON_SQL})")
def op4_benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of op4_benchmark_decontamination, which has them all."""
    return op4_benchmark_decontamination(spark, sf_dir).select("doc_id", "contaminated", "n_near")


@_query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, radius=2)


# fixed values: the rules of the query's contract (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]

_URL_SQL = """
WITH u AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path FROM pages),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END verdict FROM r"""


@_query("op6_url_bloom_cascade", _URL_SQL)
def op6_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES)


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), byte_bpe(), decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@_query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.round_trip(spark, table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), end=2)


@_query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(spark, docs.where(lang_id.train_rows(F.col("doc_id"))))
    return lang_id.predict(docs, model).select(
        "doc_id", F.coalesce(~lang_id.train_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@_query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), whitening.quantised(F.col("embedding")).alias("vec"))
    return whitening.whiten(spark, rows, k=32)


_SPACED = r"[^\x20\x09-\x0D]+"
_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t,
             coalesce(regexp_extract_all(text, '{_SPACED}'), []) w FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) line FROM d),
n AS (SELECT rid, count(*) n_lines, count(*) - count(DISTINCT line) n_dup_lines FROM l
      WHERE regexp_matches(line, '{_SPACED}') GROUP BY rid),
g AS (SELECT rid, p, w[p:p + 2] gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) p FROM d)),
r AS (SELECT rid, count(DISTINCT q) n_repeat_words FROM (
        SELECT rid, unnest([p, p + 1, p + 2]) q FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) c FROM g) WHERE c > 1) GROUP BY rid),
top AS (SELECT rid, max(c) top_word FROM (SELECT rid, x, count(*) c FROM (SELECT rid, unnest(w) x FROM d) GROUP BY rid, x) GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, coalesce(n_lines, 0) n_lines, coalesce(top_word, 0) top_word,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) n_lower,
        length(regexp_replace(t, '[^!?]', '', 'g')) n_marks,
        length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F\x{{FFFD}}]', '', 'g')) n_odd
      FROM d LEFT JOIN n USING (rid) LEFT JOIN r USING (rid) LEFT JOIN top USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * top_word > 25 * n_words OR 100 * n_upper > 40 * (n_upper + n_lower)
            OR 100 * n_marks > 30 * n_words OR 100 * n_odd > word_chars) kept
FROM b"""


@_query("op12_quality_rules", _QUALITY_SQL)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.cascade(table(spark, sf_dir, "documents"), quality.RULES, report)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *report, base.alias("base_failed"), "kept")


# CRC-32 bit by bit for the table of single bytes, then byte by byte over each distinct word
_RESAMPLE_SQL = f"""
WITH c AS (SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8],
             lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) tab FROM range(256) x(b)),
d AS (SELECT row_number() OVER () rid, doc_id, coalesce(regexp_extract_all(translate(text, {_LOWER}), '{_WORD}'), []) w FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(text, {_LOWER}), '{_WORD}')) word FROM benchmark),
u AS (SELECT rid, unnest(w) word FROM d),
v AS (SELECT word, hex(encode(word)) h FROM (SELECT word FROM u UNION SELECT word FROM e)),
k AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 10000 bucket FROM v, c),
s AS (SELECT bucket, count(*) s FROM u JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) t FROM e JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE)))::BIGINT gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT rid, sum(gain)::BIGINT weight FROM u JOIN k USING (word) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT doc_id, len(w)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT h FROM d LEFT JOIN m USING (rid)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) r,
        count(*) OVER (PARTITION BY n_features >= 20) n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM z"""


@_query("op13_importance_resampling", _RESAMPLE_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1,
                               buckets=10_000, percent=10, min_words=20, seed=2024)

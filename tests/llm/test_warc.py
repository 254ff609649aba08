import gzip
import hashlib
import json
import zlib

import pytest

from souk.llm import queries, warc
from souk.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, n string, digest string"


def brute(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, -1), -1 if p is None else p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        m = best.get(b, -1)
        again = m >= 0 and p != m
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", m if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)


ROWS = [(1, "http://a/ b\n", "x" * 1000), (2, None, "x" * 1000), (3, "http://c", "x" * 999), (4, "http://c", "x" * 999),
        (5, "http://d", None), (6, "http://d", ""), (None, "http://n", "y" * 2000), (7, "http://é", "é𝄞\r\n\r\nWARC/1.1\r\n" * 90),
        (8, "http://é", "é𝄞\r\n\r\nWARC/1.1\r\n" * 90), (8, "http://é", "é𝄞\r\n\r\nWARC/1.1\r\n" * 90),
        (9, "u", "".join(chr(32 + i * 7 % 90) for i in range(1 << 16)) * 260), (10, "u", "\0\n" * 600)]


def test_round_trip_against_brute_force(spark, sf):
    got = queries.op3_warc_normaliser(spark, sf(pages=pages(spark, ROWS)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_files_are_plain_gzip_and_the_index_points_at_members(spark):
    mono, out = shared_path(spark, "t-mono"), shared_path(spark, "t-warc")
    warc.write_monolithic(warc.with_revisits(pages(spark, ROWS).drop("n", "digest")), mono)
    warc.normalise(spark, mono, out)
    files = {r["archive"]: bytes(r["content"]) for r in warc.archive_files(spark, out, "warc").collect()}
    index = {r["archive"]: bytes(r["content"]) for r in warc.archive_files(spark, out, "index").collect()}
    old = spark.read.format("binaryFile").load(mono + "/*.gz").collect()
    whole = {r["path"].rsplit("/", 1)[-1].split(".")[0]: gzip.decompress(bytes(r["content"])) for r in old}
    seen = []
    for name, content in files.items():
        assert gzip.decompress(content) == whole[name]
        end = 0
        for line in gzip.decompress(index[name]).decode().splitlines():
            e = json.loads(line)
            assert e["offset"] >= end
            end = e["offset"] + e["length"]
            seen.append(warc.read_record(content, e["offset"], e["length"]))
    assert sorted(seen, key=str) == brute(ROWS)


def test_empty_table(spark, sf):
    assert queries.op3_warc_normaliser(spark, sf(pages=pages(spark, []))).count() == 0


def test_truncated_input_is_an_error():
    rec = b"WARC/1.1\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    z = gzip.compress(rec * 3)
    assert list(warc.records_of(warc._inflated(z))) == [rec] * 3
    assert list(warc.records_of(warc._inflated(gzip.compress(rec) + gzip.compress(rec * 2)))) == [rec] * 3
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records_of(warc._inflated(gzip.compress(rec * 2 + rec[:20]))))
    assert gzip.decompress(warc.member(b"a" * (1 << 24)) + b"\0") == b"a" * (1 << 24)

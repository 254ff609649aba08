"""WARC archives: monolithic gzip files and their normalised form.

``write_monolithic`` writes records with Spark's text writer as one gzip stream
per file.  ``normalise`` inflates each such stream once, front to back, and
rewrites every record as a gzip member of its own, with a sidecar index
(gzipped JSON lines: offset and length of each member).  ``read_archives`` scans
normalised archives, ``read_record`` fetches one record by its index entry.

All files go through Spark's writers and readers, so any store Spark reaches
will do.  The text writer ends every row with a separator that can't be empty:
rows of monolithic files leave out the final line feed of the record, rows of
normalised files the final zero byte of the gzip trailer (its length field ends
in zero for every record under 16 MiB; after a longer one follows an empty
member, which ends in zero bytes as well).

Memory: a task holds one compressed file (``RECORDS_PER_FILE`` records) and one
inflated record, never an inflated file.  Truncated input raises ValueError.

Defined cases: null html is an empty payload; null urls become ``urn:none``; null
page ids stay null and never serve as the response of others; of equal payloads
of at least ``least`` bytes every row with the largest page id is a response
(repeated rows alike); empty tables give empty archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_FILE = 20_000
WARC_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 18
_EMPTY_MEMBER = gzip.compress(b"", 6, mtime=0)
ROWS = "archive string, kind string, seq long, body binary"
RECORD = ("archive string, offset long, length long, page_id long, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long")


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds payload, digest, record_type and refers_to to (page_id, url, html).

    One row per repeated payload is found by a map-side combined aggregate, so a
    payload that a third of all pages share costs one row per map task; the join
    back is on the payload's hash, whose skew AQE splits."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.withColumn("n", F.octet_length("payload").cast("long"))
    # small payloads match nothing: a key of their own spreads them
    alone = F.concat(F.lit("page "), F.coalesce(F.col("page_id"), F.xxhash64("url")))
    pages = pages.withColumn("same", F.when(F.col("n") >= least, F.sha2("payload", 256)).otherwise(alone))
    first = pages.where(F.col("n") >= least).groupBy("same").agg(
        F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return pages.join(first, "same", "left").select(
        "page_id", "url", "payload", "n", F.sha1("payload").alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"))


def _record_id(page_id) -> F.Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
        F.substring(h, 21, 12)), F.lit(">"))


def record_text() -> F.Column:
    """A WARC/1.1 record without its last line feed."""
    revisit = F.col("record_type") == "revisit"
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\nWARC-Target-URI: "), uri,
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n"),
        F.coalesce(F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")),
            F.lit("\r\nX-Refers-To-Page-Id: "), F.col("refers_to")), F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """One gzip stream per file over all its records."""
    records.select(record_text().alias("value")).write.option("compression", "gzip").option("lineSep", "\n") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _inflated(content: bytes) -> Iterator[bytes]:
    d = zlib.decompressobj(31)
    for lo in range(0, len(content), _CHUNK):
        data = content[lo:lo + _CHUNK]
        while data:
            yield d.decompress(data)
            data = d.unused_data if d.eof else b""
            if d.eof:
                d = zlib.decompressobj(31)
    yield d.flush()


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {"": lines[0]} | dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (header, block, two line ends) out of a byte stream."""
    buf, need = bytearray(), None
    for chunk in chunks:
        buf += chunk
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(_header(bytes(buf[:end]))["Content-Length"])
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf:
        raise ValueError(f"archive ends within a record ({len(buf)} bytes left)")


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is zero."""
    z = gzip.compress(data, 6, mtime=0)
    return (z if len(data) < 1 << 24 else z + _EMPTY_MEMBER)[:-1]


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            archive = path.rsplit("/", 1)[-1].split(".")[0]
            rows, size, offset, index, seq = [], 0, 0, [], 0
            for rec in records_of(_inflated(content)):
                head = _header(rec[:rec.index(b"\r\n\r\n")])
                z = member(rec)
                index.append(json.dumps({"offset": offset, "length": len(z) + 1, "id": head["WARC-Record-ID"],
                                         "type": head["WARC-Type"], "uri": head["WARC-Target-URI"]}))
                rows.append((archive, "warc", seq, z))
                offset, size, seq = offset + len(z) + 1, size + len(z), seq + 1
                if size > 8 << 20:
                    yield pd.DataFrame(rows, columns=["archive", "kind", "seq", "body"])
                    rows, size = [], 0
            for lo in range(0, len(index), 10_000):
                rows.append((archive, "index", lo, member(("\n".join(index[lo:lo + 10_000]) + "\n").encode())))
            if rows:
                yield pd.DataFrame(rows, columns=["archive", "kind", "seq", "body"])


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites the monolithic archives below ``source``: target/archive=NAME/kind=warc
    holds the records, kind=index the sidecar index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    rows = files.mapInPandas(_rewrite, ROWS).sortWithinPartitions("archive", "kind", "seq")
    rows.select("archive", "kind", F.col("body").cast("string").alias("value")).write \
        .partitionBy("archive", "kind").option("lineSep", "\0").text(target)


def members_of(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, inflated) of each gzip member that isn't empty."""
    at = 0
    while at < len(content):
        d, parts, lo = zlib.decompressobj(31), [], at
        while not d.eof:
            if lo >= len(content):
                raise ValueError("archive ends within a member")
            parts.append(d.decompress(content[lo:lo + _CHUNK]))
            lo += _CHUNK
        end = min(lo, len(content)) - len(d.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def parse_record(rec: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    end = rec.index(b"\r\n\r\n")
    head = _header(rec[:end])
    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
    if head["WARC-Type"] == "response":
        body = rec[end + 4:end + 4 + int(head["Content-Length"])]
        payload = body[body.index(b"\r\n\r\n") + 4:]
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    else:
        n, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    return (None if page is None else int(page), n, digest, head["WARC-Type"], None if refers is None else int(refers))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for archive, content in zip(batch["archive"], batch["content"]):
            rows = [(str(archive), at, n, *parse_record(rec)) for at, n, rec in members_of(content)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(archive, content) of normalised files; kind: warc or index."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = jvm.org.apache.hadoop.fs.Path(f"{path}/archive=*/kind={kind}")
    if not folders.getFileSystem(conf).globStatus(folders):
        return spark.createDataFrame([], "archive string, content binary")
    files = spark.read.format("binaryFile").option("basePath", path).load(folders.toString())
    return files.select(F.col("archive").cast("string").alias("archive"), "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the normalised archives below ``path``."""
    return archive_files(spark, path, "warc").mapInPandas(_read, RECORD)


def read_record(content: bytes, offset: int, length: int) -> tuple:
    """The record at an index entry, without touching the rest of the archive."""
    return parse_record(gzip.decompress(content[offset:offset + length]))

"""Exact URL rule lookup through a Bloom filter cascade (DataFrame functions only).

A rule is (host, path): it fits the host and all its subdomains when the URL's
path starts with the rule's path.  A URL therefore has a small set of candidate
keys, host suffix + path prefix, and a rule fits exactly when its own key is
among them.  Listed keys are looked up in a cascade: level 1 holds the listed
keys, level 2 the keys of the corpus that pass level 1 without being listed,
level 3 the listed keys that pass level 2, and so on until nothing passes
wrongly.  Over the key universe the cascade was built from the answer is exact
and needs no join; the filters travel as literals of checked size.

Defined cases: null URL or one without ``://`` has empty host and path and fits
no rule (unless a rule has an empty host and path); an empty table gives an
empty result; repeated rows are judged one by one; other columns are dropped.
Of several rules that fit, the longest key wins, then the longest host.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import ascii_lower, materialize

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_FILTER_BITS = 1 << 28


@dataclass(frozen=True)
class Level:
    bits: list[int]     # 64-bit words
    size: int           # bits
    hashes: int
    salt: int

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.bits)), "array<bigint>") if len(self.bits) > 64 \
            else F.array(*[F.lit(b).cast("long") for b in self.bits])
        hit = F.lit(True)
        for p in positions(key, self.salt, self.hashes, self.size):
            hit = hit & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return hit


def positions(key: Column, salt: int, hashes: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(size).cast("long")) for i in range(hashes)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Host suffixes (as many labels as any rule has) x path prefixes (as long
    as any rule's path), as structs (key length, host length, key)."""
    labels = range(1, max((h.count(".") + 1 for h, _, _ in rules), default=0) + 1)
    lengths = sorted({len(p) for _, p, _ in rules})
    out = []
    for j in labels:
        suffix = F.substring_index(host, ".", -j)
        for n in lengths:
            key = F.concat(suffix, F.substring(path, 1, n))
            out.append(F.struct(F.length(key).alias("n"), F.length(suffix).alias("h"), key.alias("key")))
    return F.array_distinct(F.array(*out))


def build_level(keys: DataFrame, n: int, size: int, hashes: int, salt: int) -> Level:
    """Bloom filter over ``keys``; at most size / 64 words reach the driver."""
    size = max(64, size)
    if size > MAX_FILTER_BITS:
        raise ValueError(f"a filter of {size} bits exceeds {MAX_FILTER_BITS}: split the list")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), salt, hashes, size))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v"))
    bits = [0] * ((size + 63) // 64)
    for r in words.collect():
        bits[r["w"]] = r["v"]
    return Level(bits, size, hashes, salt)


def build_cascade(spark: SparkSession, listed: DataFrame, n_listed: int, universe: DataFrame,
                  n_universe: int, salt: int) -> list[Level]:
    """Levels for ``listed`` (column key) that are exact over ``universe`` (key).

    Level 1 spends log2(universe / listed) x 1.44 bits a key, so that about as
    many keys pass it wrongly as are listed; the later levels halve that."""
    if n_listed == 0:
        return []
    ratio = max(2.0, n_universe / n_listed)
    hashes = min(30, max(1, round(math.log2(ratio))))
    levels = [build_level(listed, n_listed, math.ceil(n_listed * 1.4427 * math.log2(ratio)), hashes, salt)]
    wrong = universe.where(levels[0].passes(F.col("key"))).distinct()
    wrong = materialize(spark, wrong.join(listed, "key", "left_anti"), "url-cascade")
    right, n_right, n_wrong = listed, n_listed, wrong.count()
    while n_wrong:
        level = build_level(wrong, n_wrong, math.ceil(2 * n_wrong), 1, salt + len(levels))
        levels.append(level)
        right, n_right, wrong, n_wrong = wrong, n_wrong, right.where(level.passes(F.col("key"))), 0
        n_wrong = wrong.count()
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """True when ``key`` is listed: the first level that rejects it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]],
                id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: (host, path, verdict) with verdict allow or block."""
    rules = sorted({(h.lower(), p): (h.lower(), p, v) for h, p, v in rules}.values())
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = rows.select(F.explode(keys).alias("k")).select(F.col("k.key").alias("key"))
    per_url = max(h.count(".") + 1 for h, _, _ in rules) * len({p for _, p, _ in rules})
    n_universe = pages.count() * per_url
    cascades = {}
    for i, verdict in enumerate(("allow", "block")):
        own = [(h + p,) for h, p, v in rules if v == verdict]
        listed = spark.createDataFrame(own, "key string")
        cascades[verdict] = build_cascade(spark, listed, len(own), universe, n_universe, 1000 * (i + 1))
    hit = lambda k: listed_in(cascades["allow"], k["key"]) | listed_in(cascades["block"], k["key"])
    best = rows.withColumn("best", F.array_max(F.filter(keys, hit)))
    rule = F.col("best.key")
    verdict = F.when(rule.isNull(), F.lit(default)).when(listed_in(cascades["block"], rule), "block").otherwise("allow")
    return best.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))

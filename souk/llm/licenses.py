"""License scan (DataFrame functions only): MinHash bands over overlapping text
windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased ASCII words in shingles of five.  A template
of T distinct shingles, 2^k <= T < 2^(k+1), is looked for in windows of 3 * 2^k
shingles that start every 2^k: each of its occurrences lies whole in some window.
A window and a template are compared if one of ``BANDS`` min-hashes (bands of one
row) agrees.  With containment c the Jaccard similarity is at least
cT / (3 * 2^k + T - cT) >= 1/4 for c = 0.8, so a match is missed with probability
0.75 ** 32 = 1e-4 at most, and a verbatim one with (2/3) ** 32 = 2e-6.

A min-hash of a template is the hash of one of its shingles, so windows without
any template shingle can't collide (but for equal 64-bit hashes) and get no
signature: documents without one are dropped by a set test on their hashes.

Scale: one pass over the texts, nothing shuffled but documents with a template
shingle; templates are a parameter, their tables are broadcast below a checked
size; a document's windows are worked on within its row.

Defined cases: null, empty and short texts match nothing; repeated rows (same id
and text) are reported once; null ids are reported; equal containment goes to
the first window; empty tables give an empty result; templates of fewer than
five words are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import ascii_lower, materialize, small

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
LISTED_HASHES = 20_000      # template hashes that a set in the plan may hold
WORD = "[a-z0-9]+"

def _gnu(version: str, kind: str = "") -> str:
    return (f"terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} "
            "of the License, or (at your")


def _cc(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


# fixed values: license lines, notices and clauses (name, text).  Each is cut so
# that a sister license (BSD-2/3/4, MIT/MIT-0, ISC/0BSD, GPL/LGPL/AGPL and their
# versions) holds less than 0.8 of it: where one lacks a clause of the other, the
# template spans the place.
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
              "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
              "permit persons to whom the Software is furnished to do so")
_MIT_NOTICE = (", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
               "all copies or substantial portions of the Software")
_MIT_END = (". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
            "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
            "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
              "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
              "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
              "distribution. ")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = (". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
            "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
            "THIS SOFTWARE.")
# whole license texts (without their copyright lines), next to the notices and clauses
WHOLE = [
    ("mit-text", _MIT_GRANT + _MIT_NOTICE + _MIT_END),
    ("mit-0-text", _MIT_GRANT + _MIT_END),
    ("bsd-2-clause-text", _BSD_START + _BSD_END),
    ("bsd-3-clause-text", _BSD_START + _BSD_NAMES + _BSD_END),
    ("isc-text", _ISC_GRANT + _ISC_NOTICE + _ISC_END),
    ("0bsd-text", _ISC_GRANT + _ISC_END),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
                  "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
                  "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
                  "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
                  "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
                  "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
                  "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from "
                  "any source distribution."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                       "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                       "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
                       "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
                       "software to the public domain. We make this dedication for the benefit of the public at large and to the "
                       "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
                       "perpetuity of all present and future rights to this software under copyright law" + _MIT_END.replace(
                           " OR COPYRIGHT HOLDERS", "")),
]
TEMPLATES = [
    *WHOLE,
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-family", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met:"),
    ("bsd-2-clause", "the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE"),
    ("bsd-3-clause", "the documentation and/or other materials provided with the distribution. 3. Neither the name of"),
    ("bsd-3-clause-unnumbered", "the documentation and/or other materials provided with the distribution. Neither the name of"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following "
                     "acknowledgement"),
    ("cc-by-4.0", _cc("Attribution")),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", _cc("Attribution-NonCommercial")),
    ("cc-by-sa-4.0", _cc("Attribution-ShareAlike")),
    ("cc-by-nd-4.0", _cc("Attribution-NoDerivatives")),
    ("cc-by-nc-sa-4.0", _cc("Attribution-NonCommercial-ShareAlike")),
    ("cc-by-nc-nd-4.0", _cc("Attribution-NonCommercial-NoDerivatives")),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("gpl-2.0", _gnu("2")),
    ("gpl-2.0-only", "the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _gnu("3")),
    ("gpl-3.0-text", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all "
                     "versions of a program--to make"),
    ("lgpl-2.0", _gnu("2", "Library")),
    ("lgpl-2.1", _gnu("2.1", "Lesser")),
    ("lgpl-3.0", _gnu("3", "Lesser")),
    ("lgpl-3.0-text", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of "
                      "the GNU General Public License"),
    ("agpl-3.0", _gnu("3", "Affero")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND"),
    ("mit-line", "Released under the MIT License."),
    ("mit-family", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                   "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("mit-0", "to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_hashes(w: Column) -> Column:
    """XXH64 of every run of five words; ``w`` must be a plain column."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))).otherwise(none)


def shingle_texts(w: Column, first: Column, n: Column) -> Column:
    """Distinct shingles first to first + n - 1 (as far as there are) as text."""
    last = F.least(first + n, F.size(w) - SHINGLE + 1) - 1
    return F.array_distinct(F.transform(F.sequence(first, last), lambda i: F.concat_ws(" ", F.slice(w, i + 1, SHINGLE))))


def signature(hashes: Column) -> Column:
    """BANDS min-hashes of a non-empty array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def _templates(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(license, scale, shingles, hashes, sig): scale is 2^k."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates, "license string, text string")
    rows = templates.select("license", words(F.col("text")).alias("w"))
    rows = materialize(spark, rows.withColumn("h", shingle_hashes(F.col("w"))), "license-words")
    if not rows.where(F.size("h") == 0).isEmpty():
        raise ValueError(f"templates need {SHINGLE} words at least")
    rows = rows.select("license", shingle_texts(F.col("w"), F.lit(0), F.size("h")).alias("shingles"),
                       F.array_distinct("h").alias("hashes"))
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.size("shingles")) + 1e-9)).cast("int")
    return materialize(spark, rows.select("license", scale.alias("scale"), "shingles", "hashes", signature(F.col("hashes")).alias("sig")),
                       "license-templates")


def scan(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, shingle, most_specific): for every document and template
    found, the best window's containment and first shingle.  ``templates`` is a list or a
    table (license, text).  Templates are sisters if one holds ``least`` of the other's
    shingles; of sisters found in a document the one with the highest containment,
    then most shingles, then the last name, is the most specific."""
    tpl = _templates(spark, templates)
    n_templates = tpl.count()
    known = tpl.select("scale", F.explode("hashes").alias("h")).distinct()
    n_known = known.count()
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("key"),
                       F.explode(F.array(words(F.col(text_col)))).alias("w"))    # a plain column: never evaluated within a lambda
    rows = rows.withColumn("h", shingle_hashes(F.col("w")))
    if n_known <= LISTED_HASHES:
        rows = rows.where(F.arrays_overlap("h", F.array(*[F.lit(r["h"]) for r in known.select("h").distinct().collect()])))
    else:
        some = rows.select("doc", "key", F.explode("h").alias("h")).join(small(known.select("h").distinct(), n_known), "h", "left_semi")
        some = materialize(spark, some.select(F.col("doc").alias("d"), F.col("key").alias("k")).distinct(), "license-some")
        rows = rows.join(some, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")), "left_semi")
    rows = materialize(spark, rows.dropDuplicates(["doc", "key"]), "license-docs")

    at = rows.select("doc", "key", F.posexplode("h").alias("pos", "h")).join(small(known, n_known), "h")
    block = F.floor(F.col("pos") / F.col("scale")).cast("int")
    windows = at.select("doc", "key", "scale", F.explode(F.sequence(F.greatest(block - 2, F.lit(0)), block)).alias("n"))
    windows = windows.distinct().groupBy("doc", "key").agg(F.collect_list(F.struct("scale", "n")).alias("windows"))
    windows = materialize(spark, windows, "license-windows")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["key"] == b["key"]) & a["doc"].eqNullSafe(b["doc"])
    signed = rows.join(windows, same(rows, windows)).select(rows["doc"], rows["key"], F.explode(F.transform("windows", lambda x: F.struct(
        x["scale"].alias("scale"), (x["n"] * x["scale"]).alias("first"),
        signature(F.slice("h", x["n"] * x["scale"] + 1, 3 * x["scale"])).alias("sig")))).alias("x"))
    bands = lambda df, *cols: df.select(*cols, F.posexplode("sig").alias("band", "low"))
    ours = bands(signed.select("doc", "key", "x.scale", "x.first", "x.sig"), "doc", "key", "scale", "first")
    theirs = bands(tpl, "license", "scale")
    found = ours.join(small(theirs, BANDS * n_templates), ["scale", "band", "low"]).select("doc", "key", "scale", "first", "license")
    found = materialize(spark, found.distinct(), "license-candidates")

    texts = found.join(rows.select("doc", "key", "w"), same(found, rows)).select(
        found["doc"], found["key"], "license", "first", shingle_texts(F.col("w"), F.col("first"), 3 * F.col("scale")).alias("window"))
    checked = texts.join(small(tpl.select("license", "shingles"), n_templates), "license").select(
        "doc", "key", "license", "first", (F.size(F.array_intersect("window", "shingles")) / F.size("shingles")).alias("share"))
    best = checked.where(F.col("share") >= least).groupBy("doc", "key", "license").agg(
        F.max(F.struct("share", (-F.col("first")).alias("first"))).alias("best"))
    best = materialize(spark, best.select("doc", "key", "license", F.col("best.share").alias("share"), (-F.col("best.first")).cast("long").alias("first")),
                       "license-found")
    near = sisters(tpl, least)
    x, y = best.alias("x"), best.alias("y")
    pairs = x.join(small(near, n_templates * n_templates), F.col("x.license") == F.col("a")).join(
        y, (F.col("x.key") == F.col("y.key")) & F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("y.license") == F.col("b")))
    beaten = pairs.where(F.struct("y.share", "n_b", "y.license") > F.struct("x.share", "n_a", "x.license")).select(
        F.col("x.doc").alias("d"), F.col("x.key").alias("k"), F.col("x.license").alias("l")).distinct()
    told = best.join(beaten, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")) & (F.col("license") == F.col("l")), "left")
    return told.select(F.col("doc").alias(id_col), "license", F.col("share").alias("containment"), F.col("first").alias("shingle"),
                       F.col("k").isNull().alias("most_specific"))


def sisters(tpl: DataFrame, least: float) -> DataFrame:
    """(a, n_a, b, n_b): templates of which the smaller has ``least`` of its shingles in the larger, both ways."""
    each = lambda n: tpl.select(F.col("license").alias(n), F.size("shingles").alias(f"n_{n}"), F.explode("shingles").alias("g"))
    common = each("a").join(each("b"), "g").where(F.col("a") != F.col("b")).groupBy("a", "n_a", "b", "n_b").agg(F.count(F.lit(1)).alias("n"))
    return common.where(F.col("n") / F.least("n_a", "n_b") >= least).drop("n")

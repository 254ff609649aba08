import random
import re

import pytest

from souk.llm import licenses, queries


def words(t):
    return re.findall("[a-z0-9]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(w):
    return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    out = []
    for d, t in set(rows):
        s = shingles(words(t))
        for name, text in templates:
            tpl = set(shingles(words(text)))
            k = 1 << (len(tpl).bit_length() - 1)
            best = max(((len(set(s[a:a + 3 * k]) & tpl) / len(tpl), -a) for a in range(0, len(s), k)), default=(0, 0))
            if best[0] >= 0.8:
                out.append((d, t, name, best[0], -best[1], len(tpl)))
    sets = {n: set(shingles(words(x))) for n, x in templates}
    sister = lambda a, b: a != b and len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))
    return sorted(((d, n, c, at, not any((d, t) == (d2, t2) and sister(n, n2) and (c2, k2, n2) > (c, k, n)
                                         for d2, t2, n2, c2, _, k2 in out)) for d, t, n, c, at, k in out), key=str)


def corpus():
    r = random.Random(6)
    rows = []
    for i in range(60):
        t = [f"w{r.randint(0, 500)}" for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            x = words(r.choice(licenses.TEMPLATES)[1])
            for _ in range(r.randint(0, 1)):
                x[r.randrange(len(x))] = "changed"
            at = r.randint(0, len(t))
            t[at:at] = x
        rows.append((i, " ".join(t)))
    mit = dict(licenses.TEMPLATES)["mit-line"]
    return rows + [(100, None), (101, ""), (102, mit), (102, mit), (102, "x " + mit), (None, "x\n" * 30_000 + mit), (103, mit * 3000),
                   (104, "released under the mit"), (105, mit.upper().replace(" ", " -- "))]


def test_query_against_brute_force(spark, sf, docs):
    rows = corpus()
    got = queries.op2_license_scan(spark, sf(documents=docs(rows))).collect()
    exp = brute(rows, licenses.TEMPLATES)
    assert sorted((tuple(r) for r in got), key=str) == exp and len(exp) > 30


def test_empty_table_and_short_templates(spark, sf, docs):
    assert queries.op2_license_scan(spark, sf(documents=docs([]))).count() == 0
    with pytest.raises(ValueError, match="5 words"):
        licenses.scan(spark, docs([(1, "x")]), [("short", "four words only here")])


GRANT = dict(licenses.TEMPLATES)["mit"].split(", subject to")[0]
AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
       "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
       "the following disclaimer in the documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS "
       "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.")
NEITHER = (" {} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
           "derived from this software without specific prior written permission.")
ADVERT = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: x."


def gnu(kind, version, sep=","):
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public "
            f"License as published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any "
            "later version.")


def test_sister_licenses_are_told_apart(spark, docs):
    texts = {"mit": GRANT + dict(licenses.TEMPLATES)["mit"].removeprefix(GRANT) + AS_IS, "mit-0": GRANT + "." + AS_IS,
             "bsd-2-clause": BSD.format(""), "bsd-3-clause": BSD.format(NEITHER.format("3.")),
             "bsd-3-clause-unnumbered": BSD.format(NEITHER.format("*")), "bsd-4-clause": BSD.format(ADVERT + NEITHER.format("4.")),
             "gpl-2.0": gnu("", "2", ";"), "gpl-3.0": gnu("", "3"), "lgpl-2.0": gnu("Library", "2"), "lgpl-2.1": gnu("Lesser", "2.1"),
             "lgpl-3.0": gnu("Lesser", "3"), "agpl-3.0": gnu("Affero", "3")}
    rows = list(enumerate(["before " + t + " after" for t in texts.values()]))
    table = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark, docs(rows), table).collect()}
    exp = {(i, x) for i, x in enumerate(texts)} | {(i, "bsd-family") for i, x in enumerate(texts) if x.startswith("bsd")}
    exp |= {(i, "mit-family") for i, x in enumerate(texts) if x.startswith("mit")}
    assert got == exp


def test_whole_texts_are_most_specific(spark, docs, sf):
    rows = [(i, "Copyright 2020 Someone. " + t + " end") for i, (_, t) in enumerate(licenses.WHOLE)]
    rows += [(100 + i, t.upper().replace("SOFTWARE", "SOFTWARE", 1)) for i, (_, t) in enumerate(licenses.WHOLE)]
    got = queries.op2_license_scan(spark, sf(documents=docs(rows))).collect()
    texts = {n for n, _ in licenses.WHOLE}
    best = {}
    for r in got:
        if r["most_specific"] and r["license"] in texts:
            best.setdefault(r["doc_id"], set()).add(r["license"])
    assert best == {k + i: {n} for k in (0, 100) for i, (n, _) in enumerate(licenses.WHOLE)}
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, licenses.TEMPLATES)


def test_many_templates_are_met_by_a_join(spark, docs, monkeypatch):
    rows = corpus()
    want = sorted(map(tuple, licenses.scan(spark, docs(rows)).collect()), key=str)
    monkeypatch.setattr(licenses, "LISTED_HASHES", 10)
    assert sorted(map(tuple, licenses.scan(spark, docs(rows)).collect()), key=str) == want


def test_a_notice_is_found_only_under_its_own_name():
    notices = [x for x in licenses.TEMPLATES if x not in licenses.WHOLE]
    found = {(a, b) for a, t in notices for b, x in notices if a != b
             for own in [set(shingles(words(x)))] if len(own & set(shingles(words(t)))) >= 0.8 * len(own)}
    assert found <= {("apache-2.0", "apache-2.0-line"), ("mit", "mit-family")}

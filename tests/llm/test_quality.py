import random
import re
from collections import Counter

import pandas as pd
import pytest

from souk.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def verdict(text):
    t = text or ""
    n, chars, symbols, dup, repeat = base(text)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    top = max(Counter(WORD.findall(t)).values(), default=0)
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    failed = n < 50 or 100 * repeat > 50 * n
    rest = (100 * symbols > 10 * n or chars < 2 * n or chars > 15 * n or 100 * dup > 50 * lines or 100 * top > 25 * n
            or 100 * upper > 40 * (upper + lower) or 100 * len(re.findall("[!?]", t)) > 30 * n
            or 100 * len(re.findall("[\x00-\x08\x0e-\x1f\x7f�]", t)) > chars)
    return failed, not (failed or rest)


def sample_texts():
    rng = random.Random(1)
    v = [f"word{k}" for k in range(400)] + ["été", "日本", "naïve", " nbsp"]
    prose = lambda n: " ".join(rng.choice(v) for _ in range(n))
    out = [prose(rng.randrange(1, 200)) for _ in range(60)]
    out += [prose(100).upper(), " | ".join(v[:90]), "\n".join([prose(8)] * 9 + [prose(8) for _ in range(7)]), "same " * 80,
            "a b c d " * 60, " ".join(w + "!" for w in v[:80]), prose(60) + "\x00\x01�" * 9, "x " * 60, "y" * 2000,
            " ".join(w * 4 for w in v[:70]), "", " \n\t ", None, "one\x1ctwo\x85three four", "w\r\nw\r\nw\x0bw\x0cw"]
    out += [prose(120) + "\n" + prose(30) + "\n" + prose(30), " ".join(v[i % 400] for i in range(150_000)), prose(20_000)]
    return out


def test_query_against_brute_force(spark, docs, sf):
    rows = [(i, t) for i, t in enumerate(sample_texts())]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    path = sf(documents=docs(rows, extra=("kept", "n_words", "id")))
    got = sorted((tuple(r) for r in queries.op12_quality_rules(spark, path).collect()), key=str)
    assert got == sorted(((i, *base(t), *verdict(t)) for i, t in rows), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rules", [quality.RULES, quality.RULES[::-1]])
def test_order_changes_no_verdict(spark, docs, rules):
    rows = [(i, t) for i, t in enumerate(sample_texts())]
    got = quality.cascade(docs(rows), rules).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(i, verdict(t)[1]) for i, t in rows}
    assert all((r["rejected_by"] is None) == r["kept"] and 1 <= r["n_checked"] <= len(rules) for r in got)


def test_empty_table(spark, docs, sf):
    assert queries.op12_quality_rules(spark, sf(documents=docs([]))).collect() == []


def rule(name, *needs):
    return quality.Rule(name, needs, lambda t: False)


def test_rules_by_rejections_per_second():
    rules = (rule("dear", "lines"), rule("cheap", "n_words"), rule("never", "n_upper"))
    m = pd.DataFrame({"f_lines": [9.0] * 4, "f_n_words": [1.0] * 4, "f_n_upper": [0.1] * 4, "s_dear": [1.0] * 4, "s_cheap": [1.0] * 4,
                      "s_never": [1.0] * 4, "r_dear": [1.0, 1.0, 1.0, 0.0], "r_cheap": [1.0, 0.0, 0.0, 0.0], "r_never": [0.0] * 4})
    assert [r.name for r in quality.order(m, rules)] == ["cheap", "dear", "never"]      # 1 / 8 against 3 / 40
    # lines are paid for by the report: 3 / 4 against 1 / 8
    assert [r.name for r in quality.order(m, rules, ["lines"])][0] == "dear"


def test_rejections_count_among_those_left():
    rules = (rule("a", "n_words"), rule("b", "n_words"), rule("c", "n_words"))
    m = pd.DataFrame({"f_n_words": [1.0] * 6, **{f"s_{n}": [1.0] * 6 for n in "abc"}, "r_a": [1.0, 1, 1, 0, 0, 0],
                      "r_b": [1.0, 1, 0, 0, 0, 0], "r_c": [0.0, 0, 0, 1, 0, 0]})
    assert [r.name for r in quality.order(m, rules)] == ["a", "c", "b"]


def test_features_computed_only_when_asked(monkeypatch):
    asked = []
    monkeypatch.setitem(quality.FEATURES, "n_repeat_words", lambda t: asked.append(1) or 0)
    t = quality.Text("few words")
    assert quality.RULES[0].rejects(t) and not asked


def test_a_sample_is_enough(spark, docs):
    rows = [(i, t) for i, t in enumerate(sample_texts() * 3)]
    got = quality.cascade(docs(rows).repartition(5), sample=20).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(i, verdict(t)[1]) for i, t in rows}


def test_more_distinct_words_than_a_code_holds(monkeypatch):
    text = " ".join(f"w{i % 1_100_000}" for i in range(1_100_010))
    assert quality.Text(text)["n_repeat_words"] == 20

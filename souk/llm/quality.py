"""Quality rules as a short-circuit cascade.

A rule looks at a few features of a text (``FEATURES``) and rejects it or not; a
text is kept if no rule rejects it.  On a sample of ``SAMPLE_ROWS`` rows in
expectation the time of every feature and rule and the texts that each rule
rejects are measured.  Rules are then ordered greedily: the next one is that
with the most rejections per second among the sampled texts that the rules
before it keep, where a feature that an earlier rule (or the report) has already
computed costs nothing.  Over all rows the rules run in that order; the first
that rejects a text ends its checks, and features that no rule asked for are
never computed.  The order changes the time taken and which rule is named first,
never which texts are kept.

Scale: one pass over the rows, nothing shuffled; a task holds one batch of
bounded size and, of a long text, its distinct words and a number per word.

Defined cases: a null text is an empty one and has no words; repeated rows are
judged alike, each on its own; a null id has a row; an empty table gives an
empty result (rules then run in the order given); further columns are ignored.
"""

from __future__ import annotations

import itertools
import time
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import bounded_batches, give_back, small_batches

SAMPLE_ROWS = 2_000
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PIECE = 1 << 20


class Text:
    """A text and those of its features that were asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.known: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.known:
            self.known[name] = FEATURES[name](self)
        return self.known[name]

    def count(self, of: bytes) -> int:
        """Bytes of the text that are in ``of``."""
        return len(self.raw) - len(self.raw.translate(None, of))


def _word_ids(t: Text) -> np.ndarray:
    """The number of each word; equal words have equal numbers."""
    ids, known, lo = array("q"), defaultdict(itertools.count().__next__), 0
    while lo < len(t.raw):
        hi = lo + _PIECE
        while hi < len(t.raw) and t.raw[hi] not in _SPACES:
            hi += 1
        ids.extend(map(known.__getitem__, t.raw[lo:hi].split()))
        lo = hi
    return np.frombuffer(ids, np.int64)


def _repeat_words(t: Text, window: int = 3) -> int:
    """Words in windows that the text holds twice or more."""
    ids = t["word_ids"]
    if len(ids) <= window:
        return 0
    v, code = int(ids.max()) + 1, ids
    for k in range(1, window):
        code = code[:-1] * v + ids[k:]
        if v > 1 << 20 or k + 1 < window - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, at, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.concatenate([n[at] > 1, np.zeros(window - 1, bool)])
    hit = twice.copy()
    for k in range(1, window):
        hit[k:] |= twice[:-k]
    return int(hit.sum())


def _lines(t: Text) -> list[bytes]:
    return [x for x in t.raw.split(b"\n") if x.strip()]


FEATURES: dict[str, Callable[[Text], object]] = {
    "n_words": lambda t: len(t["word_ids"]) if "word_ids" in t.known else len(t.raw.split()),
    "word_ids": _word_ids,
    "word_chars": lambda t: len(t.text) - t.count(_SPACES),
    "n_symbols": lambda t: t.count(b"#*$%&|<>"),
    "lines": _lines,
    "n_lines": lambda t: len(t["lines"]),
    "n_dup_lines": lambda t: len(t["lines"]) - len(set(t["lines"])),
    "n_repeat_words": _repeat_words,
    "top_word": lambda t: int(np.bincount(t["word_ids"]).max()) if len(t["word_ids"]) else 0,
    "n_upper": lambda t: t.count(_UPPER),
    "n_lower": lambda t: t.count(_LOWER),
    "n_marks": lambda t: t.count(b"!?"),
    "n_odd": lambda t: t.text.count("�") + t.count(bytes(range(9)) + bytes(range(14, 32)) + b"\x7f"),
}


class Rule(NamedTuple):
    """``needs`` names the features that ``rejects`` looks at."""
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Text], bool]


BASE_RULES = (
    Rule("short", ("n_words",), lambda t: t["n_words"] < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda t: 100 * t["n_repeat_words"] > 50 * t["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 100 * t["n_symbols"] > 10 * t["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda t: not 2 * t["n_words"] <= t["word_chars"] <= 15 * t["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda t: 100 * t["n_dup_lines"] > 50 * t["n_lines"]),
    Rule("one_word", ("n_words", "top_word"), lambda t: 100 * t["top_word"] > 25 * t["n_words"]),
    Rule("shouting", ("n_upper", "n_lower"), lambda t: 100 * t["n_upper"] > 40 * (t["n_upper"] + t["n_lower"])),
    Rule("marks", ("n_words", "n_marks"), lambda t: 100 * t["n_marks"] > 30 * t["n_words"]),
    Rule("broken_characters", ("word_chars", "n_odd"), lambda t: 100 * t["n_odd"] > t["word_chars"]),
)


def _closure(names: Sequence[str]) -> list[str]:
    """The features ``names`` and, before them, those that they are made of."""
    made_of = {"n_repeat_words": ("word_ids",), "top_word": ("word_ids",), "n_lines": ("lines",), "n_dup_lines": ("lines",)}
    out: list[str] = []
    for name in names:
        out += [x for x in (*made_of.get(name, ()), name) if x not in out]
    return out


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample: int = SAMPLE_ROWS,
            text_col: str = "text") -> pd.DataFrame:
    """A row per sampled text: seconds of each feature and rule, and whether the rule rejects it."""
    names = _closure([f for r in rules for f in r.needs] + list(report))
    columns = [f"f_{n}" for n in names] + [f"s_{r.name}" for r in rules] + [f"r_{r.name}" for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(0).to_pylist():
                t, row = Text(x), []
                for name in names:
                    began = time.perf_counter()
                    t[name]
                    row.append(time.perf_counter() - began)
                said = []
                for r in rules:
                    began = time.perf_counter()
                    said.append(float(r.rejects(t)))
                    row.append(time.perf_counter() - began)
                rows.append(row + said)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()) for c in zip(*rows)] if rows else
                                             [pa.array([], pa.float64())] * len(columns), names=columns)

    n = docs.count()
    part = docs.select(F.col(text_col).cast("string").alias("text"))
    if n > sample:
        part = part.sample(fraction=sample / n, seed=1).limit(2 * sample)
    with bounded_batches(docs.sparkSession):
        return part.mapInArrow(run, ", ".join(f"{c} double" for c in columns)).toPandas()


def order(measured: pd.DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = ()) -> list[Rule]:
    """The rules by falling rejections per second, each counted after those before it."""
    left, alive, ready = list(rules), np.ones(len(measured), bool), set(_closure(report))
    out: list[Rule] = []
    while left:
        def worth(rule: Rule) -> tuple[float, float]:
            cost = measured[f"s_{rule.name}"].to_numpy()[alive].sum()
            cost += sum(measured[f"f_{f}"].to_numpy()[alive].sum() for f in _closure(rule.needs) if f not in ready)
            return measured[f"r_{rule.name}"].to_numpy()[alive].sum() / max(cost, 1e-12), -cost
        best = max(left, key=worth)
        left.remove(best)
        out.append(best)
        ready |= set(_closure(best.needs))
        alive &= measured[f"r_{best.name}"].to_numpy() == 0
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample: int = SAMPLE_ROWS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, report columns as longs, kept, rejected_by, n_checked) of every row.

    ``report`` names features wanted of all rows, rejected or not; rejected_by is the
    first rule, in the order found, that rejects the text, n_checked how many rules it met."""
    rules = order(measure(docs, rules, report, sample, text_col), rules, report)
    report = list(report)
    small_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                t = Text(x)
                seen = [t[name] for name in report]
                by, n = None, 0
                for rule in rules:
                    n += 1
                    if rule.rejects(t):
                        by = rule.name
                        break
                rows.append((*seen, by is None, by, n))
            cols = list(zip(*rows)) if rows else [()] * (len(report) + 3)
            types = [pa.int64()] * len(report) + [pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, types))],
                                             names=[id_col, *report, "kept", "rejected_by", "n_checked"])
        give_back()

    schema = ", ".join([f"`{id_col}` {kinds}", *(f"{c} long" for c in report), "kept boolean, rejected_by string, n_checked int"])
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

"""Personal data: patterns propose, checksums confirm, context adjusts the score
(DataFrame functions only).

Kinds: email, ip (parts up to 255), card (14 to 19 digits, Luhn), phone (10 to 15
digits) and iban (as long as its country's, mod-97).  A kind's matches are leftmost and do not overlap; a
match that fails its check is dropped without a retry.  A confirmed span has its
kind's base score, raised when a context word of the kind stands close by; the
score is reported, it never removes a span.

The patterns match what their plain forms match, written so that the matcher
neither backtracks through long runs nor recurses: possessive loops, and starts
only where a run starts (or where the previous match ended).  Each kind is
searched only in texts that pass a cheap test.  Offsets are code points, from the
lengths of the pieces between matches.

Defined cases: null texts are empty; empty texts have no spans; repeated rows are
judged one by one; an empty table gives an empty result; input columns stay,
those named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"

# fixed values: length of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Whole or in groups of four; another country's may have any length, but does
    not run into a group that starts a listed country's."""
    known = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")"
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?:\x20[A-Z0-9]{{4}}){{{fours}}}"
                     + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "") + ")(?![A-Z0-9])")
    stop = rf"\x20(?!{known}[0-9]{{2}}\x20)"
    forms.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:{stop}[A-Z0-9]{{4}}){{2,7}}(?:\x20[A-Z0-9]{{1,3}})?)(?![A-Z0-9])")
    return r"(?<![A-Z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(forms) + ")"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str          # a text without a match of this has no match of the pattern
    score: float
    context: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", 0.8, r"\b(?:e-?mail|mail|contact|write|reach)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.5, r"\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++",
         r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, r"\b(?:card|credit|visa|payment|paid|account)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9][\x20().0-9-]", 0.5, r"\b(?:phone|tel|call|mobile|fax|contact)\b"),
    Kind("iban", _iban(),
         r"[A-Z]{2}[0-9]{2}", 0.9, r"\b(?:iban|bank|account|transfer)\b"),
)
BASE = 4                # the first kinds are the base ones
_CONTEXT_BONUS = 0.2


def luhn(digits: Column) -> Column:
    """Of a string of at least one ASCII digit."""
    def add(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    code = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest, i):
        v = F.position(F.substring(code, i, F.lit(1)), F.lit(_LETTERS)) - 1
        return F.when(v < 10, rest * 10 + v).otherwise(rest * 100 + v) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^0*{_PART}(?:\.0*{_PART}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(10, 15)
    if kind == "iban":
        code = F.translate(match, " ", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(F.lit(False))
    return F.lit(True)


def _spans(no: int, kind: Kind, found: Column, pieces: Column) -> Column:
    def step(acc, i):
        m, before, after = F.get(found, i), F.get(pieces, i), F.get(pieces, i + 1)
        start = acc["at"] + before["n"]
        end = start + F.char_length(m)
        near = F.lower(before["tail"]).rlike(kind.context) | F.lower(after["head"]).rlike(kind.context)
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"),
                        F.least(F.lit(1.0), F.round(F.lit(kind.score) + F.when(near, _CONTEXT_BONUS).otherwise(0.0), 2)).alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind.name, m), F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step, lambda a: a["spans"])) \
        .otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``findings``: all spans by start, then kind, as structs of start, kind_no, end, kind, score."""
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    for k in KINDS:
        out = out.withColumn(f"_has_{k.name}", F.col("_t").rlike(k.maybe))
    for k in KINDS:
        some = F.col(f"_has_{k.name}")
        piece = lambda p: F.struct(F.char_length(p).alias("n"), F.substring(p, -48, 48).alias("tail"),
                                   F.substring(p, 1, 24).alias("head"))
        out = out.withColumn(f"_m_{k.name}", F.when(some, F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0)))
                             .otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"_p_{k.name}", F.when(some, F.transform(F.split("_t", k.pattern, -1), piece)))
    spans = F.concat(*[_spans(i + 1, k, F.col(f"_m_{k.name}"), F.col(f"_p_{k.name}")) for i, k in enumerate(KINDS)])
    out = out.withColumn("findings", F.array_sort(spans))
    return out.drop("_t", *[f"_{p}_{k.name}" for p in ("has", "m", "p") for k in KINDS])


def as_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores)."""
    found = find(docs.select(id_col, text_col), text_col)
    count = lambda n: F.size(F.filter("findings", lambda s: s["kind_no"] == n)).cast("long")
    base = F.filter("findings", lambda s: s["kind_no"] <= BASE)
    return found.select(id_col, *[count(i + 1).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:BASE])],
                        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("findings")).alias("spans"),
                        F.array_join(F.transform("findings", lambda s: s["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    t = F.col(text_col)

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(fresh, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.char_length(t)))
    out = find(docs, text_col)
    return out.withColumn(text_col, F.when(F.size("findings") > 0, F.aggregate("findings", start, step, end)).otherwise(t)) \
        .drop("findings")

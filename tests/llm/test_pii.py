import hashlib
import re

from souk.llm import pii, queries

KINDS = ["email", "ip", "card", "phone"]
# the plain forms of the contract
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if good(k, m[0])]
    return [(KINDS[i], a, b) for a, i, b in sorted(found)]


TEXTS = [None, "", "a@b.c_d@e.f x@y.z", "é𝄞 a@b.co 1.2.3.4.5.6.7.8 999.1.1.1 0001.0255.3.4 1.2.3",
         "4111 1111 1111 1111 and +1 (555) 123-4567, +49 30 1234567890 4111-1111-1111-1111-2", "@@ a@b a@.c a@b. a@b..c a-b@c-.d",
         "1 2 3  4 5 6 4111111111111111\n" + "5" * 20_000 + " " + "a." * 10_000 + "@ " + "x" * 20_000 + "@" + "y.z" * 10_000, "+1" * 2000,
         "1.2.3.4@a.b 12.34.56.78@x +12.34.56.78.90", "iban DE89370400440532013000 GB82WEST12345698765432 DE89370400440532013001",
         "a@b.c a@b.c", "pay by card 4012888888881881 call me 4222222222222", "+123456789012345 +1234567890123456 378282246310005",
         "00000000000000 0-0 0", "x" * 200_000 + " 10.0.0.1"]


def test_query_against_plain_patterns(spark, sf, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, TEXTS[4])]
    got = queries.op10_pii(spark, sf(documents=docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = TEXTS[4] if r["doc_id"] is None else TEXTS[r["doc_id"]]
        exp = brute(t)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in exp) for k in KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in exp)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("iban")) == text


def test_iban_checksum_and_context_score(spark, docs):
    r = pii.report(docs([(1, TEXTS[9]), (2, "nothing near 4012888888881881"), (3, "card 4012888888881881")])).orderBy("doc_id").collect()
    assert r[0]["spans"] == "iban:5:27,iban:28:50" and r[0]["scores"] == "1.0,0.9"
    assert (r[1]["scores"], r[2]["scores"]) == ("0.7", "0.9")


def test_redaction_joins_overlapping_spans(spark, docs):
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs(list(enumerate(TEXTS)))).collect()}
    assert got[0] is None and got[1] == ""
    assert got[2] == "[EMAIL][EMAIL] [EMAIL]"
    assert got[8] == "[EMAIL] [IP]@x [PHONE]"
    assert got[14].endswith(" [IP]") and len(got[14]) == 200_005
    assert not any(brute(t) for i, t in got.items())


def test_empty_table(spark, sf, docs):
    assert queries.op10_pii(spark, sf(documents=docs([]))).count() == 0
    assert pii.redact(docs([])).count() == 0


def test_iban_ends_where_its_country_says(spark, docs):
    def iban(country, n):
        bban = ("1904300234573201" * 2)[:n - 4]
        code = "".join(str(int(c, 36)) for c in bban + country + "00")
        return f"{country}{98 - int(code) % 97:02}{bban}"
    rows, exp = [], []
    for n, countries in pii.IBAN_LENGTHS.items():
        for c in countries.split():
            whole = iban(c, n)
            for x in (whole, " ".join(whole[i:i + 4] for i in range(0, n, 4))):
                for after in ("", " BIC BKAUATWW", " A1", " 12 EUR", ". TO"):
                    exp.append(f"iban:3:{3 + len(x)}")
                    rows.append((len(rows), "to " + x + after))
    rows += [(9000, "ID42 DE89 3704 0044 0532 0130 00 BIC"), (9001, "AT61 1904 3002 3457 3202 BIC BKAUATWW"), (9002, "AT61 1904 3002 3457")]
    exp += ["iban:5:32", "", ""]
    got = {r["doc_id"]: ",".join(x for x in r["spans"].split(",") if x.startswith("iban")) for r in pii.report(docs(rows)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, exp)}
    text = pii.redact(docs([(1, "AT61 1904 3002 3457 3201 BIC BKAUATWW")])).first()["text"]
    assert text == "[IBAN] BIC BKAUATWW"

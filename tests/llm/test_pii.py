from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from tallycast.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(x):
    return re.sub("[^0-9]", "", x)


def passes(kind, x):
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        d = [int(c) for c in digits(x)][::-1]
        return 16 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * c, 10)) for c in d[1::2]]) % 10 == 0
    return kind != "phone" or 8 <= len(digits(x)) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def texts():
    rng = random.Random(11)
    parts = ["a@b.c@d.e", "x.y@mail.example.com", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "10.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (722) 555-8977", "+12", "+49 30 1234567.", "@", ".", "-", " ", "é🙂", "0012.3.4.5", "42", "word", "%@", "a@b", "+", "(", "9" * 40, "1" * 16]
    return [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]


def test_base_spans_equal_the_plain_patterns():
    for text in texts():
        assert [s[:3] for s in pii.scan(text) if s[0] in pii.BASE] == brute(text), text


def test_checksums_and_context():
    iban = "GB82 WEST 1234 5698 7654 32"
    assert [s[0] for s in pii.scan(f"pay to {iban} now")] == ["iban"]
    assert pii.scan("pay to GB83 WEST 1234 5698 7654 32 now") == []
    assert [s[0] for s in pii.scan("amex card 378282246310005 ok")] == ["short_card"]
    assert pii.scan("number 378282246310005 ok") == []
    assert [s[0] for s in pii.scan("call me: (722) 555-8977")] == ["local_phone"]
    assert pii.scan("sum (722) 555-8977") == []
    assert [s[0] for s in pii.scan("SSN 078-05-1120")] == ["national_id"]


def test_mask():
    text = "é mail a@b.cd and 10.0.0.1 end"
    assert pii.masked(text, pii.scan(text)) == "é mail <EMAIL> and <IP> end"
    assert pii.masked(None, []) is None


@pytest.mark.parametrize("run", ["1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" + " " * 300_000, "A1" * 150_000, "1 " * 150_000])
def test_long_runs_take_linear_time(run):
    start = time.time()
    pii.scan(run)
    assert time.time() - start < 5


LOOKING_BACK_FIRST = {
    "DOTTED": r"[0-9]+(?:\.[0-9]+)*",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "LOCAL_PHONE": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "NATIONAL_ID": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}


@pytest.mark.parametrize("name", LOOKING_BACK_FIRST)
def test_patterns_find_what_they_found_with_the_look_back_first(name):
    rng = random.Random(5)
    wholes = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "(722) 555-8977", "(722)555.8977", "722-555-8977", "078-05-1120", "10.0.0.1", "1.2.3.4.5"]
    between = ["", "", " ", "-", ".", "+", "(", ")", "1", "A", "a", "\n", "é", "12", "AB"]
    matches = 0
    for _ in range(8000):
        text = "".join(rng.choice(between) + rng.choice(wholes)[rng.choice([0, 0, 0, 1, 3]):] + rng.choice(between) for _ in range(rng.randint(1, 4)))
        want = [m.span() for m in re.finditer(LOOKING_BACK_FIRST[name], text)]
        assert [m.span() for m in getattr(pii, name).finditer(text)] == want, text
        matches += len(want)
    assert matches > 500


def test_texts_without_digits_and_at_signs_are_not_searched(monkeypatch):
    class Searched:
        def finditer(self, text):
            raise AssertionError(text)

    for name in ["DOTTED", "DIGITS", "PHONE", *list(LOOKING_BACK_FIRST)[1:]]:
        monkeypatch.setattr(pii, name, Searched())
    assert pii.scan("call me + (no number): ABCD WEST ٣٤٥ ①② host. name") == []
    with pytest.raises(AssertionError):
        pii.scan("call 1")


def test_report_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = brute(r.text)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(k == "card" for k, _, _ in spans)
        assert {*filter(None, text.split(","))} <= {*got[r.doc_id].spans.split(",")}


def test_odd_tables(spark):
    rows = [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "m a@b.cd " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.find(df).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 0, 3000]
    assert pii.report(df.limit(0)).count() == 0
    assert sorted(pii.mask(df).collect(), key=str)[0].spans in "xyz"

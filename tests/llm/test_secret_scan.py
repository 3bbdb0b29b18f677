from __future__ import annotations

import hashlib
import random
import re
import time

from tallycast.llm import secret_scan as ss

PLAIN = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def texts():
    rng = random.Random(5)
    pieces = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3,
              "0123456789abcdef", "é", "🙂", "ſecret", "toKen", "x", ".", "-", "12345", "f" * 23]
    return [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(4000)]


def test_base_spans_equal_the_plain_patterns():
    for text in texts():
        assert [s[:3] for s in ss.parts(text) if s[0] != "format"] == brute(text), text


def test_automata_tell_formats_apart():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(500)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(500)]
    a, b = ss.Automaton(hexes[:400]), ss.Automaton(keys[:400])
    assert len(a.log) < 60 and len(b.log) < 60
    assert all(a.bits(x) > b.bits(x) for x in hexes[400:]) and all(b.bits(x) > a.bits(x) for x in keys[400:])
    assert all(ss.gain([a, b], x) > ss.PER_CHAR * len(x) for x in hexes[400:] + keys[400:])
    assert all(ss.gain([a, b], x) < 0 for x in ["mail7.example.com", "some-long-word.with.2.dots", "2024-01-02-03-04-05"])


def test_probabilities_of_short_words_sum_to_one():
    values = ["ab", "ab", "aab", "b", "aaab", "b"] * 50
    a = ss.Automaton(values)
    words, total = [""], 0.0
    for _ in range(14):
        total += sum(2 ** a.bits(w) for w in words if a.bits(w) > ss.UNSEEN)
        words = [w + c for w in words for c in "ab" if a.bits(w + c) > 3 * ss.UNSEEN and 2 ** a.bits(w + c) >= 0]
    assert 0.9 < total <= 1.01


def test_long_runs_take_linear_time():
    for text in ["a" * 400_000, "1" * 400_000, "token " * 80_000, "token" + " " * 400_000, "1 " * 200_000, "AKIA" * 100_000]:
        start = time.time()
        ss.parts(text)
        assert time.time() - start < 5


def test_report_on_documents_and_planted_format(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(0)
    assert ss.report(docs).count() == 0
    rng = random.Random(2)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"word token = \"{hexed(40)}\" word") for i in range(300)]
    rows += [(1000, f"plain {hexed(17)}a1 text"), (1001, None), (1002, ""), (1002, ""), (None, "see mail7.example.com today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ss.report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].spans.startswith("format:6:") and by[1000].n_hex == 0
    assert by[1001].spans == "" and by[None].spans == ""
    for i, text in rows[:300]:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()

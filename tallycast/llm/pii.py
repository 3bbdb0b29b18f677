"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) keep every span that passes its own test. The further kinds need a score of
`KEEP`: a proposal starts with the prior of its kind, gains `CHECKED` for a valid checksum and `CONTEXT` for a word
of its kind within `NEAR` characters, and loses as much where a word of another use (order numbers and the like)
stands there. A further span that overlaps a base span is dropped. Offsets are code points, ends exclusive.

All searches take time linear in the text, also on long runs of digits, dots or address characters: each run is
read once, and what stands in it is counted off instead of being matched again from every start; overlaps are looked
up by halving.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import Taken, map_texts

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "short_card", "local_phone", "national_id"]
ORDER = {kind: i for i, kind in enumerate(KINDS)}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "short_card": 0.2, "local_phone": 0.4, "national_id": 0.4}
CHECKED, CONTEXT, KEEP, NEAR = 0.4, 0.3, 0.7, 40
WORDS = {
    "email": ["mail", "contact"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"], "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "short_card": ["card", "amex", "diners", "credit", "karte", "carte", "tarjeta"],
    "local_phone": ["phone", "tel", "call", "mobile", "fax"], "national_id": ["ssn", "social security", "tax id"],
}
OTHER_USE = ["order no", "invoice", "version", "isbn", "part no"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A text without any of these has no span of any kind.
NEEDED = "@0123456789"
# Each pattern opens with the class of its first character, so that `re` skips to the next one of that class; what may
# not stand before it is asked for after it.
DOTTED = re.compile(r"[0-9][0-9]*(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9+].)(?:(?<=\()[0-9]{3}\)\x20?|(?<=[0-9])[0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")

Span = tuple[str, int, int, float]
SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of a chain of numbers joined by dots, each four in turn are one match."""
    for chain in DOTTED.finditer(text):
        if "." not in chain[0]:
            continue
        at, parts = chain.start(), chain[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            start, at = at, at + sum(map(len, four)) + 4
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield start, at - 1


def numbers(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Start, end, digits and checksum of each chain of digits that may be a card of 13 to 19 digits."""
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                yield m.start(), m.end(), len(digits), luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.start(), m.end()


def near(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR):start].lower() + " " + text[end:end + NEAR // 2].lower()
    return CONTEXT * (any(re.search(rf"\b{w}", around) for w in WORDS[kind]) - any(w in around for w in OTHER_USE))


def scan(text: str | None) -> list[Span]:
    """All spans of a text by kind as listed, then start; none for a null or empty text."""
    if not text or not any(c in text for c in NEEDED):
        return []
    found: list[Span] = []

    def add(kind: str, start: int, end: int, checked: bool) -> None:
        score = min(1.0, max(0.0, PRIOR[kind] + CHECKED * checked + near(text, kind, start, end)))
        if kind in BASE or score >= KEEP:
            found.append((kind, start, end, round(score, 3)))

    cards = list(numbers(text))
    for start, end in emails(text):
        add("email", start, end, False)
    for start, end in addresses(text):
        add("ip", start, end, False)
    for start, end, n, valid in cards:
        if n >= 16 and valid:
            add("card", start, end, True)
    for start, end in phones(text):
        add("phone", start, end, False)
    taken = Taken((s, e) for _, s, e, _ in found)
    further = [("short_card", s, e, True) for s, e, n, valid in cards if n < 16 and valid]
    further += [("iban", m.start(), m.end(), True) for m in IBAN.finditer(text) if mod97(m[0])]
    further += [("local_phone", m.start(), m.end(), False) for m in LOCAL_PHONE.finditer(text)]
    further += [("national_id", m.start(), m.end(), False) for m in NATIONAL_ID.finditer(text)]
    for kind, start, end, checked in further:
        if not taken.meets(start, end):
            add(kind, start, end, checked)
    return sorted(found, key=lambda x: (ORDER[x[0]], x[1]))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Every column but the text, and the spans of the whole text as array<struct<kind,start,end,score>>. A column
    already named like `spans` is replaced. One row for each row, whatever repeats; null texts have no spans."""
    slim = docs.drop(*[c for c in docs.columns if c.lower() == spans.lower()])
    return map_texts(slim, text, scan, T.StructField(spans, SPAN), ARROW_SPAN, keep_text=False)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the spans of each text masked; same columns and rows, repeated ones too. Null texts stay null."""
    return map_texts(docs, text, lambda x: masked(x, scan(x)), docs.schema[text], pa.string())


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span.kind == kind


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.kind.isin(BASE))
    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

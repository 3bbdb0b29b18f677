"""Secrets: base patterns, and formats learnt from the credentials that the patterns label.

1. A first pass over the texts gives the credentials of the base spans (assign, access, hex): labelled values. From about
   `LEARN` distinct values a kind at most, chosen by digest, a prefix tree is built whose states are merged where
   their outgoing frequencies agree (Hoeffding's bound at `ALPHA`, checked down the whole subtree), red states first: a
   deterministic probabilistic automaton a kind.
2. A second pass scores every candidate, that is every run of credential characters that does not overlap a base span
   (only runs of one or two characters, which cannot reach `TOTAL`, are left out): the log-likelihood under the best automaton against evenly
   drawn credential characters, in bits. A candidate that gains `PER_CHAR` a character and `TOTAL` in all becomes a
   span `format`. A likelihood only falls with each character, so a run is given up as soon as it cannot reach that.

Texts are read twice and never shuffled. Automata are bounded by LEARN x length of a value.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import Taken, map_texts, written

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "format"]
LEARN, LONGEST, ALPHA = 1_000, 128, 0.05
PER_CHAR, TOTAL = 1.0, 20.0
#: Distinct candidates whose verdict a task remembers, and the longest of them.
KNOWN, KNOWN_LENGTH = 1 << 16, 64

CREDENTIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN, HEX_LEAST = bytes(0x68 if c in b"0123456789abcdef" else 0x2E for c in range(256)), 24
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Bits of a character, or an end, that a state has never seen, and of one character drawn evenly.
UNSEEN, EVEN = -14.0, math.log2(1 / (len(CREDENTIAL) + 1))
#: No shorter run can gain TOTAL, as a likelihood is one at most.
LEAST = math.ceil(-TOTAL / EVEN) - 1


def base_spans(text: str, latin: bytes, lower: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and credential of each base span, by start, then kind as listed. `latin` holds a byte for
    each character, so its offsets are those of the text."""
    found = []
    if any(name in lower for name in NAMES):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    classes = latin.translate(HEX_RUN)
    at = classes.find(b"h" * HEX_LEAST)
    while at >= 0:
        end = classes.find(b".", at)
        end = len(classes) if end < 0 else end
        found.append(("hex", at, end, text[at:end]))
        at = classes.find(b"h" * HEX_LEAST, end)
    return sorted(found, key=lambda x: (x[1], BASE.index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Start, end and value of each run of at least `LEAST` credential characters outside the base spans."""
    taken = Taken((s, e) for _, s, e, _ in base)
    for m in RUN.finditer(text):
        if m.end() - m.start() >= LEAST and not taken.meets(m.start(), m.end()):
            yield m.start(), m.end(), m[0]


def parts(text: str | None, formats: Formats | None = None) -> list[tuple[str, int, int, str]]:
    """All spans of a text by start, then kind as listed; base spans only without `formats`."""
    if not text:
        return []
    base = base_spans(text, text.encode("latin-1", "replace"), text.lower())
    if formats is None or not formats.automata:
        return base
    likely = [("format", s, e, v) for s, e, v in candidates(text, base) if formats.likely(v)]
    return sorted(base + likely, key=lambda x: (x[1], KINDS.index(x[0])))


class Automaton:
    """A probabilistic automaton merged from the prefix tree of `values`."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.ends: list[int] = [0]
        self.total: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        for value in sorted(values):
            self._insert(value)
        self._merge_states()

    def _insert(self, value: str) -> None:
        state = 0
        for c in value:
            self.total[state] += 1
            self.count[state][c] += 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
                self.ends.append(0)
                self.total.append(0)
            state = self.next[state][c]
        self.total[state] += 1
        self.ends[state] += 1

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.width * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differs(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for c in {*self.count[a], *self.count[b]}:
                if self._differs(self.count[a].get(c, 0), self.total[a], self.count[b].get(c, 0), self.total[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> list[int]:
        """Adds the tree below b to a; gives the states that took part of it."""
        todo, changed = [(a, b)], []
        while todo:
            a, b = todo.pop()
            changed.append(a)
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to
        return changed

    def _merge_states(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    grown = [x for x in dict.fromkeys(self._fold(r, state)) if x in red]
                    break
            else:
                red.append(state)
                grown = [state]
            waiting = set(blue)
            blue += [(g, x) for g in grown for x in sorted(self.next[g]) if self.next[g][x] not in red and (g, x) not in waiting]
        self.log = {}
        for r in red:
            n = self.total[r]
            self.log[r] = {c: math.log2(k / n) for c, k in self.count[r].items()} | ({"": math.log2(self.ends[r] / n)} if self.ends[r] else {})

    def bits(self, value: str, floor: float = -math.inf) -> float:
        """Log-likelihood; unseen characters cost `UNSEEN` and leave the state. Minus infinity once below `floor`."""
        state, out, log, follow = 0, 0.0, self.log, self.next
        for c in value:
            out += log[state].get(c, UNSEEN)
            if out < floor:
                return -math.inf
            state = follow[state].get(c, state)
        return out + log[state].get("", UNSEEN)


def gain(automata: list[Automaton], value: str) -> float:
    return max((a.bits(value) for a in automata), default=-math.inf) - (len(value) + 1) * EVEN


class Formats:
    """The automata together."""

    def __init__(self, automata: list[Automaton]):
        self.automata = automata

    def _likely(self, value: str) -> bool:
        needed = max(TOTAL, PER_CHAR * len(value)) + (len(value) + 1) * EVEN
        return any(a.bits(value, needed) >= needed for a in self.automata)

    def likely(self, value: str) -> bool:
        """Whether a value is like a credential; verdicts on short values are remembered."""
        return _remembered(self)(value) if len(value) <= KNOWN_LENGTH else self._likely(value)


@lru_cache(maxsize=1)
def _remembered(formats: Formats) -> Callable[[str], bool]:
    return lru_cache(maxsize=KNOWN)(formats._likely)


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()),
]))


ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _spans(docs: DataFrame, text: str, formats: Formats | None = None) -> DataFrame:
    return map_texts(docs, text, lambda x: parts(x, formats), T.StructField("spans", SPAN), ARROW_SPAN, keep_text=False)


def learn(spans: DataFrame) -> Formats:
    """An automaton for each kind with labelled credentials, from about LEARN distinct values at most, of at most
    LONGEST characters each (the bound on what the models are fitted on)."""
    values = written(spans.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
                     .where(F.col("kind").isin(BASE) & (F.length("value") <= LONGEST)).distinct(), "credentials")
    slots = 1 << 30
    share = {r.kind: min(slots, LEARN * slots // r["count"]) for r in values.groupBy("kind").count().collect()}
    if not share:
        return Formats([])
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("kind"))
    chosen = values.where(F.pmod(F.xxhash64("value"), F.lit(slots)) < limit).collect()
    by_kind = defaultdict(list)
    for row in chosen:
        by_kind[row.kind].append(row.value)
    return Formats([Automaton(by_kind[kind]) for kind in BASE if by_kind[kind]])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text and with `spans`, an array<struct<kind,start,end,value>> by start, then kind: base
    spans, and candidates of a learnt format. A column already named `spans` is replaced. One row for each row; a
    null or empty text has none, and without labelled credentials there are base spans only (none)."""
    slim = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    return _spans(slim, text, learn(_spans(slim.select(text), text)))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span.kind == kind


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.kind.isin(BASE))
    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Learning, on at most about `FIT_ROWS` labelled documents (`common.labelled_sample`):
1. Units of a word (the word, its first five and first four letters) are counted by class. A unit's log-odds have an
   informative Dirichlet prior of `PRIOR` of all counts, spread as the units are in both classes; units whose
   log-odds exceed `SIGNIFICANT` standard errors are kept. Kept units are counted again by
   different neighbours, so that copies of a document make no evidence, and must still exceed it. A word scores its highest kept unit; any
   other word scores the log-odds of not being one, which is below zero.
2. lambda solves E[exp(lambda s)] = 1 over words of clean documents; K is fitted to the segments found there. A
   segment of score s in n words is expected K n exp(-lambda s) times by chance.
3. A fourth of the sample, not used for the log-odds, turns the sum statistic of a document into a probability.

Scoring, every whole text: a linear-time scan gives all maximal segments (each as high as can be, none overlapping);
those expected less than `CHANCE` times are its toxic passages, and their summed, length-corrected scores give the
document's score. The model has at most the units of the bounded sample, so it goes to the tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import add_columns, digest_id, labelled_sample, written

FIT_ROWS = 20_000
PRIOR, SIGNIFICANT, CHANCE = 0.01, 3.0, 0.05
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
CACHE, FLUSH = 300_000, 200_000
WORD = re.compile(r"[^\W\d_]+")
PASSAGES = "array<struct<start:int,end:int,score:double>>"
PASSAGE_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def units(word: str) -> list[str]:
    return ["=" + word, *(f"{k}{word[:k]}" for k in (5, 4) if len(word) > k)]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence with `scores` at `places` and -drift at every
    other place, by Ruzzo and Tompa's method: each candidate is joined to an earlier one only if that one starts
    lower and ends lower; the search goes back from candidate to candidate."""
    total, before = 0.0, -1
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, nearest that starts lower
    for place, s in zip(places, scores):
        total -= drift * (place - before - 1)
        first, last, left, total, before = place, place, total, total + s, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, last, left, total, j))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, right - left) for first, last, left, right, _ in found]


class Model:
    def __init__(self, odds: dict[str, float], drift: float):
        self.odds, self.drift = odds, drift
        self.rate, self.k = 1.0, 1.0
        self.slope, self.offset = 1.0, 0.0
        self.cached: dict[str, float | None] = {}

    def word(self, word: str) -> float | None:
        s = self.cached.get(word, 0.0)
        if s == 0.0:
            s = max((self.odds[u] for u in units(word) if u in self.odds), default=None)
            if len(self.cached) >= CACHE:
                self.cached.clear()
            if len(word) <= 64:
                self.cached[word] = s
        return s

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall(text.lower())
        scored = [(i, s) for i, s in enumerate(map(self.word, words)) if s is not None]
        return len(words), maximal_segments([i for i, _ in scored], [s for _, s in scored], self.drift) if scored else []

    def expected(self, n: int, s: float) -> float:
        return self.k * max(n, 1) * math.exp(-min(self.rate * s, 700.0))

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The sum statistic of a text and its significant passages."""
        n, found = self.segments(text)
        base = math.log(self.k * max(n, 1) + 1)
        passages = [x for x in found if self.expected(n, x[2]) < CHANCE]
        gains = sorted((self.rate * s - base for _, _, s in passages), reverse=True)
        best = max((self.rate * s for *_, s in found), default=0.0) - base
        total, kept = 0.0, best
        for r, g in enumerate(gains, 1):  # the r highest together; r! ways to order them
            total += g
            kept = max(kept, total + math.lgamma(r + 1))
        return kept, passages

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * statistic + self.offset, -60, 60)))

    def fit_chance(self, clean: list[tuple[int, list[float], dict[float, int]]]) -> None:
        """lambda and K from clean documents: words, segment scores, and how often each word score occurs."""
        n = sum(x[0] for x in clean)
        counts = Counter()
        for _, _, of_words in clean:
            counts.update(of_words)
        rest = n - sum(counts.values())
        if not n:
            return
        moment = lambda t: (rest * math.exp(-t * self.drift) + sum(c * math.exp(t * s) for s, c in counts.items())) / n - 1
        low, high = 1e-3, 1.0
        while counts and moment(high) < 0 and high < 8:
            high *= 2
        if counts and moment(low) < 0:
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if moment(mid) < 0 else (low, mid)
            self.rate = low
        else:
            self.rate = 1.0 if not counts else low
        # the mean of exp(-rate s) K n over the best segments of documents is 1; one event is added so that K is never 0
        tails = [min(math.exp(self.rate * max(found, default=0.0)), 1e6) for _, found, _ in clean]
        self.k = max(1.0, sum(t - 1 for t in tails)) / n

    def fit_probability(self, statistic: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset by Newton steps, with a weak pull to slope 1, so that separable classes stay finite."""
        if not len(y):
            return
        w = np.array([1.0, 0.0])
        x = np.stack([np.clip(statistic, -40, 40), np.ones(len(y))], axis=1)
        pull = np.array([1.0, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            slope = x.T @ (p - y) + pull * (w - [1.0, 0.0])
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(curve, slope)
            w = w - step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, y, n) summed over the sample; tasks give partial sums of at most FLUSH units at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())

        def flush():
            for y in (0, 1):
                if counts[y]:
                    yield pd.DataFrame({"unit": pd.Series(list(counts[y]), dtype=object), "y": y, "n": list(counts[y].values())})
                    counts[y].clear()

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                for word in WORD.findall(text.lower()):
                    counts[y].update(units(word))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    return sample.select("text", "y").mapInPandas(run, "unit string, y int, n long")


def distinct_contexts(sample: DataFrame, kept: set[str]) -> DataFrame:
    """(unit, c1, c0): in how many different pairs of neighbouring words each kept unit stands, by class. Copies of
    a document repeat the neighbours too, so they count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for text, y in zip(batch["text"], batch["y"]):
                words = ["", *WORD.findall(text.lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    found.update((u, y, zlib.crc32(f"{before} {after}".encode())) for u in units(word) if u in kept)
            yield pd.DataFrame({"unit": pd.Series([u for u, _, _ in found], dtype=object), "y": [y for _, y, _ in found], "around": [c for _, _, c in found]})

    each = sample.select("text", "y").mapInPandas(run, "unit string, y int, around long").distinct()
    return each.groupBy("unit").agg(F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0"))


def log_odds(sample: DataFrame) -> tuple[dict[str, float], float]:
    """Kept units with their log-odds, and the drift of all other words."""
    kind = F.substring("unit", 1, 1)
    counts = written(unit_counts(sample).groupBy("unit").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c0")).withColumn("kind", kind), "units")
    totals = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).collect()}
    if "=" not in totals or not totals["="].n1 or not totals["="].n0:
        return {}, 0.01
    n1, n0 = (F.element_at(F.create_map(*[x for k, r in totals.items() for x in (F.lit(k), F.lit(float(r[c])))]), F.col("kind")) for c in ("n1", "n0"))
    a0 = PRIOR * (n1 + n0)
    a = PRIOR * (F.col("c1") + F.col("c0"))
    odds = F.log((F.col("c1") + a) / (n1 + a0 - F.col("c1") - a)) - F.log((F.col("c0") + a) / (n0 + a0 - F.col("c0") - a))
    error = F.sqrt(1 / (F.col("c1") + a) + 1 / (F.col("c0") + a))
    kept = counts.withColumn("odds", odds).withColumn("z", odds / error).where((F.col("z") >= SIGNIFICANT) & (F.col("c1") > F.col("c0")))
    # all significant units of a sample of at most FIT_ROWS documents
    rows = sorted(kept.collect(), key=lambda r: (-r.z, r.unit))
    weigh = {k: (float(t.n1), float(t.n0)) for k, t in totals.items()}
    odds = {}
    for r in distinct_contexts(sample, {x.unit for x in rows}).collect():
        n1, n0 = weigh[r.unit[0]]
        a, a0 = PRIOR * (r.c1 + r.c0), PRIOR * (n1 + n0)
        value = math.log((r.c1 + a) / (n1 + a0 - r.c1 - a)) - math.log((r.c0 + a) / (n0 + a0 - r.c0 - a))
        if value >= SIGNIFICANT * math.sqrt(1 / (r.c1 + a) + 1 / (r.c0 + a)) and r.c1 > r.c0:
            odds[r.unit] = value
    r = totals["="]
    share1, share0 = (sum(x[c] for x in rows if x.kind == "=" and x.unit in odds) / n for c, n in (("c1", r.n1), ("c0", r.n0)))
    drift = max(0.005, -math.log((1 - share1) / (1 - share0)) if share1 < 1 else 1.0)
    return odds, drift


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model:
    """Without toxic and clean labelled rows the model has no units; then every score is 0.5 at most."""
    chosen = labelled_sample(docs, labels, label, usable, FIT_ROWS)
    sample = written(chosen.withColumn("held", F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))), F.lit(4)) == 0), "toxic")
    model = Model(*log_odds(sample.where("NOT held")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, y in zip(batch["doc_id"], batch["text"], batch["y"]):
                n, found = model.segments(text)
                of_words = Counter(s for s in map(model.word, WORD.findall(text.lower())) if s is not None)
                rows.append((doc, y, n, [s for *_, s in found], list(of_words), list(of_words.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "n", "found", "s", "c"])

    # at most about FIT_ROWS / 4 rows, with numbers for flagged words only
    rows = sorted(sample.where("held").select("doc_id", "text", "y").mapInPandas(run, "doc_id long, y int, n int, found array<double>, s array<double>, c array<int>").collect(), key=lambda r: r.doc_id)
    model.fit_chance([(r.n, r.found, dict(zip(r.s, r.c))) for r in rows if r.y == 0])
    base = [math.log(model.k * max(r.n, 1) + 1) for r in rows]
    statistic = []
    for r, b in zip(rows, base):
        gains = sorted((model.rate * s - b for s in r.found if model.expected(r.n, s) < CHANCE), reverse=True)
        sums = np.cumsum(gains) + [math.lgamma(k + 2) for k in range(len(gains))]
        statistic.append(max([model.rate * max(r.found, default=0.0) - b, *sums]))
    model.fit_probability(np.array(statistic), np.array([r.y for r in rows], float))
    model.cached.clear()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row's whole text; passages are ranges of word numbers, ends exclusive.
    Null and empty texts have no passage and the score of a statistic of zero."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(texts: list[str | None]) -> list[pa.Array]:
        judged = [shared.value.judged(t or "") for t in texts]
        return [
            pa.array(shared.value.probability(np.array([s for s, _ in judged], float)), pa.float64()),
            pa.array([[{"start": a, "end": b + 1, "score": s} for a, b, s in found] for _, found in judged], PASSAGE_LIST),
        ]

    new = T.StructType.fromDDL(f"score double, passages {PASSAGES}").fields
    return add_columns(docs.select("doc_id", "text"), "text", lambda: made, new)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages; labels of held-out ids are not read, a null id is not held out."""
    fold = F.pmod(digest_id(F.col("doc_id")), F.lit(FOLDS))
    out = score(docs, fit(docs, labels, fold != HELD_OUT))
    return out.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")

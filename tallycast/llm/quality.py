"""Quality classifier: random-indexing word vectors pooled per document, and a small network on top.

Words. A text is cut into runs of letters, digits and marks; each run gives a word (lower-cased) and a shape (case
and length class). Words are hashed to `BUCKETS` rows, each with a sparse random index vector of `WIDTH` that only
depends on the row. The vector of a word is its index vector plus the normed sum of the index vectors that stand
within `REACH` of it, gathered over the fitting sample.
Documents. Means and mean squares of the vectors, the norm of the mean, and a few counts (length, distinct words,
repeats next to each other). The whole text is pooled, in chunks.
Network. Two layers in numpy, Adam, weights from a fixed seed; a part of the sample sets the temperature.

The model is fitted on at most about `FIT_ROWS` labelled documents (`common.labelled_sample`) and is BUCKETS x WIDTH
numbers plus the network whatever the input, so it is broadcast. Every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import add_columns, digest_id, labelled_sample, written

FIT_ROWS, FIT_TASKS = 20_000, 16
BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 48, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 30, 256, 3e-3, 1e-4, 17
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
CHUNK, CACHE, ROWS, SLICE = 1 << 15, 300_000, 512, 1 << 10
RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
N_FEATURES = 2 * WIDTH + 6


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def shape(run: str) -> str:
    if run[0].isalpha():
        kind = "u" if run.isupper() else "l" if run.islower() else "t" if run[0].isupper() else "m"
        return f"\0{kind}{min(len(run), 12) // 3}"
    return "\0d" if run[0].isdigit() else f"\0{run[:1]}{min(len(run), 3)}"


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)) / np.float32(NONZERO ** 0.5), axis=1)
    return out


class Words:
    """Bucket numbers of the words and shapes of texts."""

    def __init__(self):
        self.cached: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> np.ndarray:
        """(runs, 2): word and shape."""
        cached, out = self.cached, []
        for run in RUNS.findall(text):
            pair = cached.get(run)
            if pair is None:
                pair = (bucket(run.lower()), bucket(shape(run)))
                if len(run) <= 64:
                    if len(cached) >= CACHE:
                        cached.clear()
                    cached[run] = pair
            out.append(pair)
        return np.array(out, np.int32).reshape(-1, 2)


def add_contexts(total: np.ndarray, index: np.ndarray, runs: np.ndarray) -> None:
    for at in range(0, len(runs), CHUNK):
        some = runs[at:at + CHUNK]
        around = np.zeros((len(some), WIDTH), np.float32)
        both = index[some[:, 0]] + index[some[:, 1]]
        for d in range(1, REACH + 1):
            around[d:] += both[:-d]
            around[:-d] += both[d:]
        for column in (0, 1):
            np.add.at(total, some[:, column], around)


def word_vectors(total: np.ndarray, index: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (index + total / np.maximum(norm, 1e-6)).astype(np.float32)


def pooled(runs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = len(runs)
    out = np.zeros(N_FEATURES, np.float32)
    if not n:
        return out
    first, second = np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, n, CHUNK):
        x = vectors[runs[at:at + CHUNK, 0]] + vectors[runs[at:at + CHUNK, 1]]
        first += x.sum(axis=0, dtype=np.float64)
        second += np.einsum("ij,ij->j", x, x, dtype=np.float64)
    mean = first / n
    words = runs[:, 0]
    out[:WIDTH], out[WIDTH:2 * WIDTH] = mean, second / n
    out[2 * WIDTH:] = (
        np.linalg.norm(mean), np.log1p(n), len(np.unique(words)) / n, np.mean(words[1:] == words[:-1]) if n > 1 else 0,
        np.mean(words[2:] == words[:-2]) if n > 2 else 0, 1,
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Features -> HIDDEN tanh units -> log-odds, divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray):
        """Rows marked in `calibration` set the temperature only (all rows, where that leaves too few)."""
        fit = ~calibration if (~calibration).sum() >= 10 and calibration.sum() >= 10 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0, dtype=np.float64), x[fit].std(axis=0, dtype=np.float64) + 1e-3
        rng = np.random.default_rng(SEED)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._train(x[fit], y[fit], rng)
        self._calibrate(x[~fit] if (~fit).any() else x, y[~fit] if (~fit).any() else y)

    def _normed(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        m, v, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at:at + BATCH]
                a, t = self._normed(x[rows]), y[rows]
                h = np.tanh(a @ self.w[0] + self.w[1])
                d = (sigmoid(h @ self.w[2] + self.w[3]) - t) / len(rows)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                slopes = [a.T @ back + DECAY * self.w[0], back.sum(axis=0), h.T @ d + DECAY * self.w[2], d.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(slopes):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._normed(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        grid = np.exp(np.linspace(-2, 3, 101))
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * z / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def features(df: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, y, part, x) of `df` (..., text) in blocks: a row has the bytes of up to `ROWS` rows' numbers and pooled features."""
    model = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.iloc[at:at + ROWS]
                x = np.array([pooled(words.of(t or ""), model.value) for t in some["text"]], np.float32)
                yield pd.DataFrame({**{c: [some[c].to_numpy(np.int64).tobytes()] for c in ("doc_id", "y", "part")}, "x": [x.tobytes()]})

    return df.mapInPandas(run, "doc_id binary, y binary, part binary, x binary")


def gather(sample: DataFrame) -> np.ndarray:
    """Context sums over the sample: FIT_TASKS tasks at most have a matrix (3 MB) each, cut in slices that are added up by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, index, total = Words(), index_vectors(), np.zeros((BUCKETS, WIDTH), np.float32)
        for batch in batches:
            for text in batch["text"]:
                add_contexts(total, index, words.of(text))
        task = TaskContext.get().partitionId()
        for at in range(0, BUCKETS, SLICE):
            yield pd.DataFrame({"at": [at], "task": [task], "total": [total[at:at + SLICE].tobytes()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE * WIDTH)
        for one in group.sort_values("task")["total"]:
            total += np.frombuffer(one, np.float32)
        return pd.DataFrame({"at": group["at"].iloc[:1], "total": [total.tobytes()]})

    parts = sample.select("text").coalesce(FIT_TASKS).mapInPandas(run, "at long, task int, total binary")
    total = np.zeros((BUCKETS, WIDTH))
    for row in parts.groupBy("at").applyInPandas(added, "at long, total binary").collect():
        total[row["at"]:row["at"] + SLICE] = np.frombuffer(row.total).reshape(SLICE, WIDTH)
    return total


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> tuple[np.ndarray, Network | None]:
    """Word vectors and network from labelled documents; no network where no row is labelled. The driver gets the
    features of the sample as blocks of bytes, at most about FIT_ROWS x N_FEATURES x 4 (8 MB), and no object a number."""
    sample = written(labelled_sample(docs, labels, label, usable, FIT_ROWS), "quality")
    vectors = word_vectors(gather(sample), index_vectors())
    blocks = features(sample.withColumn("part", F.pmod(F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string"))), F.lit(5))).select("doc_id", "y", "part", "text"), vectors).collect()
    if not blocks:
        return vectors, None
    doc_id, y, part = (np.frombuffer(b"".join(r[c] for r in blocks), np.int64) for c in ("doc_id", "y", "part"))
    x = np.frombuffer(b"".join(r.x for r in blocks), np.float32).reshape(-1, N_FEATURES)
    del blocks
    order = np.lexsort((y, doc_id))
    return vectors, Network(x[order], y[order].astype(float), part[order] == 0)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None]) -> DataFrame:
    """(doc_id, score) of every row's whole text; null texts are empty, empty ones have the features zero. Without
    labelled rows every score is 0.5. Only the text enters the score."""
    vectors, network = model
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def start():
        words = Words()

        def made(texts: list[str | None]) -> list[pa.Array]:
            x = np.array([pooled(words.of(t or ""), shared.value) for t in texts]).reshape(-1, N_FEATURES)
            return [pa.array(network.score(x) if network else np.full(len(x), 0.5), pa.float64())]

        return made

    return add_columns(docs.select("doc_id", "text"), "text", start, [T.StructField("score", T.DoubleType())])


def kept(docs: DataFrame, model: tuple[np.ndarray, Network | None]) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold; without a network all rows."""
    vectors, network = model
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = np.array([pooled(words.of(t or ""), shared.value) for t in some.column("text").to_pylist()]).reshape(-1, N_FEATURES)
                yield some.filter(pa.array(network.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are not read. A null id counts as not held out."""
    fold = F.pmod(digest_id(F.col("doc_id")), F.lit(FOLDS))
    model = fit(docs, labels, fold != HELD_OUT)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

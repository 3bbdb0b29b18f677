"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index. Each vector x is divided by its length, rotated by a random orthogonal matrix from a fixed seed, and kept as
the signs of its coordinates (one bit each), with two correction scalars: the length |x| and a = <code, rotated
unit vector>. Every row is indexed, in blocks of at most `BLOCK` rows; nothing is sampled.
Search. For a rotated query q, |x| <code, q> / a estimates <q, x>, and with `SURE` standard errors
|x| |q| SURE sqrt((1 - a^2) / a^2 / (D - 1)) bounds its error. Of a block, the TOP best estimates (and their ties) are scored
exactly; all others whose upper bound reaches the worst of these follow, so that a miss needs an error beyond the bound.
The exact products of all pairs come from one matrix product, and only those that the bound lets through are used.
Final scores are sums in double precision in the order of the components.

The queries are a stated set (ids divisible by `EVERY`) and meet all blocks, in groups of about `GROUP`. Query groups
are broadcast up to `BROADCAST_BYTES`, else joined by a shuffle. Each pair of a group and a block gives TOP rows a
query, and a ranking window keeps TOP of them, cut down before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import written

TOP, EVERY = 20, 20
BLOCK, GROUP, BROADCAST_BYTES = 4096, 1024, 32 << 20
SURE, SEED = 2.2, 23
#: Share of |q| |x| by which a matrix product may differ from the sum in order.
SLACK = 1e-12
#: Share of |q| |x| / a by which estimates of one vector may differ in single precision.
TIED = 1e-5


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + width).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of code and rotated unit vector."""
    norm = np.linalg.norm(x, axis=1)
    rotated = (x / norm[:, None]) @ turn
    return np.packbits(rotated > 0, axis=1), norm, np.abs(rotated).sum(axis=1) / math.sqrt(x.shape[1])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    return np.add.reduce(np.ascontiguousarray(q.T) * np.ascontiguousarray(x.T), axis=0)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray,
                  a: np.ndarray, turn: np.ndarray, top: int = TOP, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, block rows and exact scores of the best `top` of the block for each query."""
    width = x.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=width).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(width))
    estimate = ((q @ turn).astype(np.float32) @ signs.T) * (norm / a).astype(np.float32)
    length = np.linalg.norm(q, axis=1)
    error = norm * sure * np.sqrt(np.maximum(1 - a * a, 0) / (a * a) / max(width - 1, 1))
    at = {v: i for i, v in enumerate(ids.tolist())}
    own = [(i, at[v]) for i, v in enumerate(q_ids.tolist()) if v in at]
    for i, j in own:
        estimate[i, j] = -np.inf
    products = q @ x.T  # all at once costs less than picking; only what the bound lets through is looked at
    if len(ids) > top:
        first = np.argpartition(estimate, len(ids) - top, axis=1)[:, -top:]
        known = np.take_along_axis(products, first, axis=1)
        known[np.isneginf(np.take_along_axis(estimate, first, axis=1))] = -np.inf
        # the TOP best estimates stay whatever their error, and so do those that tie with them, such as copies
        least = np.take_along_axis(estimate, first, axis=1).min(axis=1) - (TIED * length * (norm / a).max()).astype(np.float32)
        ruled_out = estimate < least[:, None]
        estimate += length.astype(np.float32)[:, None] * error.astype(np.float32)[None, :]
        ruled_out &= estimate < (known.min(axis=1) - SLACK * length * norm.max()).astype(np.float32)[:, None]
        products[ruled_out] = -np.inf
    for i, j in own:
        products[i, j] = -np.inf
    if len(ids) > top:
        least = np.partition(products, len(ids) - top, axis=1)[:, len(ids) - top] - SLACK * length * norm.max()
        rows, cols = np.nonzero((products >= least[:, None]) & (products > -np.inf))
    else:
        rows, cols = np.nonzero(products > -np.inf)
    score = np.concatenate([exact(q[rows[i:i + BLOCK]], x[cols[i:i + BLOCK]]) for i in range(0, len(rows), BLOCK)] or [np.empty(0)])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < top
    return rows[kept], cols[kept], score[kept]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part: an id, and a vector neither null, empty, zero nor with a null or
    non-finite component. Of rows with one id the least vector counts."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    return rows.where(sound).groupBy("vec_id").agg(F.min("x").alias("x"))


def index(vectors: DataFrame) -> DataFrame:
    """Blocks (width, n, ids, x, codes, norm, a) of all vectors, those of one width together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {}
        for batch in batches:
            widths = batch["x"].map(len).to_numpy()
            for width in np.unique(widths):
                some = batch[widths == width]
                turn = turns.setdefault(width, rotation(int(width)))
                for at in range(0, len(some), BLOCK):
                    part = some.iloc[at:at + BLOCK]
                    x = np.stack(part["x"].to_numpy()).astype(np.float64)
                    codes, norm, a = encode(x, turn)
                    yield pd.DataFrame({"width": [int(width)], "n": [len(part)], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()],
                                        "codes": [codes.tobytes()], "norm": [norm.tobytes()], "a": [a.tobytes()]})

    return vectors.mapInPandas(run, "width int, n int, ids binary, x binary, codes binary, norm binary, a binary")


def search(embeddings: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest of each vector whose id is divisible by `every` among all
    other ids of the same width, nearest first, ties to the smaller id; fewer where there are fewer."""
    vectors = written(usable(embeddings), "vectors")
    blocks = written(index(vectors), "codes")
    asked = vectors.where(F.col("vec_id") % every == 0).withColumn("width", F.size("x"))
    size = asked.agg(F.count("*").alias("n"), F.sum(8 * F.col("width")).alias("bytes")).first()
    groups = max(1, math.ceil(size["n"] / GROUP))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # about GROUP rows each, by the hash
    queries = asked.groupBy("width", "g").agg(F.collect_list(F.struct("vec_id", "x")).alias("q")).select("width", "g", F.col("q.vec_id").alias("q_ids"), F.flatten("q.x").alias("q"))
    met = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(F.broadcast(queries) if (size["bytes"] or 0) <= BROADCAST_BYTES else queries, ["width", "g"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                turn = turns.setdefault(r.width, rotation(r.width))
                of = lambda data: np.frombuffer(data, np.float64)
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.asarray(r.q_ids, np.int64)
                codes = np.frombuffer(r.codes, np.uint8).reshape(r.n, -1)
                q = np.asarray(r.q, np.float64).reshape(-1, r.width)
                rows, cols, score = best_of_block(q_ids, q, ids, of(r.x).reshape(r.n, r.width), codes, of(r.norm), of(r.a), turn, top)
                yield pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids[cols], "score": score})

    found = met.mapInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

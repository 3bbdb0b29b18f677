"""Alignment of two tokenizers over the bytes of a text, by products of sparse incidence matrices.

A token's row in a token-byte incidence matrix has a one at each of its bytes. With A and B in compressed rows
(CSR: row starts, columns, values), the product A.B^T has an entry for each pair of overlapping tokens, its value the
bytes that they share. Gustavson's rule makes a row of a product as the sum of those rows of the right matrix that
the row of the left one names; here all rows of a batch are spread and summed at once in NumPy.

The overlap links run like a staircase; where one steps in both directions at once, tokens of both sides end, and a
group ends. Groups give two more matrices, (text, A id) by group and group by B id, and their product has the number
of linked occurrences of each id pair of each text, without making the pairs of occurrences one by one.

1. One pass encodes the texts and writes what it finds: figures, a digest and the distinct id pairs of each text.
2. An id pair's count is the number of texts that hold it: a map-side combined aggregate over those pairs.
3. The counts go back to the texts' pairs: broadcast if they are at most `BROADCAST_ROWS` (about 50 bytes each),
   joined by a shuffle beyond. A task sums the pairs of a text before they are shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import scratch

BROADCAST_ROWS = 1_000_000
#: Characters that are aligned at once (a longer text alone), entries of a product that are summed at once.
CHUNK, SPREAD = 1 << 19, 1 << 22
# Fixed value: how byte-level tokenizers split a text by default.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"[\t\n -~\u00A1-\u00FF]*")
#: An id pair is one number: A id times this, plus B id.
SIDE = 1 << 20
FIGURES = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType(),
           "pairs": T.ArrayType(T.LongType()), "times": T.ArrayType(T.LongType())}


class Csr(NamedTuple):
    """Rows of a sparse matrix: row i has its columns at starts[i] to starts[i + 1]; no values means all ones."""
    starts: np.ndarray
    columns: np.ndarray
    width: int
    values: np.ndarray | None = None


def product(x: Csr, y: Csr) -> Csr:
    """x.y by Gustavson's rule, columns in order within each row."""
    each = np.diff(y.starts)[x.columns]
    brought = np.concatenate(([0], np.cumsum(each)))
    row_of = np.repeat(np.arange(len(x.starts) - 1), np.diff(x.starts))
    keys, sums, at = [], [], 0
    while at < len(x.columns):
        # whole rows, as many as bring SPREAD entries, one at least
        end = int(np.searchsorted(brought, brought[at] + SPREAD, "right")) - 1
        row_end = x.starts[np.searchsorted(x.starts, end, "right") - 1] if end < len(x.columns) else end
        end = int(row_end) if row_end > at else int(x.starts[row_of[at] + 1])
        part = slice(at, end)
        spread = each[part]
        place = np.arange(brought[end] - brought[at]) + np.repeat(y.starts[x.columns[part]] - (brought[at:end] - brought[at]), spread)
        key = np.repeat(row_of[part], spread) * y.width + y.columns[place]
        value = None
        if x.values is not None or y.values is not None:
            value = np.repeat(x.values[part] if x.values is not None else np.ones(end - at, np.int64), spread)
            if y.values is not None:
                value = value * y.values[place]
        if len(key) and (key[1:] < key[:-1]).any():
            if value is None:
                key = np.sort(key)
            else:
                order = np.argsort(key)
                key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        keys.append(key[first])
        if len(first):
            sums.append(np.diff(np.append(first, len(key))) if value is None else np.add.reduceat(value, first))
        at = end
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    rows = key // y.width
    starts = np.searchsorted(rows, np.arange(len(x.starts)))
    return Csr(starts, key - rows * y.width, y.width, np.concatenate(sums) if sums else np.zeros(0, np.int64))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def compressed(x: Csr) -> Csr:
    """Equal columns of a row summed."""
    return product(x, Csr(np.arange(x.width + 1), np.arange(x.width), x.width))


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Csr:
    """A.B^T of tokens that cut the same bytes: shared bytes of each overlapping pair."""
    n = int(a_sizes.sum())
    a = Csr(starts_of(a_sizes), np.arange(n), n)
    b_transposed = Csr(np.arange(n + 1), np.repeat(np.arange(len(b_sizes)), b_sizes), len(b_sizes))
    return product(a, b_transposed)


def groups_of(links: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A token and of each B token, from their overlap links."""
    rows, columns = np.repeat(np.arange(len(links.starts) - 1), np.diff(links.starts)), links.columns
    ends = (rows[1:] != rows[:-1]) & (columns[1:] != columns[:-1])
    group = starts_of(ends)[:len(rows)] if len(rows) else np.zeros(0, np.int64)
    of_b = np.zeros(links.width, np.int64)
    of_b[columns] = group
    return group[links.starts[:-1]], of_b


def id_links(text_of_group: np.ndarray, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, linked occurrences): (text, A id) x group times group x B id."""
    n_groups = len(text_of_group)
    row_key, row = np.unique(text_of_group[a_group] * SIDE + a, return_inverse=True)
    order = np.argsort(row, kind="stable")
    left = Csr(starts_of(np.bincount(row, minlength=len(row_key))), a_group[order], n_groups)
    right = Csr(starts_of(np.bincount(b_group, minlength=n_groups)), b, SIDE)
    entries = (np.bincount(a_group, minlength=n_groups) * np.diff(right.starts)).sum()
    if entries > 4 * (len(a) + len(b)):  # long groups that repeat few ids
        left, right = compressed(left), compressed(right)
    links = product(left, right)
    key = np.repeat(row_key, np.diff(links.starts))
    return key // SIDE, key % SIDE * SIDE + links.columns, links.values


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(tokenizer: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, split by `PATTERN`, whose ids are the order of its merges."""
    model, split = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    joined = [model["vocab"].get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in model.get("merges", [])]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split_so = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return plain and split_so and tokenizer["normalizer"] is None and joined == sorted(joined) and joined[:1] >= [256]


class Pair:
    """Both encoders, and bytes, sizes and decimal texts of their ids."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letter, said = byte_letters(), json.loads(a_json)
        self.a_bytes: dict[int, bytes] = {}
        for token, i in said["model"]["vocab"].items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.quick = None
        if ranked(said):
            self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_size, self.b_size = (np.array([len(known.get(i, b"")) for i in range(max(known) + 1)]) for known in (self.a_bytes, self.b_bytes))
        # by twice the id, and one more where the group goes on
        self.a_text, self.b_text = ([f"{i // 2}{',' if i % 2 else end}" for i in range(2 * len(size))] for size, end in ((self.a_size, "|"), (self.b_size, ";")))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A. Texts of `PLAIN` characters, whose classes no version of Unicode moves, take the quicker of two
        encoders with the same ids."""
        out = [self.quick.encode_ordinary(t) if self.quick and PLAIN.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a side does not give the text's bytes back."""
        wanted = [f" {t}" for t in texts]
        out = []
        for text, raw, ids, y in zip(texts, wanted, self.encode_a(wanted), self.b.encode(texts, num_threads=1)):
            raw = raw.encode()
            whole = text and all(b"".join(map(known.__getitem__, i)) == raw for known, i in ((self.a_bytes, ids), (self.b_bytes, y)))
            out.append((ids, y) if whole else ([], []))
        return out

    def align(self, texts: list[str]) -> list[pa.Array]:
        """The columns of `FIGURES` for each text."""
        ids = self.encode(texts)
        n_a, n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[side] for x in ids), np.int64, n.sum()) for side, n in ((0, n_a), (1, n_b)))
        a_group, b_group = groups_of(overlaps(self.a_size[a], self.b_size[b]))
        n = int(a_group[-1]) + 1 if len(a) else 0
        text_of_group = np.zeros(n, np.int64)
        text_of_group[a_group] = np.repeat(np.arange(len(ids)), n_a)
        in_a, in_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        n_groups = np.bincount(text_of_group, minlength=len(ids))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, text_of_group, in_a * in_b)
        text, pair, times = id_links(text_of_group, a, a_group, b, b_group)
        offsets = pa.array(np.searchsorted(text, np.arange(len(ids) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (pair, times)]
        return [*(pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, links)), self.digests(a, a_group, n_a, b, b_group, n_b), *lists]

    def digests(self, a: np.ndarray, a_group: np.ndarray, n_a: np.ndarray, b: np.ndarray, b_group: np.ndarray, n_b: np.ndarray) -> pa.Array:
        """SHA-256 of the text of each text's groups, `a1,a2|b1;a3|b2`: ids of A and B in turn."""
        joined, size = np.zeros(len(a) + len(b), np.int64), len(self.a_text)
        more_a, more_b = (np.append(g[1:] == g[:-1], False)[:len(g)] for g in (a_group, b_group))
        joined[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = 2 * a + more_a
        joined[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * b + more_b + size
        words, known, out, at = joined.tolist(), self.a_text + self.b_text, [], 0
        for n in (n_a + n_b).tolist():
            said = "".join(map(known.__getitem__, words[at:at + n]))
            out.append(hashlib.sha256(said[:-1].encode()).hexdigest() if n else "")
            at += n
        return pa.array(out, pa.string())


@functools.lru_cache(maxsize=1)
def _pair(a_json: str, b_model: str) -> Pair:
    return Pair(base64.b64decode(a_json), base64.b64decode(b_model))


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`docs` without the text and with the columns of `FIGURES`: tokens, groups and links of a text, the digest of
    its groups, and its distinct id pairs (A id x `SIDE` + B id) with their linked occurrences.

    Null and empty texts, and those whose bytes a side does not give back, have no tokens. Columns with the names of
    the new ones are replaced; a row for each row. The vocabulary files are read once by the driver, and their bytes
    (some 3 MB, whatever the input) are broadcast. Memory of a task follows its longest text and its id pairs."""
    kept = [c for c in docs.columns if c.lower() not in {*FIGURES, "text"}]
    slim = docs.select(*kept, "text")
    files = docs.sparkSession.sparkContext.broadcast(tuple(base64.b64encode(Path(p).read_bytes()).decode() for p in (a_path, b_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= CHUNK:
                    size += len(texts[end])
                    end += 1
                columns = [batch.column(i).slice(at, end - at) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *pair.align(texts[at:end])], names=[*kept, *FIGURES])
                at = end

    schema = T.StructType([*slim.select(*kept).schema.fields, *(T.StructField(c, t) for c, t in FIGURES.items())])
    return slim.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold an id pair, and whether no pair of its A id is held by more."""
    counts = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    highest = counts.groupBy(F.floor(F.col("pair") / SIDE).alias("a")).agg(F.max("n").alias("most"))
    both = counts.withColumn("a", F.floor(F.col("pair") / SIDE)).join(highest, "a")
    return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` without the text and with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    n_best counts the links whose id pair no pair of the same A id exceeds in texts, count_sum sums the links'
    counts of texts. Repeated rows are texts of their own. Otherwise as `links`."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "links")
    keyed = links(docs, a_path, b_path).withColumn("__row", F.monotonically_increasing_id())
    keyed.write.option("compression", "zstd").parquet(path)  # written once, so row numbers stay
    stored = spark.read.schema(keyed.schema).parquet(path)
    pairs = stored.select("__row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counted = pair_counts(pairs)
    at = scratch(spark, "pair-counts")
    counted.write.parquet(at)
    counts = spark.read.schema(counted.schema).parquet(at)
    small = counts.count() <= broadcast_rows
    sums = pairs.join(F.broadcast(counts) if small else counts, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    kept = [c for c in stored.columns if c not in {"__row", "pairs", "times", "groups_sha256"} and c not in ("n_best", "count_sum")]
    return stored.select(*kept, "groups_sha256", "__row").join(sums, "__row", "left").select(
        *kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

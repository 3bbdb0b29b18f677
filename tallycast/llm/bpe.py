"""Byte-level BPE as a monoid over byte strings: encodings of two neighbours are joined without redoing them whole.

Encoding. Each match of the pre-token pattern is encoded by itself. A pre-token is halved until a half has at most
`LEAF` bytes, leaves are merged directly by rank, and two neighbours A, B are joined: the bytes of a window, at
first the last token of A and the first of B, are encoded anew. An encoding is the right one exactly if every two
adjacent tokens, encoded together, give themselves again. Inside A, B and the window this holds already, so only
the two seams of the window are tested. Where the left seam fails, the window doubles to the left; where the right
one fails, it grows by the next token of B, and what the left seam has proved stable leaves it. So a window stays
short where a shift runs through all of B, as in long runs of one character, and a join is linear in what changes.
A pre-token that is a token as a whole is that token.

Decoding concatenates the bytes of ids in a balanced tree.

The rank file has at most some hundred thousand lines whatever the input, so it is broadcast. Memory of a task: one
Arrow batch of texts and a cache of `CACHE` distinct pre-tokens.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.llm.common import add_columns

LEAF = 16
#: Bytes up to which a scan for the lowest rank is quicker than a heap.
SHORT = 256
CACHE = 300_000
#: Ids that one leaf of the decoding tree concatenates.
DECODE_LEAF = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def white_space(pattern: str) -> str:
    """The pattern with white space as Unicode's property has it (without the separators \\x1c to \\x1f)."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.limit = ranks, cache
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(white_space(pattern)).findall
        self.cached: dict[str, tuple[int, ...]] = {}
        self.met: dict[tuple[bytes, bytes], tuple[bytes, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a byte string: the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if len(data) > SHORT:
            return self.merge_long(data)
        ranks, none = self.ranks, 1 << 40
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return parts

    def merge_long(self, data: bytes) -> list[bytes]:
        """The same by a heap of pairs over linked parts, in n log n."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none does
        before = list(range(-1, n - 1))  # start of the part before
        heap = [(ranks[data[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if data[i:i + 2] in ranks]
        heapify(heap)
        while heap:
            _, i, middle, stop = heappop(heap)
            if end[i] != middle or end[middle] != stop:
                continue  # one of the parts has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                rank = ranks.get(data[i:end[stop]])
                if rank is not None:
                    heappush(heap, (rank, i, stop, end[stop]))
            if i:
                rank = ranks.get(data[before[i]:stop])
                if rank is not None:
                    heappush(heap, (rank, before[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(data[i:end[i]])
            i = end[i]
        return out

    def together(self, left: bytes, right: bytes) -> tuple[bytes, ...]:
        """Tokens of two neighbouring strings; they are the strings themselves where the seam is stable."""
        key = (left, right)
        found = self.met.get(key)
        if found is None:
            found = tuple(self.merge(left + right))
            if len(left) + len(right) <= SHORT:
                if len(self.met) >= self.limit // 4:
                    self.met.clear()
                self.met[key] = found
        return found

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """Both encodings as one; `a` is extended in place."""
        for j, token in enumerate(b):
            if a and (window := self.together(a[-1], token)) != (a[-1], token):
                a.pop()
                reach = 1
                while a and self.together(a[-1], window[0]) != (a[-1], window[0]):
                    window = self.together(b"".join(a[-reach:]), b"".join(window))
                    del a[-reach:]
                    reach *= 2
                a.extend(window)
            else:
                a.extend(b[j:])
                break
        return a

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return list(self.together(data, b""))
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return tuple(self.ranks[t] for t in (self.merge(data) if len(data) <= LEAF else self.tree(data)))

    def encode(self, text: str) -> np.ndarray:
        cached, found = self.cached, []
        for piece in self.split(text):
            ids = cached.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(cached) >= self.limit:
                        cached.clear()
                    cached[piece] = ids
            found.append(ids)
        return np.fromiter(chain.from_iterable(found), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.bytes_of.__getitem__
        level = [b"".join(map(token, ids[i:i + DECODE_LEAF].tolist())) for i in range(0, len(ids), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


#: The encoder of this Python process, kept from task to task with its cache.
ENCODERS: dict[tuple[int, str], ByteBpe] = {}
#: Rows of an Arrow batch that are answered at once.
ROWS = 256


def encoder(key: int, ranks: Broadcast, pattern: str) -> ByteBpe:
    if (key, pattern) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key, pattern] = ByteBpe(ranks.value, pattern)
    return ENCODERS[key, pattern]


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in [n.lower() for n in names]])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """`df` without the text and with the ids of the whole text as `ids` (array of int; a null or empty text gives
    an empty array); with `decoded`, also the bytes decoded from these ids, in the same pass. Other columns pass
    through; one named like a new column is replaced. One row out for each row in, so repeated rows stay and an
    empty table stays empty."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = hash((ranks_path, len(ranks.value)))

    def start():
        bpe = encoder(key, ranks, pattern)

        def made(texts: list[str | None]) -> list[pa.Array]:
            found = [bpe.encode(x or "") for x in texts]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            return [lists, *([pa.array([bpe.decode(x) for x in found], pa.binary())] if decoded else [])]

        return made

    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return add_columns(without(df, ids, decoded or ids), text, start, new, rows=ROWS)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes of its ids as `decoded` (binary); null ids give no bytes. An id outside the vocabulary is
    an error, since nothing can stand for it."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = hash((ranks_path, len(ranks.value)))

    def start():
        bpe = encoder(key, ranks, "")
        return lambda found: [pa.array([bpe.decode(np.array(x or [], np.int32)) for x in found], pa.binary())]

    return add_columns(without(df, decoded), ids, start, [T.StructField(decoded, T.BinaryType())], rows=ROWS, keep=True)


def joined_digest(ids: str) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids as text, digest of the decoded bytes; a row for each document."""
    tokens = encode(docs.select("doc_id", "text"), ranks_path, pattern, decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        joined_digest("token_ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Token counts under a unigram model, computed once for each shared prefix of the pre-tokens.

A pre-token's best cut is the one whose tokens have the highest product of probabilities; it is found by forward
scores over its bytes: best(i) = max over tokens that end at i of best(start) + score. The score at i depends on the
first i bytes only, so the distinct pre-tokens of a task are inserted in a trie, a node holds the best score and the
count of its prefix, and only new nodes are computed. The node at a pre-token's end gives its count; a document's
count is the sum over its pre-tokens.

The vocabulary's ranks give the probabilities by a fixed rule (no fitting): p proportional to 1 / (rank + OFFSET).
Scores are whole millionths, so that sums are exact and ties are ties; of equal scores the fewest tokens count.
A trie holds at most about `NODES` nodes, then a new one begins; results do not depend on that.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallycast.llm.bpe import load_ranks, white_space, without
from tallycast.llm.common import add_columns

OFFSET, NODES = 3, 600_000


def scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    total = math.log(sum(1 / (r + OFFSET) for r in ranks.values()))
    return {token: round(-1e6 * (math.log(r + OFFSET) + total)) for token, r in ranks.items()}


class Trie:
    def __init__(self, score: dict[bytes, int]):
        self.score = score
        self.longest: dict[bytes, int] = {}  # of the tokens with these last two bytes
        for token in score:
            self.longest[token[-2:]] = max(self.longest.get(token[-2:], 1), len(token))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0], [0]
        self.terminal: dict[str, int] = {}

    def _node(self, data: bytes, i: int, path: list[int]) -> int:
        """A node for the first i bytes of data, whose shorter prefixes are at `path`."""
        best, fewest, get = None, 0, self.score.get
        for start in range(i - 1, max(0, i - self.longest.get(data[max(0, i - 2):i], 1)) - 1, -1):
            s = get(data[start:i])
            if s is not None:
                at = path[start]
                s += self.best[at]
                n = self.count[at] + 1
                if best is None or s > best or s == best and n < fewest:
                    best, fewest = s, n
        self.best.append(best)
        self.count.append(fewest)
        return len(self.best) - 1

    def insert(self, piece: str) -> int:
        """The number of tokens of a pre-token."""
        data, path, node, child = piece.encode(), [0], 0, self.child
        for i, byte in enumerate(data, 1):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = self._node(data, i, path)
            path.append(node)
        self.terminal[piece] = self.count[node]
        return self.count[node]

    def total(self, pieces: list[str]) -> int:
        if len(self.best) > NODES:
            self.clear()
        known, n = self.terminal, 0
        for piece in pieces:
            found = known.get(piece)
            n += self.insert(piece) if found is None else found
        return n


def count(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` without the text and with n_tokens and n_pretokens (long) of the whole text; null and empty texts have
    none. Every byte must be a token, so that any text can be cut. Columns named like the new ones are replaced; a
    row for each row."""
    known = load_ranks(ranks_path)
    if any(bytes([b]) not in known for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    shared = docs.sparkSession.sparkContext.broadcast(scores(known))

    def start():
        trie, split = Trie(shared.value), regex.compile(white_space(pattern)).findall

        def made(texts: list[str | None]) -> list[pa.Array]:
            counted = [(trie.total(p), len(p)) for p in (split(x or "") for x in texts)]
            return [pa.array([n for n, _ in counted], pa.int64()), pa.array([n for _, n in counted], pa.int64())]

        return made

    new = [T.StructField(name, T.LongType()) for name in ("n_tokens", "n_pretokens")]
    return add_columns(without(docs, "n_tokens", "n_pretokens"), text, start, new)

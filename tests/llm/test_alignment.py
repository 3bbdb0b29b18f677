from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tallycast.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(A, "rb").read(), open(B, "rb").read())


def token_bytes():
    """Both encoders and the bytes of their ids, by the public rule of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in shown]
    letter.update({chr(256 + i): b for i, b in enumerate(rest)})
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items() if i < 50256}
    of_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, of_a, of_b


def brute(rows):
    a, b, of_a, of_b = token_bytes()
    found = []
    for _, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(of_a[i] for i in x) == raw == b"".join(of_b[i] for i in y):
                ends = [np.cumsum([len(of[i]) for i in ids]) for of, ids in ((of_a, x), (of_b, y))]
                at = [0, 0]
                for end in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
                    to = [int(np.searchsorted(e, end)) + 1 for e in ends]
                    groups.append((x[at[0]:to[0]], y[at[1]:to[1]]))
                    at = to
        found.append(groups)
    held = [Counter() for _ in rows]
    for c, groups in zip(held, found):
        for g, h in groups:
            for (i, m), (j, k) in ((p, q) for p in Counter(g).items() for q in Counter(h).items()):
                c[i, j] += m * k
    n = Counter(p for c in held for p in c)
    best = Counter()
    for (i, _), m in n.items():
        best[i] = max(best[i], m)
    out = []
    for (doc_id, _), groups, c in zip(rows, found, held):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(c.values()),
                    sum(m for p, m in c.items() if n[p] == best[p[0]]), sum(m * n[p] for p, m in c.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["The quick brown fox, jumps over the lazy dog.", "", None, " two  spaces\n\nand\ttabs ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b is not given back", "=" * 5001, "ab" * 3000,
         "naïve café – Größe 中文字符混在 English 里 🎉🎉", "\u0000nul", "x", " ", "é combining ẛ̣", "The quick brown fox, jumps over the lazy dog.", "1234567890 " * 300]


def made_up():
    rng = random.Random(3)
    return [(i, "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(32, 126), rng.randint(0xA1, 0x2FF), rng.randint(0x4E00, 0x4EFF)])) for _ in range(rng.randint(1, 400)))) for i in range(100, 130)]


@pytest.mark.parametrize("broadcast_rows", [alignment.BROADCAST_ROWS, 0])
def test_equals_brute_force_by_both_joins(spark, broadcast_rows):
    rows = [*enumerate(TEXTS), (None, "null id"), (2**60 + 1, "long id beside a null one"), (3, TEXTS[3]), *made_up()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(docs, A, B, broadcast_rows).select(COLUMNS).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "mine", 7)], "doc_id long, text string, pairs string, N_A int")
    out = alignment.align(docs, A, B)
    assert sorted(c.lower() for c in out.columns) == sorted(COLUMNS) and out.first()["n_a"] > 0
    assert alignment.align(docs.where(F.lit(False)), A, B).count() == 0


def test_chunks_do_not_matter(pair, monkeypatch):
    whole = [c.to_pylist() for c in pair.align([t or "" for t in TEXTS])]
    monkeypatch.setattr(alignment, "SPREAD", 64)
    assert [c.to_pylist() for c in pair.align([t or "" for t in TEXTS])] == whole


def test_products_equal_dense_ones():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m, k = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, m)), rng.integers(0, 3, (m, k))
        def csr(d):
            at = np.nonzero(d)
            return alignment.Csr(alignment.starts_of((d > 0).sum(1)), at[1], d.shape[1], d[at])
        p = alignment.product(csr(x), csr(y))
        dense = np.zeros((n, k), np.int64)
        dense[np.repeat(np.arange(n), np.diff(p.starts)), p.columns] = p.values
        assert (dense == x @ y).all()


def test_long_groups_are_not_spread_out(pair):
    """A group of some hundred thousand tokens a side, of few ids: ten billion occurrence pairs."""
    sizes_a, sizes_b = np.full(200_000, 3), np.append(np.append([1], np.full(199_999, 3)), [2])
    a_group, b_group = alignment.groups_of(alignment.overlaps(sizes_a, sizes_b))
    assert a_group.max() == b_group.max() == 0
    text, key, times = alignment.id_links(np.zeros(1, np.int64), np.full(200_000, 5), a_group, np.full(200_001, 6), b_group)
    assert (text.tolist(), key.tolist(), times.tolist()) == ([0], [5 * alignment.SIDE + 6], [200_000 * 200_001])


def test_both_encoders_of_plain_texts_agree(pair):
    rng = random.Random(1)
    letters = [chr(c) for c in (9, 10, *range(32, 127), *range(0xA1, 0x100))]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(5000)]
    assert pair.quick and pair.encode_a(texts) == [x.ids for x in pair.a.encode_batch_fast(texts, add_special_tokens=False)]

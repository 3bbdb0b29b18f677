from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from tallycast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    pools = ["ab", "theaingor", "aeiou  \n\t", "xyz0123456789", "éèüß日本語🙂", "!?.,-#", "'sdrevtm ", "\x1c\x1d\x85\xa0 a"]
    out = ["", " ", "a", "<|endoftext|>", "a" * 5000, "ab" * 3000, "the" * 2000, " " * 3000 + "x", "é" * 999, "\x00\x01" * 50, "don't  I'LL"]
    for _ in range(1500):
        pool = "".join(rng.sample(pools, rng.randint(1, 4)))
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 120))))
    return out


def test_encode_equals_library_and_round_trips(ranks, library):
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN, cache=500)
    for text in texts():
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text[:60]
        assert own.decode(ids) == text.encode()


def test_every_cut_of_a_string_joins_to_the_same_tokens(ranks):
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice("theaingorst0 ") for _ in range(rng.randint(2, 40))).encode()
        whole = own.merge(data)
        assert all(own.join(own.merge(data[:k]), own.merge(data[k:])) == whole for k in range(len(data) + 1))
        assert own.tree(data * 9) == own.merge(data * 9)


def test_heap_and_scan_merge_alike(ranks):
    own, rng = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(300):
        pool = rng.choice(["=", "ab", "the ", "0123456789", "-=", "\u65e5\u672c"])
        data = "".join(rng.choice(pool) for _ in range(rng.randint(1, 80))).encode()[: bpe.SHORT]
        assert own.merge_long(data) == own.merge(data)


@pytest.mark.parametrize("unit", ["=", "-", "_", "0", "a", "ab", "\u200b"])
def test_a_million_repeated_characters(ranks, library, unit):
    own, text = bpe.ByteBpe(ranks, public_tokenizers.PATTERN), unit * (1_000_003 // len(unit))
    begin = time.time()
    ids = own.encode(text)
    assert time.time() - begin < 10 and own.decode(ids) == text.encode()
    part = unit * 50_001
    assert own.encode(part).tolist() == library.encode_ordinary(part)


def test_operator_on_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "the word " * 40, 7), (3, "x" * 20000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.token_ids)) for r in out) == sorted(
        (i or 0, len(library.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_digests_of_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in df.collect():
        ids = library.encode_ordinary(r.text)
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), r.text.encode())]
        want[r.doc_id] = (len(ids), *sha)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got == want

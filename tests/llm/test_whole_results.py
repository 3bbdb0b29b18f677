"""What must not be lost: records inside members, short credentials, ids, rows of one id, and time on very many spans."""

from __future__ import annotations

import random
import time

from test_warc import back, sample

import public_tokenizers

from tallycast.llm import bpe, near_copies, pii, quality, secret_scan, simhash, stages, token_counts, toxicity, warc
from tallycast.llm.common import Taken, labelled_sample

BIG = 2**53 + 1


def test_records_around_a_damaged_one_inside_a_member():
    records = [r for _, _, r in sample(5, 7)]
    joined = bytearray(b"".join(records))
    joined[sum(map(len, records[:3])) - 30] ^= 1
    for chunk in (777, 1 << 20):
        found, gaps = back(warc.member(bytes(joined)), chunk)
        assert [r["record_id"] for r in found] == [warc.urn(i) for i in (0, 1, 3, 4)] and len(gaps) == 1
    packed = bytearray(warc.member(b"".join(records)))
    packed[len(packed) * 5 // 8] ^= 8
    found, gaps = back(bytes(packed) + warc.member(records[0]))
    assert [r["record_id"] for r in found] == [warc.urn(i) for i in (0, 1, 2, 0)] and gaps[-1]["gap"] == "member damaged"
    assert gaps[-1]["start"] + gaps[-1]["length"] == len(packed)


def test_records_without_a_digest_wait_for_the_checksum():
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    whole = warc.member(plain * 3)
    assert len(back(whole)[0]) == 3
    found, gaps = back(whole[:-4] + bytes([whole[-4] ^ 1]) + whole[-3:])
    assert not found and gaps[0]["length"] == len(whole)


def test_damage_at_any_place_of_a_whole_archive_loses_no_byte():
    records = [r for _, _, r in sample(6, 9)]
    whole = warc.member(b"".join(records[:4])) + records[4] + warc.member(records[5])
    rng = random.Random(3)
    for _ in range(150):
        data = bytearray(whole)
        data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        found, gaps = back(bytes(data))
        at = 0
        for row in sorted(found + gaps, key=lambda r: (r["start"], r["length"])):
            assert row["start"] == at
            at += row["length"]
        assert at == len(data) and len({r["record_id"] for r in found}) >= 2


def test_short_credentials_without_digits_meet_the_automata(spark):
    rng = random.Random(2)
    pick = lambda s: rng.choice(s)
    value = lambda: "q" + pick("bcd") + "Z" + pick("xyz") + pick("KLM") + pick("rst") + "J"
    rows = [(i, f"the password = {value()} stands here") for i in range(400)] + [(BIG, f"words {value()} between words"), (None, "only plain words stand here")]
    got = {r.doc_id: r for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[BIG].spans == "format:6:13" and got[None].spans == "" and got[0].n_assign == 1 and len(got) == len(rows)


def test_every_reachable_state_of_an_automaton_is_a_merged_one():
    for seed in range(40):
        rng = random.Random(seed)
        words = ["".join(rng.choice("ab") + rng.choice(["", "c", "dd"]) for _ in range(rng.randint(2, 6))) for _ in range(400)]
        a = secret_scan.Automaton(words)
        assert all(to in a.log for state in a.log for to in a.next[state].values())
        assert all(a.bits(w) <= 0 for w in words)


def test_ids_beside_a_null_stay_as_they_are(spark):
    docs = spark.createDataFrame([(BIG, "mail a@b.org now"), (None, "mail c@d.org now"), (None, None)], "doc_id long, text string").coalesce(1)
    want = [(BIG, "mail <EMAIL> now"), (None, "mail <EMAIL> now"), (None, None)]
    assert [tuple(r) for r in pii.mask(docs).collect()] == want
    assert [(r.doc_id, r.n_email) for r in pii.report(docs).collect()] == [(BIG, 1), (None, 1), (None, 0)]


def test_ids_stay_in_the_other_operators(spark):
    docs = spark.createDataFrame([(BIG, "some words here"), (None, "other words there")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(docs, path, pattern)
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), quality.F.lit(True))
    for out in (tokens, bpe.decode(tokens, path), bpe.digests(docs, path, pattern), token_counts.count(docs, path, pattern), quality.classify(docs, labels),
                toxicity.classify(docs, labels), simhash.fingerprints(docs), near_copies.sets(docs)):
        assert sorted(str(r.doc_id) for r in out.collect()) == [str(BIG), "None"]
    assert {r.doc_id for r in quality.kept(docs, model).collect()} <= {BIG, None}


def test_words_with_a_long_common_head_are_different_features():
    head = "x" * 64
    words = quality.Words()
    assert words.of(head + "a")[0, 0] != words.of(head + "b")[0, 0]
    assert toxicity.units(head + "a")[0] != toxicity.units(head + "b")[0]


def test_repeats_of_a_labelled_id_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)] , "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", quality.F.lit(True), 100).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (2, "", 0)]


def test_overlaps_equal_brute_force_and_many_spans_take_little_time():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
        taken = Taken(spans)
        for start in range(0, 70):
            assert taken.meets(start, start + 4) == any(s < start + 4 and start < e for s, e in spans)
    text = "".join(f"mail a{i}@x.org token=ab{i:06d} call 555-123-4567\n" for i in range(50_000))
    begin = time.time()
    assert len(pii.scan(text)) >= 100_000
    formats = secret_scan.Formats([secret_scan.Automaton([f"ab{i:06d}" for i in range(300)])])
    assert len(secret_scan.parts(text, formats)) >= 50_000
    assert time.time() - begin < 15


def test_rows_of_one_id_with_different_texts_are_different_documents(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(5, long, "en", "a", 1), (5, "an unrelated text of its own with many words", "en", "a", 1), (5, long, "en", "b", 1), (3, long, "en", "c", 1),
            (None, "a text without id that stands alone here", "en", "a", 1), (9, None, "en", "a", 0), (7, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in stages.keep_one_of_each_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, long), (5, rows[1][1]), (None, rows[4][1]), (7, "")], key=str)

from __future__ import annotations

import hashlib
import io
import random

import duckdb

from tallycast.llm import warc


def sample(n=8, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = "".join(rng.choice("abc <p>é\r\n") for _ in range(rng.randint(0, 3000))).encode()
        out.append((i, payload, warc.record(warc.urn(i), f"http://x.example/{i}\r\n é", payload, hashlib.sha256(payload).hexdigest())))
    return out


def back(data, chunk=777):
    rows = list(warc.salvage(io.BytesIO(data), chunk))
    return [r for r in rows if "gap" not in r], [r for r in rows if "gap" in r]


def test_round_trip_packed_plain_and_mixed():
    records = sample()
    for pack in (lambda i, r: warc.member(r), lambda i, r: r, lambda i, r: warc.member(r) if i % 2 else r):
        found, gaps = back(b"".join(pack(i, r) for i, _, r in records))
        assert not gaps and [r["payload"] for r in found] == [p for _, p, _ in records]
        assert [r["record_id"] for r in found] == [warc.urn(i) for i, _, _ in records]
        assert found[0]["target_uri"] == "http://x.example/0\r\n é"
    found, gaps = back(warc.member(b"".join(r for _, _, r in records)))
    assert len(found) == len(records) and not gaps


def test_salvage_accounts_for_every_byte_and_recovers_later_records():
    records = sample(10, 3)
    rng = random.Random(4)
    for packed in (True, False):
        pieces = [warc.member(r) if packed else r for _, _, r in records]
        whole = b"".join(pieces)
        starts = [sum(map(len, pieces[:k])) for k in range(len(pieces) + 1)]
        for _ in range(60):
            data = bytearray(whole)
            place = rng.randrange(len(data))
            hit = next(k for k in range(len(pieces)) if starts[k] <= place < starts[k + 1])
            data[place] ^= 1 << rng.randrange(8)
            found, gaps = back(bytes(data))
            ids = [r["record_id"] for r in found]
            assert [warc.urn(i) for i in range(10) if i != hit] == [x for x in ids if x != warc.urn(hit) and x in {warc.urn(k) for k in range(10)}]
            seen = {(r["start"], r["length"]) for r in found + gaps}
            at = 0
            for start, length in sorted(seen):
                assert start == at
                at += length
            assert at == len(data)


def test_cuts_junk_and_wrong_lengths():
    a, b, c = (r for _, _, r in sample(3, 5))
    found, gaps = back(b"junk" + warc.member(a) + b"\x1f\x8b\x08 no member" + warc.member(b)[:-5] + warc.member(c))
    assert [r["record_id"] for r in found] == [warc.urn(0), warc.urn(2)] and len(gaps) == 3
    found, gaps = back(a + b.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 2) + c)
    assert [r["record_id"] for r in found] == [warc.urn(0), warc.urn(2)] and len(gaps) == 1
    found, gaps = back(warc.member(a) + warc.member(b)[:40])
    assert len(found) == 1 and gaps[0]["length"] == 40
    assert back(b"") == ([], [])


def test_report_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cur = con.execute(warc.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in warc.report(spark.read.parquet(f"{sf}/pages.parquet")).collect())
    assert got == want


def test_revisits_nulls_and_repeats(spark, tmp_path):
    long, short = "é" * 60, "s" * 99
    rows = [(3, "u", long, 1), (1, None, long, 1), (2, "u", long, 1), (4, "u", short, 1), (5, "u", short, 1), (6, "u", None, 1), (7, "u", "", 1), (1, None, long, 1),
            (None, "u", long, 1), (None, "w", "only" * 50, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(df).collect()), key=str)
    assert got == sorted([(1, 120, "response", None), (1, 120, "response", None), (2, 120, "revisit", 1), (3, 120, "revisit", 1), (4, 99, "response", None), (5, 99, "response", None),
                          (6, 0, "response", None), (7, 0, "response", None), (None, 120, "revisit", 1), (None, 200, "response", None)], key=str)
    assert warc.report(df.limit(0)).count() == 0
    damaged = tmp_path / "x.warc.gz"
    damaged.write_bytes(warc.member(sample()[0][2]) + b"junk")
    read = warc.read(spark.createDataFrame([(str(damaged),)], "path string")).collect()
    assert sorted((r.gap, r.length) for r in read if r.gap) == [("no version line", 4)] and len(read) == 2

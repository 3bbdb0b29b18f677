from __future__ import annotations

import hashlib
import io

import pytest
from test_warc import back

from tallycast.llm import warc


def test_long_urls(spark):
    rows = [(1, "http://x.example/" + "a" * 100_000, "one" * 50), (2, "http://x.example/" + "\u6f22" * 100_000, "one" * 50), (3, "u", "two")]
    got = {(r.page_id, r.payload_bytes, r.record_type) for r in warc.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, 150, "response"), (2, 150, "revisit"), (3, 3, "response")}
    one, two = (warc.record(warc.urn(i), url, b"x", hashlib.sha256(b"x").hexdigest()) for i, url, _ in rows[1:])
    for pack in (bytes, warc.member):
        found, gaps = back(pack(one) + pack(two))
        assert [r["target_uri"] for r in found] == [rows[1][1], "u"] and not gaps


def test_a_search_for_the_end_of_a_header_stops_in_damaged_bytes():
    for junk in (b"\x00" * (8 << 20), b"text without it\r\n" * (1 << 19)):
        window = warc.Window(io.BytesIO(b"WARC/1.1\r\n" + junk), 1 << 16)
        with pytest.raises(warc.Damaged):
            warc.parse(window, 0)
        assert len(window.data) <= 1 << 18


def test_report_fails_on_missing_records(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string")
    read = warc.read
    monkeypatch.setattr(warc, "read", lambda files: read(files).where("record_id <> 'urn:x-page:2'"))
    with pytest.raises(ValueError, match="2 records were written and 1 could be read"):
        warc.report(df)

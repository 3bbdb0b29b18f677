"""Web archives: writing records with revisits of equal payloads, and a reader that salvages damaged files.

Writing. Each row becomes one record, compressed as a gzip member of its own. Of equal payloads of at least
`REVISIT_LEAST` bytes the least page is a response; the others are revisit records without the payload, which name
its digest and length and the response they refer to. Tasks write files of about `ROLL` bytes into a folder that
all executors share; the list of files comes from the rows that successful tasks return, so files of lost attempts
are never read.

Reading. A file is read through a window, not as a whole. At each place stands a gzip member or a plain version
line; a record must have a sound header, its whole block, the closing line ends, and a block digest that agrees. If
any check fails, the reader searches for the next member that begins with a version line, or the next plain version
line, goes on there, and logs the bytes between as a gap with the reason. Inside a member of several records the
search goes on in its unpacked stream, and records are given out as they are read, not when the member ends.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import scratch, whole_text, written

REVISIT_LEAST = 100
ROLL, CHUNK = 32 << 20, 1 << 20
SALTS = 16
ROWS = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = 1 << 16
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START, START_BYTES = re.compile(rb"\x1f\x8b\x08|WARC/1\."), 7
RECORD = ("path string, gap string, start long, length long, record_id string, record_type string, target_uri string, refers_to string,"
          " payload_digest string, payload_bytes long, payload binary")


class Damaged(Exception):
    pass


# -- writing


def record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%-._~')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def urn(page: object) -> str:
    return f"urn:x-page:{'' if pd.isna(page) else int(page)}"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest and `refers`: the page that an equal, smaller one already holds.

    Groups of equal payloads are summed up before the shuffle; the few that hold more than one page are repeated
    for `SALTS` parts, so that a payload of very many pages is joined in as many tasks."""
    text = pages.select("page_id", F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    text = text.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    groups = text.where(F.octet_length("html") >= REVISIT_LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = groups.where("n > 1 AND first IS NOT NULL").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(SALTS)).cast("int")
    joined = text.withColumn("salt", salt).join(first, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all `pages` (page_id, url, html; further columns are ignored) in `folder`; returns (path,
    records, bytes) of each file. Null urls are empty, null page ids have an empty name and are never referred to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        n = 0

        def begin():
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
            return name, system.open_output_stream(f"{root}/{name}", compression=None), 0, 0

        name, out, records, size = None, None, 0, 0
        for batch in batches:
            for page, url, html, digest, refers in batch[["page_id", "url", "html", "digest", "refers"]].itertuples(index=False):
                if out is None:
                    name, out, records, size = begin()
                data = member(record(urn(page), url or "", html.encode(), digest, None if pd.isna(refers) else urn(refers)))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]}, dtype=object)
                    out, n = None, n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]}, dtype=object)

    return with_revisits(pages).mapInPandas(run, "path string, records long, bytes long")


# -- reading


class Window:
    """The bytes of a stream from the last place that was given up."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk = stream, chunk
        self.data, self.base, self.ended = b"", 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(self.chunk)
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, at: int) -> None:
        """Gives up everything before `at`."""
        self.data, self.base = self.data[at - self.base:], at

    def have(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end."""
        while len(self.data) < at - self.base + n and self.more():
            pass
        return self.data[at - self.base:at - self.base + n]

    def find(self, at: int) -> int | None:
        """The next place from `at` where a gzip member or a version line may begin. What was searched is given up."""
        while not (found := START.search(self.data, at - self.base)):
            at = max(at, self.base + len(self.data) - START_BYTES + 1)
            self.drop(at)
            if not self.more():
                return None
        return self.base + found.start()


def header_end(window: Window, at: int) -> int:
    """The end of the header at `at`, of any length. Beyond `HEADER` bytes it is sought only as long as what was read
    can be a header (text, a colon in each line), so that damaged bytes are not read to the end of the file."""
    seen, n = 0, HEADER
    while True:
        data = window.have(at, n)
        if (end := data.find(b"\r\n\r\n", max(0, seen - 3))) >= 0:
            return at + end
        if len(data) < n or CONTROL.search(data, seen) or any(b":" not in line for line in data[10:].split(b"\r\n")[:-1]):
            raise Damaged("header without end")
        seen, n = n, 2 * n


def parse(window: Window, at: int) -> tuple[dict, int]:
    """The plain record at `at` and the place after it."""
    if not VERSION.fullmatch(window.have(at, 10)):
        raise Damaged("no version line")
    end = header_end(window, at)
    fields = {}
    for line in window.have(at, end - at).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or not fields.get("warc-type"):
        raise Damaged("no length or type")
    n = int(fields["content-length"])
    tail = window.have(end + 4, n + 4)
    if len(tail) < n + 4:
        raise Damaged("block cut short")
    if tail[n:] != b"\r\n\r\n":
        raise Damaged("block without end")
    block = tail[:n]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    sound = kind == "sha256"
    if sound and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("block digest differs")
    payload, length = block, n
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        length = int(stated[1]) if stated else len(payload)
    named = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] != "revisit":
        length, own = len(payload), hashlib.sha256(payload).hexdigest()
        if len(named) == 64 and named != own:
            raise Damaged("payload digest differs")
        sound |= len(named) == 64
        named = own
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields["warc-type"],
        "target_uri": unquote(fields.get("warc-target-uri", "")), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": named, "payload_bytes": length, "payload": payload, "sound": sound,
    }, end + 4 + n + 4


class Packed:
    """A stream of what one gzip member holds. It ends where the member does, or where it cannot be unpacked further;
    then `broken` says why."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.unpacker, self.broken = window, at, zlib.decompressobj(31), None
        self.given, self.marks = 0, []

    def read(self, n: int) -> bytes:
        out, before = b"", self.at - len(self.unpacker.unconsumed_tail)
        while not out and not self.unpacker.eof and not self.broken:
            packed = self.unpacker.unconsumed_tail
            if not packed:
                packed = self.window.have(self.at, CHUNK)
                self.at += len(packed)
                if not packed:
                    self.broken = "member cut short"
                    break
            out = self._unpack(packed, n)
            self.at -= len(self.unpacker.unused_data)
        self.given += len(out)
        self.marks.append((self.given, before))
        return out

    def _unpack(self, packed: bytes, n: int) -> bytes:
        """The next n bytes at most; as many as there are in front of a damaged place."""
        while n:
            spare = self.unpacker.copy()
            try:
                return self.unpacker.decompress(packed, n)
            except zlib.error:
                self.unpacker, n = spare, n // 2
        self.broken = "member damaged"
        return b""

    def before(self, place: int) -> int:
        """The place in the file up to which packed bytes were used before the piece with the byte in front of
        `place` was read. Places are asked for in order."""
        while self.marks[0][0] < place:
            self.marks.pop(0)
        return self.marks[0][1]


def packed_rows(window: Window, at: int) -> Iterator[dict]:
    """The records and gaps of the gzip member at `at`, in order; the last row, `next`, has the place after it.

    After a failed check the unpacked stream is searched for the next version line. A record is given out as soon as
    another one begins; one without a sound digest of its own, and all after it, wait for the checksum of the member.
    Where a member breaks off, what has a sound digest stays, but for the record at the break. Each row's range is
    that of the packed bytes read since the row before (none, if it stood in the same piece)."""
    packed = Packed(window, at)
    inner, place, begun, waiting = Window(packed), 0, at, []

    def dealt(rows: list[dict], end: int) -> Iterator[dict]:
        nonlocal begun
        for row in rows:
            yield {"start": begun, "length": end - begun} | {k: v for k, v in row.items() if k != "sound"}
            begun = end

    while inner.have(place, 1):
        if all(row["sound"] for row in waiting):
            yield from dealt(waiting, packed.before(place))
            waiting = []
            window.drop(begun)
        try:
            row, place = parse(inner, place)
        except Damaged as e:
            row, place = {"gap": str(e), "sound": True}, next_version(inner, place + 1)
        inner.drop(place)
        waiting.append(row)
    if packed.broken:
        yield from dealt([row for row in waiting[:-1] if row["sound"]], begun)
        yield from skip(window, begun, at, packed.broken)
        return
    yield from dealt(waiting or [{"gap": "empty member"}], packed.at)
    yield {"next": packed.at}


def next_version(inner: Window, at: int) -> int:
    """The next place of a plain version line, or the end."""
    while (found := inner.find(at)) is not None:
        if VERSION.fullmatch(inner.have(found, 10)):
            return found
        at = found + 1
    return inner.base + len(inner.data)


def skip(window: Window, start: int, failed: int, reason: str) -> Iterator[dict]:
    """A gap from `start` to the next place behind `failed` where something readable begins."""
    at = max(start, failed + 1)
    while (found := window.find(at)) is not None and not begins(window, found):
        at = found + 1
    end = window.base + len(window.data) if found is None else found
    yield {"gap": reason, "start": start, "length": end - start}
    yield {"next": end}


def begins(window: Window, at: int) -> bool:
    """Whether a version line, plain or packed, begins at `at`."""
    if window.have(at, 3) == MAGIC:
        try:
            return bool(VERSION.match(zlib.decompressobj(31).decompress(window.have(at, 1024), 16)))
        except zlib.error:
            return False
    return bool(VERSION.fullmatch(window.have(at, 10)))


def plain_row(window: Window, at: int) -> Iterator[dict]:
    """The plain record at `at`, or a gap, and the place after it."""
    try:
        row, end = parse(window, at)
    except Damaged as e:
        yield from skip(window, at, at, str(e))
        return
    yield {"start": at, "length": end - at} | {k: v for k, v in row.items() if k != "sound"}
    yield {"next": end}


def salvage(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Records, and gaps with their reason, of one archive in order."""
    window, at = Window(stream, chunk), 0
    while window.have(at, 1):
        window.drop(at)
        for row in packed_rows(window, at) if window.have(at, 3) == MAGIC else plain_row(window, at):
            if "next" in row:
                at = row["next"]
            else:
                yield row


def read(files: DataFrame) -> DataFrame:
    """All records and gaps of the archives named in `files` (path). Gap rows have `gap` and no record. A file that
    cannot be opened is an error, an empty one has no rows."""
    columns = [c.split()[0] for c in RECORD.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, inside = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(inside, compression=None) as stream:
                    for row in salvage(stream):
                        rows.append({"path": path} | row)
                        if len(rows) == ROWS:
                            yield pd.DataFrame(rows, columns=columns, dtype=object)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.select("path").mapInPandas(run, RECORD)


def report(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back, and describes each page by what was read."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    listed = f"{folder}-files"
    write(pages, folder).write.parquet(listed)
    files = spark.read.schema("path string, records long, bytes long").parquet(listed)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    pages_read = written(read(files).where("gap IS NULL").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")), "pages")
    stored, found = files.agg(F.sum("records")).first()[0] or 0, pages_read.count()
    if found != stored:
        raise ValueError(f"{stored} records were written and {found} could be read")
    return pages_read


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

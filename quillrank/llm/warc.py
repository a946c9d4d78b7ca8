"""WARC archives with a Zstandard dictionary.

Every archive starts with a skippable frame that holds the dictionary; then a warcinfo record and
each page's record are a frame of their own, so a reader can start at any record with the
dictionary alone.  The dictionary of an archive is built from its own records: all of them wait
until the archive is full, and parts at equal distances over all of it are the sample.  Of records
with equal payloads one is a response and the others revisit it.

Records are those of WARC/1.1: a response holds an HTTP status line, headers and the payload, a
revisit the status line and headers alone; both have a date, a target and an id of their own.  The
tables have no fetch date, so ``WARC-Date`` is the time of writing.

Archives go to a folder that the executors share.  A task writes under a new name each time it
is tried, and what it reports names the archives that count; archives of lost tasks are never
read.

Defined results: a null html is an empty payload; empty payloads revisit each other like any
others; rows that repeat a page id are records each, and of those with equal payloads the first is
what it is without the others, and the others revisit; a null or empty url is written as the page's
urn, characters that no URI may hold are percent-encoded; a null page id comes after all others as
response; an empty table gives no archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, table, text_of

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a target URI that stay as they are, beside letters and digits.
URI = "%/:?#[]@!$&'()*+,;=~-._"
#: Bytes of records that an archive holds before compression, of its dictionary's sample, and of the dictionary.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES, SAMPLE_PART = 2 << 20, 8 << 10
DICTIONARY_BYTES = 64 << 10
#: Records below this payload size are always responses.
MIN_REVISIT_BYTES = 0


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, sha1: str) -> str:
    """The id of a page's response; revisits and pages without an id, which nothing refers to, have random ones."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def target(page_id, url: str) -> str:
    return quote(url.strip(), safe=URI) or f"urn:page:{'' if page_id is None else page_id}"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in [*head, ("Content-Length", str(len(block)))]]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def info_bytes(date: str) -> bytes:
    """The warcinfo record that an archive starts with."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return _record(head, b"software: quillrank\r\nformat: WARC File Format 1.1\r\n")


def record_bytes(page_id, url: str, payload: bytes, sha1: str, refers_to, date: str | None = None, profile: str = PROFILE) -> bytes:
    """One page's record: the HTTP head, then the payload unless it is a revisit."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha1) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date or now()),
        ("WARC-Target-URI", target(page_id, url)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", profile)]
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = CRLF.join(http) + CRLF * 2 + (payload if refers_to is None else b"")
    return _record([*head, ("Content-Type", "application/http; msgtype=response")], block)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head of a response's block."""
    return block.partition(CRLF * 2)[2]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name, and the block."""
    head, _, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != CRLF * 2:
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:size]


class Archive:
    """Writes one archive; records wait until it is closed, for the dictionary is built from all of them."""

    def __init__(self, out, date: str | None = None):
        self.out, self.info = out, info_bytes(date or now())
        self.waiting: list[bytes] = []
        self.size = self.written = self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.waiting.append(record)
        self.size += len(record)

    def _sample(self) -> list[bytes]:
        """Parts at equal distances over all records; a long record can't fill the dictionary by itself."""
        parts = [r[i : i + SAMPLE_PART] for r in self.waiting for i in range(0, len(r), SAMPLE_PART)]
        return parts[:: max(1, self.size // SAMPLE_BYTES)]

    def _dictionary(self) -> bytes:
        sample, data = self._sample(), b""
        if len(sample) >= 16:
            try:
                data = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 10)), sample, k=256, d=8).as_bytes()
            except zstandard.ZstdError:  # too little or too uniform: plain content serves as dictionary
                data = b""
        return data or b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> None:
        data = self._dictionary()
        self._write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
        for record in [self.info, *self.waiting]:
            self._write(compressor.compress(record))
        self.waiting = []
        self.out.close()


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive, one at a time: headers and block."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with a dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    held = source.read(1 << 20)
    while held:
        one = reader.decompressobj()
        parts = [one.decompress(held)]
        while not one.eof:
            more = source.read(1 << 20)
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(more))
        held = one.unused_data or source.read(1 << 20)
        yield parse_record(b"".join(parts))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each page's record of an open archive."""
    return ((head, payload_of(block)) for head, block in records(source) if head["WARC-Type"] != "warcinfo")


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    store, root = pafs.FileSystem.from_uri(folder)
    archive = path = None
    done: list[tuple[str, int, int]] = []

    def finish() -> None:
        archive.close()
        done.append((path, archive.records, archive.written))

    for batch in batches:
        ids, urls, payloads, digests, firsts = (batch.column(i) for i in range(5))
        for i in range(batch.num_rows):
            if archive is None:
                path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                archive = Archive(store.open_output_stream(path), date)
            sha1 = base64.b32encode(bytes.fromhex(digests[i].as_py())).decode()
            archive.add(record_bytes(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), sha1, firsts[i].as_py(), date))
            if archive.size > ARCHIVE_BYTES:
                finish()
                archive = None
    if archive is not None:
        finish()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])


def _read_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, _ = pafs.FileSystem.from_uri(folder)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    number = lambda x: int(x) if x else None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for path in batch.column(0):
            rows, size = [], 0
            with store.open_input_stream(path.as_py()) as source:
                for head, block in read_archive(source):
                    response = head["WARC-Type"] == "response"
                    if response and (digest(block) != head["WARC-Payload-Digest"].removeprefix("sha1:") or len(block) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((number(head["X-Page-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(head.get("X-Refers-To-Page")), head["WARC-Target-URI"], block if response else None))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder``; gives (path, records, bytes) of each, written down."""
    html = F.encode("html", "UTF-8")
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), text_of("html").alias("html")).withColumn("sha1", F.sha1(html))
    digests = materialize(src.select("page_id", "sha1", F.octet_length("html").alias("size")), "digests")
    # The smallest page of each payload that is there twice; single payloads stay out of the joins.
    first = digests.where(F.col("size") >= min_revisit).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    back = digests.join(first, "sha1").where("page_id <> first or page_id is null").select("page_id", "sha1", "first").distinct()
    key = F.coalesce("page_id", F.lit(-(2**63))).alias("key")
    rows = src.select("*", key).join(back.select(key, F.col("sha1"), "first"), ["key", "sha1"], "left")
    # A further row of a page with an equal payload revisits the page; null ids have nothing to refer to.
    again = F.row_number().over(Window.partitionBy("key", "sha1").orderBy("key")) > 1
    small = F.octet_length("html") < min_revisit
    rows = rows.withColumn("first", F.coalesce("first", F.when(again & ~small, F.col("page_id")))).select("page_id", "url", html.alias("html"), "sha1", "first")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return materialize(rows.mapInArrow(partial(_write_batches, folder=folder, date=now()), "path string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives that the manifest names; payloads are checked against their digests."""
    tasks = max(1, min(manifest.count(), 10_000))
    paths = manifest.select("path").coalesce(1).repartition(tasks)  # a path for each 16 MB: few rows
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    return paths.mapInArrow(partial(_read_batches, folder=folder), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back, and report each record."""
    folder = new_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).drop("url", "payload")


#: DuckDB's sha1 gives hex; base32 comes from its bits, five at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(5), lambda k: ((strpos('0123456789abcdef', substr(hex, ((5 * i + k) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * i + k) % 4)::INT & 1) << (4 - k)::INT))::INT, 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT DISTINCT hex FROM d), range(32) r(i) GROUP BY hex),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN b USING (hex) JOIN f USING (hex)
"""

"""Archives against what WARC/1.1 asks of every record."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow.fs as pafs

from quillrank.llm import warc
from quillrank.llm.common import new_path

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://x/a b", "<p>x</p>"), (2, "http://x/é?q=1&r=%20#f", "<p>x</p>"), (3, None, ""), (4, " ", None), (5, "http://x/5", "<p>y</p>\r\n\r\nend"),
    (6, "http://x/6", "<p>z</p>"), (6, "http://x/6", "<p>z</p>"), (6, "http://x/6", "<p>other</p>"), (None, "http://x/n", "<p>n</p>"), (None, "http://x/n", "<p>n</p>"),
]


def test_every_record(spark):
    folder = new_path(spark, "warc")
    manifest = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(3), folder)
    store, _ = pafs.FileSystem.from_uri(folder)
    heads = []
    for row in manifest.collect():
        with store.open_input_stream(row.path) as source:
            own = list(warc.records(source))
        assert own[0][0]["WARC-Type"] == "warcinfo" and own[0][0]["Content-Type"] == "application/warc-fields"
        assert all(head["WARC-Type"] != "warcinfo" for head, _ in own[1:]) and row.records == len(own) - 1
        heads += own
    ids = Counter(head["WARC-Record-ID"] for head, _ in heads)
    responses = {head["WARC-Record-ID"] for head, _ in heads if head["WARC-Type"] == "response"}
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    for head, block in heads:
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"]) and len(block) == int(head["Content-Length"])
        if head["WARC-Type"] == "warcinfo":
            continue
        assert re.fullmatch(r"[!-~]+", head["WARC-Target-URI"]) and urlsplit(head["WARC-Target-URI"]).scheme in ("http", "urn")
        assert head["Content-Type"] == "application/http; msgtype=response"
        status, *fields = block.partition(b"\r\n\r\n")[0].split(b"\r\n")
        assert status == b"HTTP/1.1 200 OK" and all(re.fullmatch(rb"[A-Za-z-]+: .+", f) for f in fields)
        payload = warc.payload_of(block)
        if head["WARC-Type"] == "response":
            assert warc.digest(payload) == head["WARC-Payload-Digest"].removeprefix("sha1:") and len(payload) == int(head["X-Payload-Length"])
        else:
            assert payload == b"" and head["WARC-Refers-To"] in responses and head["WARC-Profile"] == warc.PROFILE
    named = [head["WARC-Record-ID"] for head, _ in heads if head["X-Page-ID" if "X-Page-ID" in head else "WARC-Type"]]
    assert len(named) == len(set(named))
    by_page = {head["X-Page-ID"]: head["WARC-Target-URI"] for head, _ in heads if "X-Page-ID" in head}
    assert by_page["1"] == "http://x/a%20b" and by_page["2"] == "http://x/%C3%A9?q=1&r=%20#f" and by_page["3"] == "urn:page:3"
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_archives(manifest, folder).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 3), (5, "response", 0), (6, "response", 0), (6, "response", 0), (6, "revisit", 6)]


def test_sample_covers_the_archive():
    archive = warc.Archive(None)
    for i in range(6000):
        archive.add(b"%06d" % i + b"x" * 1000)
    seen = [int(part[:6]) for part in archive._sample()]
    assert seen[0] < 10 and seen[-1] > 5900 and sum(map(len, archive._sample())) <= 2 * warc.SAMPLE_BYTES

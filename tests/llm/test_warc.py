"""Archives, revisits and their resolution, against definitions and on odd rows."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs

from tessellon.llm import common, warc

SCHEMA = "page_id long, url string, html string, key string, own string"


def brute(pages, least=0):
    """Result rows by definition; of rows equal in page_id and payload any may be the response."""
    out, groups = [], {}
    for page, _, html in pages:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(page)
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, page in enumerate(ids):
            first = k == 0 or len(payload) < least
            out.append((page, len(payload), own, "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=str)


def run(spark, rows, least=0, size=warc.ARCHIVE_BYTES):
    df = spark.createDataFrame([(*r, "k", "o") for r in rows], SCHEMA)
    found = common.stage(warc.write(df, common.new_path(spark, "raw"), archive_bytes=size), "headers")
    kept = warc.deduplicate(found, common.new_path(spark, "kept"), least, archive_bytes=size)
    got = warc.records(kept).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return kept, sorted(map(tuple, got.collect()), key=str)


ODD = [
    (5, "http://a/ b\r\nWARC-Type: request", "same"), (3, None, "same"), (3, "http://a/c", "same"), (3, "http://a/c", "same"), (None, "http://n", "same"), (None, None, None), (9, "u", ""), (8, "u", None),
    (7, "http://x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (10, "http://é/日", "é\x00\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (11, "l", "long text " * 400_000), (12, "l", "long text " * 400_000),
]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_pages(spark, least):
    _, got = run(spark, ODD, least)
    assert got == brute(ODD, least)


def test_empty_table(spark):
    kept, got = run(spark, [])
    assert got == [] and kept.count() == 0


@pytest.mark.parametrize("share", [1 / 4096, 0.2, 1.0])
def test_random_pages_with_a_hot_payload(spark, monkeypatch, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    rng = random.Random(4)
    rows = [(rng.randint(0, 150), f"u{k}", rng.choice(["hot", *map(str, range(40))]) if k % 3 else "hot") for k in range(300)]
    kept, got = run(spark, rows, size=3000)
    assert got == brute(rows)
    assert kept.select("archive").distinct().count() > 4


def test_archives_are_warc_and_headers_are_fresh(spark):
    rows = [(1, "http://a", "body"), (2, "http://b", "body")]
    kept, _ = run(spark, rows)
    records = []
    for r in kept.select("archive").distinct().collect():
        store, path = fs.FileSystem.from_uri(r["archive"])
        data = store.open_input_stream(path, compression=None).read()
        assert data[:2] == b"\x1f\x8b" and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert next(x for x in warc.read_archive(r["archive"])).kind == "warcinfo"
        records += [x for x in warc.read_archive(r["archive"]) if x.kind != "warcinfo"]
        for x in records:  # a member can be read from its place alone
            assert warc.parse(gzip.decompress(data[x.offset : x.offset + x.length])).fields == x.fields or len(records) > 1
    first, again = sorted(records, key=lambda r: r.get("WARC-Page-Id"))
    assert first.kind == "response" and first.http()[1] == b"body"
    assert again.kind == "revisit" and again.http()[1] == b"" and again.get("WARC-Profile") == warc.PROFILE
    assert again.get("warc-refers-to") == first.get("WARC-Record-ID") and again.get("WARC-Refers-To-Target-URI") == "http://a"
    assert again.get("WARC-Payload-Digest") == first.get("WARC-Payload-Digest") and again.declared_bytes() == 4
    raw = warc.urn("page", 0, 1, 1, first.get("WARC-Payload-Digest")[5:])
    assert first.get("WARC-Record-ID") not in (raw, again.get("WARC-Record-ID"))


def test_revisits_that_are_read_meet_their_original(spark):
    """Archives written elsewhere: a revisit before its original, one without an original here, a resource, a metadata record."""
    folder = common.new_path(spark, "foreign")
    out = warc.Archive(folder, "in")
    own, other = warc.digest(b"page"), warc.digest(b"elsewhere")
    head = warc.http_head(4)
    for n, (kind, uri, sha, block, more) in enumerate([
        ("revisit", "http://r", own, head, [("WARC-Refers-To", "<urn:old>")]), ("revisit", "http://s", other, warc.http_head(9), [("WARC-Refers-To", "<urn:far>")]),
        ("response", "http://z", own, head + b"page", []), ("response", "http://y", own, head + b"page", []), ("resource", "http://f", own, b"page", []), ("metadata", "http://m", None, b"a: b", []),
    ]):
        out.put([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{n}>"), ("WARC-Date", f"2020-01-0{n + 1}T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha and f"sha1:{sha}"),
                 ("Content-Type", "text/plain" if kind in ("resource", "metadata") else "application/http; msgtype=response"), *more], block)
    out.close()
    names = spark.createDataFrame([(out.uri,)], "archive string")
    found = common.stage(warc.headers(names, check=True), "headers")
    kept = warc.deduplicate(found, common.new_path(spark, "kept"), order=found["date"])
    got = {r["uri"]: r for r in warc.records(kept).collect()}
    assert {u: r["record_type"] for u, r in got.items()} == {"http://r": "revisit", "http://s": "revisit", "http://z": "response", "http://y": "revisit", "http://f": "resource", "http://m": "metadata"}
    assert got["http://r"]["refers_to_record"] == got["http://y"]["refers_to_record"] == got["http://z"]["record_id"] == warc.fresh("<urn:2>")
    assert got["http://s"]["refers_to_record"] == "<urn:far>"


def test_cut_and_false_archives_are_told():
    data = warc.encoded([("WARC-Type", "response"), ("Content-Type", "text/plain")], b"x" * 5000)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(data[:-9])))
    assert [c[:2] for c in warc.members(io.BytesIO(data * 3))] == [(0, len(data)), (len(data), len(data)), (2 * len(data), len(data))]
    record = warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nX: a\r\n b\r\nWARC-Payload-Digest: sha1:AAAA\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n")
    assert record.fields["X"] == "a b" and record.block == b"abc"
    with pytest.raises(ValueError, match="isn't that of its digest"):
        warc.header_of(record, "a", True)
    with pytest.raises(ValueError, match="isn't a WARC record"):
        warc.parse(b"HTTP/1.1\r\n\r\n")


def test_members_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 97)
    monkeypatch.setattr(warc, "FEED", 13)
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.randint(0, 300)) for _ in range(40)]
    data = b"".join(warc.encoded([("WARC-Type", "resource")], b) for b in bodies)
    assert [warc.parse(c[2]).block for c in warc.members(io.BytesIO(data))] == bodies

"""WARC archives without repeated payloads: revisit resolution (operator 11).

``write`` makes archives of pages: files of gzip members, a record each, that begin with a warcinfo record. ``headers`` lists the
records of archives without their payloads. ``resolve`` shuffles these headers by payload digest, joins every record to the first
one of its digest, the original response, and says which records stay responses and which become revisits. ``rewrite`` copies
the archives record by record: responses keep their payload, revisits lose it, all headers are fresh. ``records`` reads any archives
back and checks payloads against their digests. Payloads never take part in an exchange: headers alone do, and a task copies an
archive in its order.

Archives have names of their own for each attempt at a task, and a staged table names those that count: what a lost or repeated task has left is
never read. A new archive is begun after `archive_bytes`.

Of responses with equal payload digests (SHA-1) the least by `order` (page_id, nulls last) stays a response; ties go by
URL, then by date, then by place in the archives, so of rows equal in all that a result shows one is the response. Records of fewer than
`min_bytes` are all responses. A revisit record that is read is joined likewise; it never becomes an original, and where the archives don't hold its
original it stays as it is. Records of other types are copied as they are.

Null and empty payloads are payloads of 0 bytes. A null page_id is left out of the header and comes back null; a null URL likewise; blanks and control
characters of a URL are percent-encoded. A record is in memory as a whole, as its row is. An empty table gives no archives and no rows. Other
columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

#: Bytes on disk after which a new archive is begun, and bytes that are read or written at a time.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 20
FEED = 1 << 13
#: A digest that holds more than this share of the records is joined by broadcast; there are fewer such digests than 1 / HOT_SHARE.
HOT_SHARE = 1 / 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEADERS = "archive string, offset long, length long, record_type string, record_id string, date string, uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, refers_to_record string"
_COLUMNS = [c.split()[0] for c in HEADERS.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_uri(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def urn(*parts) -> str:
    """A record's name, the same whenever the same record is written again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


# ---------------------------------------------------------------- records


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes
    offset: int = 0
    length: int = 0

    def __post_init__(self):
        self.lower = {k.lower(): v for k, v in self.fields.items()}

    def get(self, name: str) -> str | None:
        return self.lower.get(name.lower())

    @property
    def kind(self) -> str:
        return self.get("WARC-Type") or ""

    def http(self) -> tuple[bytes, bytes]:
        """The block's HTTP head and the payload; a block without a head is payload."""
        if (self.get("Content-Type") or "").startswith("application/http"):
            head, blank, payload = self.block.partition(b"\r\n\r\n")
            return head + blank, payload
        return b"", self.block

    def declared_bytes(self) -> int | None:
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.http()[0])
        return int(found[1]) if found else None


def encoded(fields: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    """A gzip member that holds one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def parse(data: bytes) -> Record:
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/"):
        raise ValueError("this isn't a WARC record")
    fields, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
        else:
            last, _, value = line.partition(":")
            fields[last] = value.strip()
    size = int({k.lower(): v for k, v in fields.items()}["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut off")
    return Record(fields, rest[:size])


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of each gzip member of a stream. What follows a member comes back from the unpacker as a copy, so it is fed a little at a time."""
    at, data, pos = 0, source.read(CHUNK), 0
    while pos < len(data):
        start, unpack, parts = at, zlib.decompressobj(31), []
        while not unpack.eof:
            if pos >= len(data):
                data, pos = source.read(CHUNK), 0
                if not data:
                    raise ValueError("an archive is cut off")
            fed = data[pos : pos + FEED]
            parts.append(unpack.decompress(fed))
            used = len(fed) - len(unpack.unused_data)
            pos, at = pos + used, at + used
        if pos >= len(data):
            data, pos = source.read(CHUNK), 0
        yield start, at - start, b"".join(parts)


def read_archive(uri: str) -> Iterator[Record]:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as source:
        for offset, length, content in members(source):
            record = parse(content)
            record.offset, record.length = offset, length
            yield record


class Archive:
    """Archives that one attempt at a task writes one after another."""

    def __init__(self, folder: str, name: str, most: int = ARCHIVE_BYTES):
        self.folder, self.name, self.most, self.out, self.count = folder, f"{name}-{uuid.uuid4().hex}", most, None, 0

    def _open(self) -> None:
        self.uri = f"{self.folder}/{self.name}-{self.count:05d}.warc.gz"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at, self.count = store.open_output_stream(path, compression=None), 0, self.count + 1
        info = b"software: tessellon\r\nformat: WARC File Format 1.1\r\n"
        self.put([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn("info", self.uri)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info)

    def put(self, fields: Iterable[tuple[str, str | None]], block: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self._open()
        data = encoded(fields, block)
        place = (self.uri, self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[spec.split()[1]]) for c, spec in zip(columns, HEADERS.split(", "), strict=True)], _COLUMNS)


def response_fields(record_id: str, date: str | None, uri: str | None, page: int | None, own_digest: str, block: str = "application/http; msgtype=response") -> list[tuple[str, str | None]]:
    return [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Page-Id", None if page is None else str(page)),
        ("WARC-Payload-Digest", f"sha1:{own_digest}"), ("Content-Type", block),
    ]


# ---------------------------------------------------------------- writing and reading


def write(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a response record for each row; returns the records' headers (lazy: whoever runs it twice writes twice)."""

    def run(batches: Iterator[pa.RecordBatch]):
        out, ordinal, part = Archive(folder, "raw", archive_bytes), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in common.slices(batch, "payload"):
                rows = []
                for page, uri, payload in zip(*(common.pylist(piece, c) for c in ("page", "uri", "payload")), strict=True):
                    payload = payload or b""
                    uri = None if uri is None else safe_uri(uri)
                    own, ordinal = digest(payload), ordinal + 1
                    record_id = urn("page", part, ordinal, page, own)
                    place = out.put(response_fields(record_id, date, uri, page, own), http_head(len(payload)) + payload)
                    rows.append((*place, "response", record_id, date, uri, page, own, len(payload), None, None))
                yield as_batch(rows)
        out.close()

    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(uri_col).cast("string").alias("uri"), common.as_bytes(payload_col).alias("payload"))
    return source.mapInArrow(run, HEADERS)


def header_of(record: Record, archive: str, check: bool) -> tuple:
    """A record's row; where it has a payload, its length and, if asked for, its digest are taken from that."""
    kind, page, declared = record.kind, record.get("WARC-Page-Id"), record.get("WARC-Payload-Digest")
    name, _, own = (declared or "").rpartition(":")
    own = own if declared and name in ("", "sha1") else None
    size = None
    if kind == "revisit":
        size = record.declared_bytes()
    elif kind in ("response", "resource"):
        payload = record.http()[1]
        size = len(payload)
        if check or own is None:
            found = digest(payload)
            if own not in (None, found):
                raise ValueError(f"{archive} at {record.offset}: the payload isn't that of its digest")
            own = found
    other = record.get("WARC-Refers-To-Page-Id")
    return (
        archive, record.offset, record.length, kind, record.get("WARC-Record-ID"), record.get("WARC-Date"), record.get("WARC-Target-URI"), None if page is None else int(page), own, size,
        None if other is None else int(other), record.get("WARC-Refers-To"),
    )


def headers(archives: DataFrame, check: bool = False) -> DataFrame:
    """Headers of the records, but for warcinfo, of the archives named in column `archive`; with `check`, payloads are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name in common.pylist(batch, "archive"):
                rows = []
                for record in read_archive(name):
                    if record.kind != "warcinfo":
                        rows.append(header_of(record, name, check))
                    if len(rows) >= 2000:
                        yield as_batch(rows)
                        rows = []
                yield as_batch(rows)

    names = archives.select("archive").distinct()
    return names.repartition(common.tasks(archives.sparkSession)).mapInArrow(run, HEADERS)


def records(archives: DataFrame) -> DataFrame:
    """Reads archives back, payloads checked against their digests."""
    return headers(archives, check=True)


# ---------------------------------------------------------------- resolution


def keyed(found: DataFrame, min_bytes: int) -> DataFrame:
    """Headers with `key`: the digest where the record takes part."""
    part = F.col("record_type").isin("response", "revisit") & (F.coalesce(F.col("payload_bytes"), F.lit(min_bytes)) >= min_bytes)
    return found.withColumn("key", F.when(part, F.col("payload_digest")))


def originals(found: DataFrame, min_bytes: int = 0, order: Column | None = None) -> DataFrame:
    """key, n and the original response's `own` of each digest that several records have; records are aggregated before the exchange."""
    order = F.col("page_id") if order is None else order
    rank = F.struct(order.isNull().alias("null"), order.alias("order"), F.coalesce("uri", F.lit("")).alias("u"), F.coalesce("date", F.lit("")).alias("t"), "archive", "offset")
    own = F.struct("record_id", "uri", "date", "page_id", "archive", "offset")
    least = F.min(F.when(F.col("record_type") == "response", F.struct(rank.alias("rank"), own.alias("own"))))["own"]
    return keyed(found, min_bytes).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"), least.alias("own")).where("n > 1 and own is not null")


def resolve(found: DataFrame, several: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers with `becomes` (response, revisit or, for other types, null) and, for revisits, the original's `own`.

    Digests with many records are joined by broadcast (fewer than 1 / HOT_SHARE of them can be, whatever the input); the rest are exchanged."""
    found = keyed(found, min_bytes)
    rows = found.count()
    hot = several.where(F.col("n") > F.lit(rows * HOT_SHARE)).drop("n")
    rest = several.where(F.col("n") <= F.lit(rows * HOT_SHARE)).drop("n")
    met = found.join(F.broadcast(hot.withColumnRenamed("own", "hot")), "key", "left")
    # a hot row's key is left out of the exchange of the others, so it meets nothing there and has no place of its own in it
    spread = F.when(F.col("hot").isNull(), F.col("key"))
    alone = F.concat_ws(":", "archive", "offset")
    met = met.withColumn("to", F.coalesce(spread, alone)).drop("key")
    met = met.join(rest.withColumnsRenamed({"key": "to"}), "to", "left").withColumn("own", F.coalesce("hot", "own")).drop("to", "hot")
    first = (F.col("own.archive") == F.col("archive")) & (F.col("own.offset") == F.col("offset"))
    kind = F.col("record_type")
    becomes = F.when(kind == "revisit", F.lit("revisit")).when(kind == "response", F.when(F.col("own").isNull() | first, F.lit("response")).otherwise(F.lit("revisit")))
    return met.withColumn("becomes", becomes).withColumn("own", F.when(F.col("becomes") == "revisit", F.col("own")))


def fresh(record_id: str) -> str:
    return urn("deduplicated", record_id)


def rewrite(resolved: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes deduplicated archives; returns their headers (lazy: whoever runs it twice writes twice)."""

    def copied(record: Record, becomes: str | None, own: dict | None) -> tuple[list[tuple[str, str | None]], bytes]:
        kept = [(k, v) for k, v in record.fields.items() if k.lower() not in ("content-length", "warc-record-id")]
        record_id = ("WARC-Record-ID", fresh(record.get("WARC-Record-ID") or f"{record.offset}"))
        if becomes != "revisit" or own is None:
            return [*kept[:1], record_id, *kept[1:]], record.block
        head, payload = record.http()
        head = head if record.kind == "revisit" or head else http_head(len(payload))
        gone = ("warc-type", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-refers-to-page-id", "warc-block-digest", "content-type")
        refers = [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", fresh(own["record_id"])), ("WARC-Refers-To-Target-URI", own["uri"]), ("WARC-Refers-To-Date", own["date"]),
            ("WARC-Refers-To-Page-Id", None if own["page_id"] is None else str(own["page_id"])), ("Content-Type", "application/http; msgtype=response"),
        ]
        return [("WARC-Type", "revisit"), record_id, *(f for f in kept if f[0].lower() not in gone), *refers], head

    def run(batches: Iterator[pa.RecordBatch]):
        out, name, source = Archive(folder, "kept", archive_bytes), None, iter(())
        for batch in batches:
            rows = []
            for archive, offset, becomes, own in zip(*(common.pylist(batch, c) for c in ("archive", "offset", "becomes", "own")), strict=True):
                if archive != name:
                    name, source = archive, read_archive(archive)
                record = next(r for r in source if r.offset == offset)
                fields, block = copied(record, becomes, own)
                place = out.put(fields, block)
                written = Record({k: v for k, v in fields if v is not None}, block)
                written.offset, written.length = place[1:]
                rows.append((*place, *header_of(written, place[0], False)[3:]))
            yield as_batch(rows)
        out.close()

    needed = resolved.select("archive", "offset", "becomes", "own")
    dealt = needed.repartition(common.tasks(resolved.sparkSession), "archive").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, HEADERS)


def deduplicate(found: DataFrame, folder: str, min_bytes: int = 0, order: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Resolves the staged headers of archives and writes deduplicated ones; returns the staged headers of these."""
    several = common.stage(originals(found, min_bytes, order), "warc-originals")
    kept = common.stage(rewrite(resolve(found, several, min_bytes), folder, archive_bytes), "warc-kept")
    common.drop_stage(found.sparkSession, several)
    return kept


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, deduplicated and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    raw = common.new_path(spark, "warc-raw")
    found = common.stage(write(pages, raw), "warc-headers")
    kept = deduplicate(found, common.new_path(spark, "warc"))
    common.drop_stage(spark, found)
    common.drop_path(spark, raw)
    return records(kept).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + CAST(5 * i // 4 AS INTEGER), 2) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM q
"""

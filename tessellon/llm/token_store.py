"""Token ids as raw binary shards, with a minimal perfect hash index for keyed access (operator 8).

Files, all in one folder that driver and executors share:

* ``shard-NNNNN.ids``: 16 bytes of header (magic ``TSLI``, item width 2 or 4, eight zero bytes), then the raw ids,
  little-endian, of the documents of one doc_id range in ascending order. Shards are streamed out: the file's length tells the number of ids.
* ``index-NNNNN.mph``: for the keys whose hash falls to this part: a seed for each bucket (the perfect hash), and by slot
  the key's stored 32-bit fingerprint, its shard, its offset in ids and its number of ids.

A look-up hashes the key, reads its bucket's seed and one slot: constant time. A key that isn't in the store meets a foreign
fingerprint and is reported as missing, but for one in 2**32. Repeated doc_ids are told apart by their ordinal
within the id (ties in the order of their ids' bytes); a null doc_id sorts first. Null and empty texts hold the end id alone.
Tasks write under a name of their own and rename, so a repeated task leaves the same file. A task streams its shard, so a very long text is bounded
by the worker's memory alone; an empty table gives a store without documents. Other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

MAGIC = b"TSLI"
HEADER, HEADER_SIZE = "<4sIQ", 16
#: Rows in a shard (more where there would be over common.MOST_RANGES shards) and keys in an index part, which bound what its task holds.
ROWS_PER_SHARD = 20_000
KEYS_PER_PART = 50_000
_MISSING = np.uint64(0xFFFFFFFF)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- encoding


_LETTER, _NUMBER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"


class RunIds(dict):
    """Run of letters or marks, or a digit -> its ids as bytes, from the tokenizer itself on first sight.

    A tokenizer whose own description says that it composes, lower-cases and cuts text into such runs never merges across
    them, so the ids of a text are those of its runs in turn. That holds as it stands for texts of Latin-1 characters, which
    normalisation leaves alone but for case; all other texts, and all texts of other tokenizers, are encoded whole."""

    def __init__(self, path: str, dtype: str, bound: int = 700_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.bound = Tokenizer.from_file(path), dtype, bound
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.plain = re.compile(r"[\t-\r -~\xa1-\xff]*").fullmatch
        self.runs = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+").findall
        self.cuts = self._cuts_runs()

    def _cuts_runs(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(n.get("type"), (n.get("pattern") or {}).get("Regex")) for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return kinds == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", pattern), ("ByteLevel", None)]

    def whole(self, text: str) -> bytes:
        got = array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return (got if sys.byteorder == "little" else np.array(got).astype(self.dtype)).tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        got = self[run] = self.whole(run)
        return got

    def of(self, text: str) -> bytes:
        if self.cuts and "<|" not in text and self.plain(text):  # "<|" may open a special token
            return b"".join(map(self.__getitem__, self.runs(text.lower())))
        return self.whole(text)


@lru_cache(maxsize=1)
def run_ids(path: str, dtype: str) -> RunIds:
    """One for each Python worker, so what a task has learnt serves the next."""
    return RunIds(path, dtype)


common.cache("tokens", run_ids.cache_clear)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col="doc_id", text_col="text", dtype="<u2") -> DataFrame:
    """doc_id and ids (binary) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        common.use_only("tokens")
        known = run_ids(tokenizer_path, dtype)
        end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = [known.of(t or "") + end for t in common.pylist(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary")


# ---------------------------------------------------------------- files


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, chunks) -> None:
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(own, f"{path}/{name}")


class _ShardWriter:
    """Streams one shard: the number of ids, known at the end only, is counted from the file's length on reading."""

    def __init__(self, folder: str, shard: int, width: int):
        self.store, path = _open(folder)
        self.store.create_dir(path, recursive=True)
        self.own, self.name = f"{path}/.shard-{shard:05d}-{uuid.uuid4().hex}", f"{path}/shard-{shard:05d}.ids"
        self.out = self.store.open_output_stream(self.own)
        self.out.write(struct.pack(HEADER, MAGIC, width, 0))
        self.at, self.width = 0, width

    def add(self, ids: bytes) -> tuple[int, int]:
        start, n = self.at, len(ids) // self.width
        self.out.write(ids)
        self.at += n
        return start, n

    def close(self) -> None:
        self.out.close()
        self.store.move(self.own, self.name)


def write_shards(encoded: DataFrame, folder: str, shards: list[int], width: int = 2) -> DataFrame:
    """Writes shards in ascending doc_id order; returns doc_id, ordinal, shard, offset, n of each document (lazy)."""
    dealt = encoded.withColumn("shard", common.range_of(F.col("doc_id"), shards))
    dealt = dealt.repartitionById(len(shards) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]):
        writer, shard, last, ordinal = None, None, (), 0
        for batch in batches:
            rows = []
            for doc, ids, own in zip(*(common.pylist(batch, c) for c in ("doc_id", "ids", "shard")), strict=True):
                if own != shard:
                    if writer:
                        writer.close()
                    writer, shard, last = _ShardWriter(folder, own, width), own, ()
                ordinal = ordinal + 1 if last == (doc,) else 0
                last = (doc,)
                rows.append((doc, ordinal, own, *writer.add(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "ordinal", "shard", "offset", "n"])
        if writer:
            writer.close()

    return dealt.mapInArrow(run, "doc_id long, ordinal int, shard int, offset long, n long")


# ---------------------------------------------------------------- minimal perfect hash


def key_hash(doc_id: int | None, ordinal: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{'null' if doc_id is None else doc_id}#{ordinal}")


def _slot(keys: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (common.mix64(keys ^ common.mix64(np.asarray(seed, np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds by bucket so that each distinct key gets a slot of its own among len(keys). Large buckets are seated first;
    a lone key's seed is its slot itself, stored as -1 - slot."""
    n = len(keys)
    buckets = max(1, (n + 2) // 3)
    own = _slot(keys, 0, buckets)
    seeds = np.zeros(buckets, np.int64)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    free = np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] == 0:
            break
        mine = keys[order[starts[b] : starts[b + 1]]]
        if sizes[b] == 1:
            break
        first, step = 1, 16
        while True:
            tried = np.arange(first, first + step, dtype=np.uint64)
            places = _slot(mine[None, :], tried[:, None], n)
            fits = free[places].all(1)
            at = np.sort(places, 1)
            fits &= (np.diff(at, axis=1) > 0).all(1)
            if fits.any():
                k = int(np.argmax(fits))
                seeds[b] = int(tried[k])
                free[places[k]] = False
                break
            first, step = first + step, min(step * 4, 8192)
    lone = np.flatnonzero(sizes == 1)
    seeds[lone] = -1 - np.flatnonzero(free)[: len(lone)]
    return seeds


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[_slot(keys, 0, len(seeds))]
    return np.where(seed < 0, -1 - seed, _slot(keys, np.maximum(seed, 0).astype(np.uint64), n))


def write_index(entries: DataFrame, folder: str, parts: int) -> DataFrame:
    """One perfect hash for each part of the key space; returns part and n_keys (lazy)."""

    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("part", "key", "shard", "offset", "n")}
        keys = cols["key"].astype(np.int64).view(np.uint64)
        seeds, n = perfect_hash(keys), len(keys)
        at = find_slots(keys, seeds, n)
        table = np.zeros(n, [("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
        table["print"][at] = (common.mix64(keys) >> np.uint64(32)).astype(np.uint32)
        for c in ("shard", "offset", "n"):
            table[c][at] = cols[c]
        part = int(cols["part"][0])
        _put(folder, f"index-{part:05d}.mph", [struct.pack(HEADER, MAGIC, len(seeds), n), seeds.astype("<i8").tobytes(), table.tobytes()])
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([n], pa.int64())})

    return entries.groupBy("part").applyInArrow(run, "part int, n_keys long")


def with_key(entries: DataFrame, parts: int) -> DataFrame:
    """Adds the key's hash and index part to rows with doc_id and ordinal."""

    def run(batches):
        for batch in batches:
            keys = np.array([key_hash(d, o) for d, o in zip(common.pylist(batch, "doc_id"), common.pylist(batch, "ordinal"), strict=True)], np.uint64)
            part = (keys >> np.uint64(33)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64)), pa.array(part.astype(np.int32))], [*batch.schema.names, "key", "part"])

    return entries.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", key long, part int")


@lru_cache(maxsize=4)
def _index(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    store, path = _open(folder)
    with store.open_input_file(f"{path}/index-{part:05d}.mph") as f:
        _, buckets, n = struct.unpack(HEADER, f.read(HEADER_SIZE))
        seeds = np.frombuffer(f.read(8 * buckets), "<i8")
        return seeds, np.frombuffer(f.read(), [("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def lookup(folder: str, parts: int, keys: np.ndarray) -> dict[str, np.ndarray]:
    """shard, offset and n of each key (unsigned 64-bit hashes); shard -1 where the store hasn't the key."""
    out = {"shard": np.full(len(keys), -1, np.int32), "offset": np.zeros(len(keys), np.int64), "n": np.zeros(len(keys), np.int64)}
    part = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        try:
            seeds, slots = _index(folder, int(p))
        except FileNotFoundError:
            continue
        got = slots[find_slots(keys[mine], seeds, len(slots))]
        true = got["print"] == (common.mix64(keys[mine]) >> np.uint64(32)).astype(np.uint32)
        for c in out:
            out[c][mine[true]] = got[c][true]
    return out


def read_ids(folder: str, shard: int, offset: int, n: int) -> np.ndarray:
    """The ids at a place of a shard, read by one seek."""
    store, path = _open(folder)
    with store.open_input_file(f"{path}/shard-{shard:05d}.ids") as f:
        width = struct.unpack(HEADER, f.read(HEADER_SIZE))[1]
        f.seek(HEADER_SIZE + offset * width)
        return np.frombuffer(f.read(n * width), f"<u{width}")


def read_back(keys: DataFrame, folder: str, parts: int, shards: int | None = None) -> DataFrame:
    """For rows with doc_id and ordinal: place by the index, then ids from the shards: their number and crc32."""

    def find(batches):
        for batch in batches:
            got = lookup(folder, parts, batch.column(batch.schema.get_field_index("key")).to_numpy().astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(got[c]) for c in ("shard", "offset", "n"))], ["doc_id", "shard", "offset", "n"])

    def read(batches):
        shard, f, width = None, None, 0
        for batch in batches:
            crc = []
            for own, offset, n in zip(*(common.pylist(batch, c) for c in ("shard", "offset", "n")), strict=True):
                if own != shard:
                    if f:
                        f.close()
                    store, path = _open(folder)
                    f, shard = store.open_input_file(f"{path}/shard-{own:05d}.ids"), own
                    magic, width, _ = struct.unpack(HEADER, f.read(HEADER_SIZE))
                    if magic != MAGIC:
                        raise ValueError(f"{path}/shard-{own:05d}.ids isn't a shard of ids")
                f.seek(HEADER_SIZE + offset * width)
                crc.append(zlib.crc32(np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "ids_crc32"])
        if f:
            f.close()

    placed = with_key(keys, parts).repartition("part").mapInArrow(find, "doc_id long, shard int, offset long, n long")
    placed = placed.repartitionById(shards, F.col("shard")) if shards else placed.repartition("shard")
    placed = placed.sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(read, "doc_id long, shard int, offset long, n long, ids_crc32 long")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col="doc_id", text_col="text", width: int = 2) -> tuple[DataFrame, list[int], int]:
    """Encodes and writes shards and index. Returns the staged entries, ids in the shards before each, and index parts."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    rows = ids.count()
    cuts = common.bounds(ids, "doc_id", -(-rows // ROWS_PER_SHARD))
    parts = max(1, -(-rows // KEYS_PER_PART))
    encoded = encode(docs, tokenizer_path, end_id, id_col, text_col, f"<u{width}")
    entries = common.stage(write_shards(encoded, folder, cuts, width), "token-entries")
    totals = {r["shard"]: r["n"] for r in entries.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += totals.get(k, 0)
    write_index(with_key(entries, parts), folder, parts).agg(F.sum("n_keys")).collect()
    return entries, before, parts


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document and reads them back through the index: doc_id, start, n_tokens, ids_crc32."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = common.new_path(spark, "token-store")
    entries, before, parts = write(docs, folder, public_tokenizer("word_bpe_49k.json"), 2)
    got = read_back(entries.select("doc_id", "ordinal"), folder, parts, len(before))
    base = F.expr(f"element_at(array({','.join(f'{b}L' for b in before)}), shard + 1)")
    return got.select("doc_id", (base + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")

"""Removal of repeated lines by an exact set-similarity join (operator 10).

A line is the set of its words; lines without words are left alone. Lines are in the order of doc_id (null
last), document and line number. A line goes if an earlier line's set has Jaccard similarity THRESHOLD or more with its own,
whether that one stays or goes.

Equal sets are one node, placed at its first line. Sets of fewer than PAIRED words have the similarity with equal sets alone, so
they are in no list. Words are ordered from rare to frequent by a table of 2**20 counters over all
lines (any fixed order gives exact results; ties by the word's hash). Similar sets share a word among their first n - ceil(0.8 n) + 1
(prefix filter), so a node is listed under each of these. A word that more lines than LIGHT and a counter's mean may hold doesn't get a
list of its own: similar sets share two words of the prefix that is one longer, so the node is listed under pairs of such words. Sets of BIG
words or more are few, and are listed under single words.

Within a list two nodes must pass the length filter, the positional filter (the first words they share are the list's, so what follows these in the
shorter remainder bounds the overlap) and a parity filter: tables of 128 to 1,024 bits differ in at most as many places as the sets' words that
aren't shared. Each node then names the PARTNERS nearest earlier nodes of each list, which the sets themselves verify: first the
nearest of all, then, if the node stays, the others. A node that still stays though a list may hold further partners for it is held against the whole of its
lists, until one is verified; only the node is handed on. Few nodes come to that: up to ASKED times BLOCKS of them are sent to all texts, ASKED at a
time; more meet their lists' nodes in an exchange. So a large group of variants costs in proportion to its size, and no similar
pair that could remove a line is passed over. A list longer than MOST is first searched in pieces of that length and among its PIVOTS earliest nodes.

Postings travel as blocks of many rows for one bucket of lists, of about BUCKET rows each; a bucket of more than HELD rows is
searched in pieces, and its nodes count as having further partners. So a task holds a bounded number of rows, whatever a list's length.

Null text has no lines; empty lines stay. Rows equal in doc_id and text count as one document. Columns other than the text
are passed on; a text whose lines all go becomes empty. An empty table gives an empty table. A text is read whole, so a worker's memory must
hold the longest one and the hashes of its words. Columns named __tess_* are the operator's own. docs is read several times: pass a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

THRESHOLD = 0.8
MIN_WORDS = 1
#: Below four words only equal sets have similarity 0.8; four words have it with these and a fifth.
PAIRED = 4
BIG = 512
LIGHT, MOST, PIVOTS = 1024, 4096, 64
PARTNERS = 2
COUNTERS = 1 << 20
_CHUNK = 1 << 12
#: Counts above this are alike, so that a count, an owner and a place fit into one number to sort by.
_MOST_COUNTED = (1 << 24) - 1
#: Sets of fewer words than these have parity tables of 128, 256 and 512 bits; larger ones of 1,024.
SIZES = (192, 384, 768)
_WIDEST = 16
BUCKET, HELD = 100_000, 1_000_000
#: Nodes that are sent to all texts at once, and how many times; beyond that lists are exchanged instead.
ASKED, BLOCKS = 20_000, 4
_SENT = 150_000
_CELLS = 400_000
_SLICE = 500_000
_ONE = np.uint64(1)


def doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def place(id_col: str) -> Column:
    """Null ids come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n) without rounding errors."""
    return -(-4 * n // 5)


def order_of(owner: np.ndarray, value: np.ndarray, bits: int) -> np.ndarray:
    """The stable order by owner (ascending already) and value (of so many bits)."""
    places = max(1, len(owner).bit_length())
    if not len(owner) or int(owner[-1]).bit_length() + places + bits > 64:
        return np.lexsort((value, owner))
    both = owner.astype(np.uint64) << np.uint64(bits + places) | value.astype(np.uint64) << np.uint64(places) | np.arange(len(owner), dtype=np.uint64)
    both.sort()
    return (both & ((_ONE << np.uint64(places)) - _ONE)).astype(np.int64)


def distinct(hashes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each owner in ascending order, their owners (given in ascending order), and their number by owner."""
    bits = min(48, 64 - len(owner).bit_length() - (int(owner[-1]).bit_length() if len(owner) else 0))
    top = hashes >> np.uint64(64 - bits) if bits > 0 else hashes
    order = order_of(owner, top, bits) if bits > 20 else np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    same = (o[1:] == o[:-1]) & (top[order[1:]] == top[order[:-1]])
    if (h[1:][same] != h[:-1][same]).any():  # what was sorted by can't tell two hashes apart
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, bool)
    return h[new], o[new], np.bincount(o[new], minlength=owners)


@dataclass
class Lines:
    """Lines that have words: the row of their text, their number in it, where they lie in clean; the distinct hashes of their words, line by
    line, and how many; their nodes."""

    clean: bytes
    row: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    n: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Lines:
        raw = b"\n".join(t or b"" for t in texts)
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1])
        ends = np.append(starts[1:] - 1, len(raw))
        clean = raw.translate(common._WORD_BYTES)
        hashes, at = common.hash_words(clean)
        line = np.searchsorted(starts, at, "right") - 1
        new = np.diff(line, prepend=-1) != 0
        taken = line[new]
        h, owner, n = distinct(hashes, np.cumsum(new) - 1, len(taken))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(h), dtype=np.uint64)])
            last = np.cumsum(n)
            node = common.mix64(sums[last] - sums[last - n] + n.astype(np.uint64)).view(np.int64)
        row = np.searchsorted(begins, starts[taken], "right") - 1
        return cls(clean, row, taken - np.searchsorted(starts, begins[row]), starts[taken], ends[taken], h, owner, n, node)

    def only(self, keep: np.ndarray) -> Lines:
        """The lines for which keep is true."""
        words = keep[self.owner]
        new = np.cumsum(keep) - 1
        return Lines(self.clean, self.row[keep], self.number[keep], self.starts[keep], self.ends[keep], self.hashes[words], new[self.owner[words]], self.n[keep], self.node[keep])

    def words(self, k: int) -> bytes:
        return self.clean[self.starts[k] : self.ends[k]]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(place(id_col).alias("id"), doc_key(id_col, text_col).alias("dk"), common.as_bytes(text_col).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]):
    """Lines, and the ids and document keys of their texts' rows."""
    common.use_only()
    for batch in batches:
        for part in common.slices(batch, "text", _SLICE):
            yield Lines.of(common.pylist(part, "text")), part.column(0).to_numpy(), part.column(1).to_numpy()


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dk, line and node of every line that has words. Rows with a line below 0 hold a task's counts of words, a piece of the table each."""

    def run(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(COUNTERS, np.int64)
        for got, ids, keys in _parts(batches):
            table += np.bincount((got.hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            cols = [pa.array(ids[got.row]), pa.array(keys[got.row]), pa.array(got.number.astype(np.int32)), pa.array(got.node), pa.nulls(len(got.row), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "dk", "line", "node", "counts"])
        for k, counts in enumerate(table.reshape(-1, _CHUNK)):
            cols = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1 - k], pa.int32()), pa.nulls(1, pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "dk", "line", "node", "counts"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, dk long, line int, node long, counts binary")


def frequencies(found: DataFrame) -> np.ndarray:
    """For each counter, the number of lines' words that fall to it: a table of fixed size (8 MB); found: what lines() gave."""

    def total(rows: Iterator[pa.RecordBatch]):
        chunk, table = None, np.zeros(_CHUNK, np.int64)
        for batch in rows:
            for k, counts in zip(common.pylist(batch, "line"), common.pylist(batch, "counts"), strict=True):
                if chunk not in (None, k):
                    yield _chunk(chunk, table)
                    table = np.zeros(_CHUNK, np.int64)
                chunk = k
                table += np.frombuffer(counts, "<i8")
        if chunk is not None:
            yield _chunk(chunk, table)

    parts = found.where("line < 0").select("line", "counts")
    sums = parts.repartition(common.tasks(found.sparkSession), "line").sortWithinPartitions("line").mapInArrow(total, "line int, counts binary")
    table = np.zeros((COUNTERS // _CHUNK, _CHUNK), np.int64)
    for row in sums.collect():
        table[-1 - row["line"]] += np.frombuffer(row["counts"], "<i8")
    return table.ravel()


def _chunk(k: int, table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table.astype("<i8").tobytes()], pa.binary())], ["line", "counts"])


@dataclass(frozen=True)
class Listing:
    """The order of words, and what has a list."""

    counts: np.ndarray
    light: int

    @classmethod
    def of(cls, table: np.ndarray) -> Listing:
        return cls(np.minimum(table, _MOST_COUNTED).astype(np.int32), min(LIGHT + int(table.mean()), _MOST_COUNTED - 1))

    def keys(self, got: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each list of each line: the line, the list's hash, and the room: the most words that a set can share with this one if the list's are
        the first that they share."""
        n = got.n
        prefix = np.where(n >= PAIRED, n - needed(n) + 1, -1)
        count = self.counts[(got.hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
        order = order_of(got.owner, count, 24)  # ties stay in the order of hashes
        h, count, owner = got.hashes[order], count[order], got.owner
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        before, size = prefix[owner], n[owner]
        single = np.flatnonzero((count <= self.light) & (at < before) & (size < BIG))
        large = np.flatnonzero((at < before) & (size >= needed(np.int64(BIG))))
        heavy = np.flatnonzero((count > self.light) & (at < before + 1) & (before > 0) & (size < BIG))
        where = owner[heavy]
        with np.errstate(over="ignore"):
            owners, keys, rooms = [owner[single], owner[large]], [h[single], common.mix64(h[large] + np.uint64(5))], [size[single] - at[single], size[large] - at[large]]
            for lag in range(1, int(np.bincount(where).max(initial=0)) if len(where) else 0):
                same = np.flatnonzero(where[lag:] == where[:-lag])
                keys.append(common.mix64(h[heavy[same]] * np.uint64(3) + h[heavy[same + lag]]))
                owners.append(where[same])
                rooms.append(size[heavy[same]] - at[heavy[same + lag]] + 1)
        return np.concatenate(owners), np.concatenate(keys), np.concatenate(rooms)


def parity(h: np.ndarray, owner: np.ndarray, owners: int, width: int) -> np.ndarray:
    """For each set, the parity of the number of its hashes that fall to each place of a table of so many bits. Folding a table's halves onto
    each other gives the set's table of half the width."""
    at = owner * width + (h >> np.uint64(64 - 10)).astype(np.int64) % width
    odd = (np.bincount(at, minlength=width * owners) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(owners, width // 64)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(SIZES, n, "right")


def wide_tables(got: Lines) -> np.ndarray:
    """The tables of their own width of the lines that have a wider one than 128 bits, and where each line's is (-1: none)."""
    level = level_of(got.n)
    wide = np.zeros((int((level > 0).sum()), _WIDEST), np.uint64)
    at = np.where(level > 0, np.cumsum(level > 0) - 1, -1)
    for k in range(1, len(SIZES) + 1):
        mine = level == k
        if mine.any():
            words = mine[got.owner]
            wide[at[mine], : 2 << k] = parity(got.hashes[words], (np.cumsum(mine) - 1)[got.owner[words]], int(mine.sum()), 128 << k)
    return wide, at


def first_of_each(node: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Whether a row is its node's first in an order."""
    by = np.lexsort((*order[::-1], node))
    out = np.zeros(len(node), bool)
    if len(node):
        out[by[np.concatenate([[True], node[by[1:]] != node[by[:-1]]])]] = True
    return out


def ranks(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order of lines within a doc_id: 40 bits of the document's key, and the line's number."""
    return keys >> 24 << 24 | np.minimum(number, (1 << 24) - 1)


_FLAT = {"key": "<u8", "node": "<i8", "id": "<i8", "rank": "<i8", "n": "<i4", "room": "<i4"}
_BLOCK = "bucket int, part int, " + ", ".join(f"{c} binary" for c in (*_FLAT, "bits", "wide"))


def postings(docs: DataFrame, id_col: str, text_col: str, listing: Listing, buckets: int, parts: int) -> DataFrame:
    """Blocks of postings: rows for one bucket of lists, laid end to end in each column. key: 48 bits of the list's hash and the set's size (at
    most 65,535). A node that recurs within a slice is listed once, under its first line."""
    shared = docs.sparkSession.sparkContext.broadcast(listing)

    def sent(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = {c: np.concatenate([x[c] for x in held]) for c in (*_FLAT, "bits", "wide")}
        bucket = (rows["key"] >> np.uint64(16)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))
        edges = np.append(begins, len(bucket))
        level = level_of(rows["n"])
        at = np.cumsum(level > 0) - 1
        cols = [pa.array(bucket[begins].astype(np.int32)), pa.array((bucket[begins] % parts).astype(np.int32))]
        for c, kind in _FLAT.items():
            cols.append(_binary(rows[c][order].astype(kind), edges * np.dtype(kind).itemsize))
        cols.append(_binary(rows["bits"][order], edges * 16))
        level = level[order]
        mine = order[level > 0]
        words = np.where(level > 0, 2 << level, 0)
        flat = rows["wide"][at[mine]][np.arange(_WIDEST) < words[level > 0][:, None]]
        cols.append(_binary(flat, np.concatenate([[0], np.cumsum(words)])[edges] * 8))
        return pa.RecordBatch.from_arrays(cols, ["bucket", "part", *_FLAT, "bits", "wide"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, many = [], 0
        for got, ids, keys in _parts(batches):
            rank = ranks(keys[got.row], got.number)
            got_ids = ids[got.row]
            once = first_of_each(got.node, got_ids, rank) & (got.n >= PAIRED)
            got, got_ids, rank = got.only(once), got_ids[once], rank[once]
            owners, key, room = shared.value.keys(got)
            n = got.n[owners]
            key = key >> np.uint64(16) << np.uint64(16) | np.minimum(n, 65535).astype(np.uint64)
            wide, at = wide_tables(got)
            at = at[owners]
            held.append({"key": key, "node": got.node[owners], "id": got_ids[owners], "rank": rank[owners], "n": n, "room": room, "bits": parity(got.hashes, got.owner, len(got.n), 128)[owners], "wide": wide[at[at >= 0]]})
            many += len(key)
            if many >= _SENT:
                yield sent(held)
                held, many = [], 0
        if many:
            yield sent(held)

    return _source(docs, id_col, text_col).mapInArrow(run, _BLOCK)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _read(batch: pa.RecordBatch, a: int, b: int) -> dict[str, np.ndarray]:
    """The rows of a batch's blocks a to b."""

    def flat(name: str, kind: str) -> np.ndarray:
        col = batch.column(batch.schema.get_field_index(name))
        edges = np.frombuffer(col.buffers()[1], np.int32)[col.offset + a : col.offset + b + 1]
        return np.frombuffer(col.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(kind) if edges[-1] > edges[0] else np.empty(0, kind)

    rows = {c: flat(c, kind) for c, kind in _FLAT.items()}
    rows["bits"] = flat("bits", "<u8").reshape(-1, 2)
    level = level_of(rows["n"])
    wide = np.zeros((int((level > 0).sum()), _WIDEST), np.uint64)
    wide[np.arange(_WIDEST) < (2 << level[level > 0])[:, None]] = flat("wide", "<u8")
    return rows | {"wide": wide, "at": np.where(level > 0, np.cumsum(level > 0) - 1, -1)}


def buckets_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """The rows of each bucket (blocks arrive sorted by bucket), and whether there are more than `most`, so that they come in pieces."""
    now, held, many, cut = None, [], 0, False

    def all_of():
        shift = np.cumsum([0, *(len(h["wide"]) for h in held)])
        rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        rows["at"] = np.concatenate([np.where(h["at"] >= 0, h["at"] + s, -1) for h, s in zip(held, shift, strict=False)])
        return rows, cut

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and bucket[a] != now:
                yield all_of()
            if bucket[a] != now:
                now, held, many, cut = bucket[a], [], 0, False
            rows = _read(batch, int(a), int(b))
            if many and many + len(rows["key"]) > most:
                cut = True
                yield all_of()
                held, many = [], 0
            held.append({c: v.copy() for c, v in rows.items()})
            many += len(rows["key"])
    if held:
        yield all_of()


class Gaps:
    """In how many places the parity tables of two rows differ, at the width of the narrower one."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.bits, self.at = rows["bits"], rows["at"]
        self.level, self.folds, wider = level_of(rows["n"]), {}, None
        has = self.at >= 0
        level = np.zeros(len(rows["wide"]), np.int64)
        level[self.at[has]] = self.level[has]
        for k in range(len(SIZES), 0, -1):
            if not has.any():
                break
            half = 2 << k
            fold = np.where((level == k)[:, None], rows["wide"][:, :half], 0).astype(np.uint64)
            if wider is not None:
                more = level > k
                fold[more] = wider[more, :half] ^ wider[more, half:]
            self.folds[k] = wider = fold

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1).astype(np.int64)
        if self.folds:
            level = np.minimum(self.level[i], self.level[j])
            for k, fold in self.folds.items():
                at = np.flatnonzero(level == k)
                if len(at):
                    gap[at] = np.bitwise_count(fold[self.at[i[at]]] ^ fold[self.at[j[at]]]).sum(1)
        return gap


def alike(rows: dict[str, np.ndarray], gaps: Gaps, i: np.ndarray, j: np.ndarray):
    """Those pairs that pass the length, positional and parity filters, and how far their tables are apart. Sets of together s words have the similarity
    if they share 4/9 s or more, and then at most s/9 words are in one of them alone."""
    s = (rows["n"][i] + rows["n"][j]).astype(np.int64)
    ok = np.minimum(rows["room"][i], rows["room"][j]).astype(np.int64) * 9 >= 4 * s
    i, j, s = i[ok], j[ok], s[ok]
    gap = gaps(i, j)
    ok = gap * 9 <= s
    return i[ok], j[ok], gap[ok]


def nearest(rows: dict[str, np.ndarray], cut: bool, most: int, pivots: int = PIVOTS, partners: int = PARTNERS):
    """Of each node and list: the nearest earlier nodes (a, b, gap), and nodes that may have still others in a list (b is -1 there): a row's number
    for a and b."""
    key, node = rows["key"], rows["node"]
    by = np.lexsort((node, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by[1:]] != key[by[:-1]]) | (node[by[1:]] != node[by[:-1]])
    if not new.all():  # of a node's rows in a list, its first line's
        again = np.zeros(len(by), bool)
        again[:-1] = ~new[1:]
        again |= ~new
        mine = by[again]
        by[again] = mine[np.lexsort((rows["rank"][mine], rows["id"][mine], node[mine], key[mine]))]
        by = by[new]
    lists = key[by] >> np.uint64(16)
    begins = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(by) else np.empty(0, np.int64)
    size = np.diff(np.append(begins, len(by)))
    if not cut:
        by = by[np.repeat(size > 1, size)]
        size = size[size > 1]
        begins = np.cumsum(size) - size
    rows = {c: (v if c == "wide" else v[by]) for c, v in rows.items()}
    key, n, count = rows["key"], rows["n"].astype(np.int64), len(by)
    gaps = Gaps(rows)
    first = np.repeat(begins, size)
    long = np.repeat(size > most, size)
    row = np.arange(count)
    least = key >> np.uint64(16) << np.uint64(16) | np.minimum(needed(n), 65535).astype(np.uint64)
    low = np.maximum(np.searchsorted(key, least), np.where(long, first + (row - first) // most * most, 0))
    # by the positional filter the smaller set has at most 9/4 of the larger one's room less its size
    most_n = np.minimum(rows["room"].astype(np.int64) * 9 // 4 - n, n)
    bound = key >> np.uint64(16) << np.uint64(16) | np.maximum(np.minimum(most_n, 65535), 0).astype(np.uint64)
    high = np.where(n >= 65535, row, np.minimum(np.searchsorted(key, bound, "right"), row))
    best, partner, seen = np.full((count, partners), 1 << 20), np.full((count, partners), -1), np.zeros(count, np.int64)

    def offer(later: np.ndarray, earlier: np.ndarray, gap: np.ndarray) -> None:
        order = np.argsort(later << 12 | gap, kind="stable")
        later, earlier, gap = later[order], earlier[order], gap[order]
        begin = np.flatnonzero(np.diff(later, prepend=-1))
        many = np.diff(np.append(begin, len(later)))
        owner = later[begin]
        seen[owner] += many
        for k in range(partners):
            at, own = begin[many > k] + k, owner[many > k]
            worst = best[own].argmax(1)
            ok = (gap[at] < best[own, worst]) & ~(partner[own] == earlier[at][:, None]).any(1)
            best[own[ok], worst[ok]], partner[own[ok], worst[ok]] = gap[at[ok]], earlier[at[ok]]

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        i, j, gap = alike(rows, gaps, i, j)
        ids, rank = rows["id"], rows["rank"]
        up = (ids[j] < ids[i]) | ((ids[j] == ids[i]) & (rank[j] <= rank[i]))
        down = ~up | ((ids[j] == ids[i]) & (rank[j] == rank[i]))
        offer(i[up], j[up], gap[up])
        offer(j[down], i[down], gap[down])

    def pair_ranges(of: np.ndarray, low: np.ndarray, many: np.ndarray, members: np.ndarray) -> None:
        """Row of[k] with members[low[k]], members[low[k] + 1] and so on, `many[k]` of them, in blocks of bounded size."""
        total = np.cumsum(many)
        at = 0
        while at < len(of):
            end = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + _CELLS, "right")))
            c = many[at:end]
            i = np.repeat(of[at:end], c)
            j = members[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:end], c)]
            if len(i):
                pair(i, j)
            at = end

    pair_ranges(row, low, np.maximum(high - low, 0), row)
    for a, m in zip(begins[size > most].tolist(), size[size > most].tolist(), strict=True):
        mine = np.arange(a, a + m)
        early = mine[np.lexsort((rows["rank"][a : a + m], rows["id"][a : a + m]))[:pivots]]
        for p in early.tolist():
            others = mine[(mine - a) // most != (p - a) // most]
            pair(others, np.full(len(others), p))
    more = (seen > partners) | cut | long
    at, slot = np.nonzero((partner >= 0) | (more[:, None] & (np.arange(partners) == 0)))
    return rows, at, partner[at, slot], best[at, slot], more[at]


def named_partners(docs_postings: DataFrame, parts: int, most: int, held: int) -> DataFrame:
    """a: a node; b: one of its nearest likely partners in a list that isn't later (null: none); gap; many: whether the list may hold others; list."""

    def run(batches):
        for rows, cut in buckets_of(batches, held):
            got, a, b, gap, more = nearest(rows, cut, most)
            cols = [pa.array(got["node"][a]), pa.array(got["node"][b], mask=b < 0), pa.array(gap.astype(np.int32)), pa.array(more), pa.array((got["key"][a] >> np.uint64(16)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "gap", "many", "list"])

    dealt = docs_postings.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, gap int, many boolean, list long")


def sets_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, first (its first line's place) and words of these nodes, and of some others that a table of fixed size can't tell from them."""
    table = docs.sparkSession.sparkContext.broadcast(common.bloom(nodes))

    def run(batches):
        for got, ids, keys in _parts(batches):
            mine = np.flatnonzero(common.in_bloom(table.value, got.node))
            row = got.row[mine]
            cols = [pa.array(got.node[mine]), pa.array(ids[row]), pa.array(keys[row]), pa.array(got.number[mine].astype(np.int32)), pa.array([got.words(k) for k in mine.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "id", "dk", "line", "words"])

    rows = _source(docs, id_col, text_col).mapInArrow(run, "node long, id long, dk long, line int, words binary")
    return rows.groupBy("node").agg(F.min(F.struct("id", "dk", "line")).alias("first"), F.first("words").alias("words"))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    shared = len(a & b)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later nodes of the pairs (a, b) whose sets have the similarity."""

    def run(batches):
        for batch in batches:
            ok = [similar(set(a.split()), set(b.split())) for a, b in zip(common.pylist(batch, "words_a"), common.pylist(batch, "words_b"), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["node"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("first").alias(f"at_{x}"), F.col("words").alias(f"words_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    both = both.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("node"), "words_a", "words_b")
    return both.mapInArrow(run, "node long").distinct()


class Asked:
    """Nodes that ask for similar earlier ones: their places, words and postings, by list."""

    def __init__(self, rows: list[tuple[int, tuple[int, int, int], bytes]], listing: Listing):
        rows = sorted(rows)
        got = Lines.of([words for _, _, words in rows])
        self.node, self.n = got.node, got.n
        self.first = np.array([place for _, place, _ in rows], np.int64).reshape(-1, 3)
        self.words = [frozenset(words.split()) for _, _, words in rows]
        self.known = np.zeros(COUNTERS, bool)
        self.known[(got.hashes & np.uint64(COUNTERS - 1)).astype(np.int64)] = True
        self.bits = parity(got.hashes, got.owner, len(got.n), 128)
        owner, key, room = listing.keys(got)
        order = np.argsort(key >> np.uint64(16), kind="stable")
        self.key, self.owner, self.room = (key >> np.uint64(16))[order], owner[order], room[order]

    def met(self, got: Lines, ids: np.ndarray, keys: np.ndarray, listing: Listing, done: np.ndarray) -> list[int]:
        """Nodes not done before that one of the lines precedes and resembles; they are done then."""
        # a line that resembles one of the nodes has that share of its own words from theirs
        familiar = np.bincount(got.owner, self.known[(got.hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], len(got.n))
        got = got.only((familiar >= needed(got.n)) & (got.n >= PAIRED))
        owner, key, room = listing.keys(got)
        low, high = (np.searchsorted(self.key, key >> np.uint64(16), side) for side in ("left", "right"))
        some = np.flatnonzero(high > low)
        if not len(some):
            return []
        mine = np.zeros(len(got.n), bool)
        mine[owner[some]] = True
        few = got.only(mine)
        owner, room, low, many = (np.cumsum(mine) - 1)[owner[some]], room[some], low[some], (high - low)[some]
        bits = parity(few.hashes, few.owner, len(few.n), 128)
        places = np.stack([ids[few.row], keys[few.row], few.number], 1)
        total, at, out = np.cumsum(many), 0, []
        while at < len(owner):
            end = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + _CELLS, "right")))
            c = many[at:end]
            i = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:end], c)
            j, space = np.repeat(owner[at:end], c), np.minimum(np.repeat(room[at:end], c), self.room[i])
            i = self.owner[i]
            size = self.n[i] + few.n[j]
            ok = (space * 9 >= 4 * size) & ~done[i] & (self.node[i] != few.node[j]) & precede(places[j], self.first[i])
            i, j, size = i[ok], j[ok], size[ok]
            gap = np.bitwise_count(self.bits[i] ^ bits[j]).sum(1).astype(np.int64)
            ok = gap * 9 <= size
            i, j = i[ok][order := np.argsort(gap[ok], kind="stable")], j[ok][order]
            for a, b in dict.fromkeys(zip(i.tolist(), j.tolist(), strict=True)):
                if not done[a] and similar(self.words[a], set(few.words(b).split())):
                    done[a] = True
                    out.append(int(self.node[a]))
            at = end
        return out


def precede(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the places (id, dk, line) of a come before those of b."""
    out = a[:, 2] < b[:, 2]
    for k in (1, 0):
        out = (a[:, k] < b[:, k]) | ((a[:, k] == b[:, k]) & out)
    return out


def asked_of_all(docs: DataFrame, id_col: str, text_col: str, listing: Listing, asked: DataFrame) -> DataFrame:
    """Those of few nodes (node, first, words) that have a similar earlier node in their lists: they are sent to all texts."""
    context = docs.sparkSession.sparkContext
    rows = [(r["node"], tuple(r["first"]), bytes(r["words"])) for r in asked.toLocalIterator()]
    shared = context.broadcast((Asked(rows, listing), listing))

    def run(batches):
        asked, listing = shared.value
        done = np.zeros(len(asked.node), bool)
        for got, ids, keys in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(asked.met(got, ids, keys, listing, done), pa.int64())], ["node"])

    return _source(docs, id_col, text_col).mapInArrow(run, "node long").distinct()


_ASKED = "list long, node long, id long, dk long, line int, n int, room int, bits binary, words binary, asks boolean"


def whole_lists(docs: DataFrame, id_col: str, text_col: str, listing: Listing, left: DataFrame, held: int = 5000) -> DataFrame:
    """Those nodes of left (node, list) that have a similar earlier node in their lists. Every list's nodes meet its open ones, `held` of these in a
    task, and an open one is done with its first."""
    spark = docs.sparkSession
    lists = spark.sparkContext.broadcast(common.bloom(left.select(F.col("list").alias("node"))))
    open_ones = spark.sparkContext.broadcast(common.bloom(left.select("node")))
    shared = spark.sparkContext.broadcast(listing)

    def listed(batches):
        for got, ids, keys in _parts(batches):
            got = got.only(first_of_each(got.node, ids[got.row], ranks(keys[got.row], got.number)) & (got.n >= PAIRED))
            owners, key, room = shared.value.keys(got)
            key = (key >> np.uint64(16)).astype(np.int64)
            ok = np.flatnonzero(common.in_bloom(lists.value, key))
            bits = parity(got.hashes, got.owner, len(got.n), 128)
            for a in range(0, len(ok), 4000):
                own = owners[ok[a : a + 4000]]
                row = got.row[own]
                cols = [pa.array(key[ok[a : a + 4000]]), pa.array(got.node[own]), pa.array(ids[row]), pa.array(keys[row]), pa.array(got.number[own].astype(np.int32)), pa.array(got.n[own].astype(np.int32)), pa.array(room[ok[a : a + 4000]].astype(np.int32))]
                cols += [_binary(bits[own], np.arange(len(own) + 1) * 16), pa.array([got.words(k) for k in own.tolist()], pa.binary()), pa.array(common.in_bloom(open_ones.value, got.node[own]))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _ASKED.split(", ")])

    def meet(batches):
        now, asking, done = None, [], np.empty(0, bool)
        for batch in batches:
            chunk, asks = batch.column(batch.schema.get_field_index("chunk")).to_numpy(), batch.column(batch.schema.get_field_index("asks")).to_numpy(zero_copy_only=False)
            rows = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("list", "node", "id", "dk", "line", "n", "room")}
            rows["bits"] = np.frombuffer(b"".join(common.pylist(batch, "bits")), "<u8").reshape(-1, 2)
            rows["words"] = np.array([*common.pylist(batch, "words"), None], object)[:-1]
            new = np.concatenate([[True], (rows["list"][1:] != rows["list"][:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])])
            gone = []
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(new)[1:]):
                if not len(at):
                    continue
                if (rows["list"][at[0]], chunk[at[0]]) != now:
                    now, asking, done = (rows["list"][at[0]], chunk[at[0]]), [], np.empty(0, bool)
                mine = {c: v[at] for c, v in rows.items()}
                if asks[at[0]]:
                    asking.append(mine)
                elif asking:
                    if not len(done):  # all that ask have come; a node asks as its first line
                        every = {c: np.concatenate([x[c] for x in asking]) for c in asking[0]}
                        once = first_of_each(every["node"], every["id"], every["dk"], every["line"])
                        asking, done = [{c: v[once] for c, v in every.items()}], np.zeros(int(once.sum()), bool)
                    gone += first_matches(asking[0], mine, done)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["node"])

    rows = _source(docs, id_col, text_col).mapInArrow(listed, _ASKED)
    chunks = left.groupBy("list").agg(F.ceil(F.count("*") / held).cast("int").alias("chunks"))
    role = lambda chunk, asks: F.struct(chunk.cast("int").alias("chunk"), F.lit(asks).alias("asks"))
    member = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: role(c, False))
    asker = F.when(F.col("asks"), F.array(role(F.pmod(F.xxhash64("node"), F.col("chunks")), True))).otherwise(F.slice(member, 1, 0))
    rows = rows.join(chunks, "list").withColumn("role", F.explode(F.concat(asker, member)))
    rows = rows.drop("asks", "chunks").select("*", "role.chunk", "role.asks").drop("role")
    dealt = rows.repartition(common.tasks(spark), "list", "chunk").sortWithinPartitions("list", "chunk", F.desc("asks"))
    return dealt.mapInArrow(meet, "node long").distinct()


def first_matches(asking: dict[str, np.ndarray], others: dict[str, np.ndarray], done: np.ndarray) -> list[int]:
    """The nodes of asking rows, not done before, that one of the others precedes and resembles; they are done then."""
    out = []
    width = len(others["node"])
    step = max(1, _CELLS // width)
    for a in range(0, len(done), step):
        i, j = np.divmod(np.arange(min(step, len(done) - a) * width), width)
        i += a
        place = lambda rows, k: np.stack([rows["id"][k], rows["dk"][k], rows["line"][k]], 1)
        ok = precede(place(others, j), place(asking, i)) & ~done[i] & (asking["node"][i] != others["node"][j])
        i, j = i[ok], j[ok]
        s = (asking["n"][i] + others["n"][j]).astype(np.int64)
        ok = np.minimum(asking["room"][i], others["room"][j]).astype(np.int64) * 9 >= 4 * s
        i, j, s = i[ok], j[ok], s[ok]
        gap = np.bitwise_count(asking["bits"][i] ^ others["bits"][j]).sum(1).astype(np.int64)
        ok = gap * 9 <= s
        i, j, gap = i[ok], j[ok], gap[ok]
        for k in np.argsort(gap, kind="stable").tolist():
            if not done[i[k]] and similar(set(asking["words"][i[k]].split()), set(others["words"][j[k]].split())):
                done[i[k]] = True
                out.append(int(asking["node"][i[k]]))
    return out


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """dk and the numbers (gone) of the lines that go, by document, staged. Its own steps' tables are deleted."""
    spark = docs.sparkSession
    staged: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        staged.append(common.stage(df, name))
        return staged[-1]

    parts = common.tasks(spark)
    every = stage(lines(docs, id_col, text_col), "lines")
    found = every.where("line >= 0").select("id", "dk", "line", "node")
    table = frequencies(every)
    listing = Listing.of(table)
    # about a quarter of a line's distinct words are in its prefix
    buckets = parts * max(1, -(-int(table.sum()) // (4 * BUCKET * parts)))
    listed = postings(docs, id_col, text_col, listing, buckets, parts)
    partners = stage(named_partners(listed, parts, MOST, HELD), "partners")
    common.reclaim(spark)
    pairs = stage(partners.where("b is not null").groupBy("a", "b").agg(F.min("gap").alias("gap")), "pairs")
    known = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(partners.where("many").select("a"))
    sets = stage(sets_of(known, docs, id_col, text_col), "sets")
    # most lines that go are shown to go by their nearest partner; the others are asked about only where it fails
    best = stage(pairs.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b")), "best")
    gone = stage(verify(best, sets), "gone")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(gone.select(F.col("node").alias("a")), "a", "left_anti")
    gone = stage(gone.union(verify(rest, sets)).distinct(), "gone")
    # nodes that still stay and may have other partners
    left = partners.where("many").select(F.col("a").alias("node"), "list").distinct().join(gone, "node", "left_anti")
    left = stage(left, "left")
    asked = left.select("node").distinct().join(sets, "node")
    blocks = -(-asked.count() // ASKED)
    if blocks > BLOCKS:
        gone = stage(gone.union(whole_lists(docs, id_col, text_col, listing, left)).distinct(), "gone")
    else:
        for k in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k)
            gone = stage(gone.union(asked_of_all(docs, id_col, text_col, listing, block)).distinct(), "gone")
    common.reclaim(spark)
    firsts = found.groupBy("node").agg(F.min(F.struct("id", "dk", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = firsts.join(gone.withColumn("gone", F.lit(True)), "node", "full")
    out = found.join(named, "node").where(F.col("gone").isNotNull() | (F.struct("id", "dk", "line") != F.col("first")))
    lost = common.stage(out.groupBy("dk").agg(F.collect_set("line").alias("gone")).mapInArrow(_flagged, "dk long, gone array<int>, flags array<boolean>"), "gone-lines")
    common.drop_stage(spark, *staged)
    return lost


def _flagged(batches: Iterator[pa.RecordBatch]):
    """The numbers in order, and by number whether the line goes."""
    for batch in batches:
        gone = [sorted(numbers) for numbers in common.pylist(batch, "gone")]
        flags = []
        for numbers in gone:
            own = np.zeros(numbers[-1] + 1, bool)
            own[numbers] = True
            flags.append(own.tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))], ["dk", "gone", "flags"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, with the text's repeated lines taken out, and __tess_gone: the numbers of the lines that went."""
    spark = docs.sparkSession
    lost = repeated_lines(docs, id_col, text_col)
    gone = lost.select(F.col("dk").alias("__tess_dk"), F.col("gone").alias("__tess_gone"), F.col("flags").alias("__tess_flags"))
    common.reclaim(spark)
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x, k: ~F.coalesce(F.get("__tess_flags", k), F.lit(False)))
    marked = docs.withColumn("__tess_dk", doc_key(id_col, text_col)).join(gone.hint("merge"), "__tess_dk", "left").drop("__tess_dk")
    none = F.array().cast("array<int>")
    text = F.when(F.col("__tess_flags").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    out = marked.withColumn(text_col, text).withColumn("__tess_gone", F.coalesce("__tess_gone", none)).select(*(f"`{c}`" for c in docs.columns), "__tess_gone")
    return common.leaving(out, lost)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines went and which, and the cleaned text's digest and length."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = dedup_lines(docs)
    removed = F.size("__tess_gone")
    return got.select("doc_id", removed.cast("long").alias("n_removed"), F.array_join(F.col("__tess_gone").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"))

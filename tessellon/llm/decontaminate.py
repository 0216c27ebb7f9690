"""Benchmark decontamination with suffix arrays of the training text (operator 4).

The training text is cut into shards of a few MB. Each shard's words become numbers (0 for a word that no test item has, and
between documents), and a suffix array is built of those suffixes that can match: their first words must start
a test suffix. Suffixes are ordered by their first 13 words; every test suffix is found by two binary searches, which bound
the block of training places where its window stands. A verbatim match goes on as long as the next place matches the same item's next
suffix, so the longest match, its place and the item's follow from the places; of equally long ones the first in the document counts, then
the least item_id as a string, then the first in the item. The hit words are those within any window.

The test items are read in blocks of bounded size; documents pass each block in turn without a shuffle.
Null and empty texts have no words and match nothing. Repeated item_ids count once; an item without words is skipped. A null
item_id is named by the empty string. Very long documents are a shard of their own. An empty table of documents gives an empty result, one of items
matches nothing; rows that repeat a document are judged alike. Columns named __tess_* are the operator's own; all others are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

WINDOW = 13
#: Bytes of test text that are broadcast at once.
BLOCK_BYTES = 8_000_000


class TestSuffixes:
    """The windows of a block of test items, and the items that hold each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        # suffixes are numbered through all items, with a number left out between two items
        found: dict[tuple[int, ...], list[int]] = {}
        self.names, bases, base = [], [], 0
        for item, text in sorted(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in common.words(text)]
            n = min(window, len(ids))
            self.names.append(item)
            bases.append(base)
            for i in range(len(ids) - n + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + n]), []).append(base + i)
            base += max(0, len(ids) - n + 1) + 1
        self.bases = np.array(bases, np.int64)
        self.windows = sorted(found)
        self.items = [sorted({self.names[k] for k in np.searchsorted(self.bases, found[w], "right") - 1}) for w in self.windows]
        self.suffixes = np.array([g for w in self.windows for g in found[w]], np.int64)
        self.many = np.array([len(found[w]) for w in self.windows], np.int64)
        self.begin = np.cumsum(self.many) - self.many
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        low, high = np.zeros((len(self.windows), window), ">u4"), np.full((len(self.windows), window), 0xFFFFFFFF, ">u4")
        for i, w in enumerate(self.windows):
            low[i, : len(w)] = high[i, : len(w)] = w
        self.low, self.high = _keys(low), _keys(high)
        self.first = np.zeros(len(self.vocabulary) + 2, bool)
        self.first[[w[0] for w in self.windows]] = True
        lone = {w[0] for w in self.windows if len(w) == 1}
        self.alone = np.zeros_like(self.first)
        self.alone[list(lone)] = True
        self.pairs = np.unique(np.array([w[0] << 32 | w[1] for w in self.windows if len(w) > 1], np.int64))


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes in the order of their first words, with those words as keys."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(">u4")
    keys = _keys(np.lib.stride_tricks.sliding_window_view(padded, depth)[starts])
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


def match_shard(test: TestSuffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the shard, and the test window that stands at each."""
    none = np.empty(0, np.int64)
    if not len(test.windows) or not len(ids):
        return none, none
    head = np.flatnonzero(test.first[ids])
    after = np.concatenate([ids, [0]])[head + 1].astype(np.int64)
    pair = ids[head].astype(np.int64) << 32 | after
    keep = test.alone[ids[head]]
    if len(test.pairs):
        at = np.minimum(np.searchsorted(test.pairs, pair), len(test.pairs) - 1)
        keep |= test.pairs[at] == pair
    places, keys = suffix_array(ids, head[keep], test.window)
    lo, hi = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    counts = hi - lo
    hit = np.flatnonzero(counts > 0)
    if not len(hit):
        return none, none
    which = np.repeat(hit, counts[hit])
    first = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(counts[hit])[:-1]]), counts[hit])
    return places[first + np.arange(len(which))], which


def longest(test: TestSuffixes, places: np.ndarray, which: np.ndarray) -> tuple[int, int, str, int]:
    """From, to (exclusive), the item and the place in it of the longest verbatim match, from a document's places and the windows there."""
    rows = np.repeat(np.arange(len(which)), test.many[which])
    suffix = test.suffixes[np.repeat(test.begin[which] - (np.cumsum(test.many[which]) - test.many[which]), test.many[which]) + np.arange(len(rows))]
    at, size = places[rows], test.lengths[which[rows]]
    order = np.lexsort((at, at - suffix))
    at, suffix, size = at[order], suffix[order], size[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(suffix) != 1)]))
    words = np.diff(np.append(begin, len(at))) - 1 + size[begin]
    top = begin[words == words.max()]
    # suffixes are numbered in the order of item_ids
    best = top[np.lexsort((suffix[top], at[top]))[0]]
    item = int(np.searchsorted(test.bases, suffix[best], "right")) - 1
    return int(at[best]), int(at[best] + words.max()), test.names[item], int(suffix[best] - test.bases[item])


_FOUND = {"__tess_n": pa.int64(), "__tess_hits": pa.binary(), "__tess_items": pa.list_(pa.string()), "__tess_from": pa.int64(), "__tess_to": pa.int64(), "__tess_item": pa.string(), "__tess_at": pa.int64()}
_FOUND_DDL = "__tess_n long, __tess_hits binary, __tess_items array<string>, __tess_from long, __tess_to long, __tess_item string, __tess_at long"


def scan(docs: DataFrame, test: TestSuffixes, text_col: str, carried: bool) -> DataFrame:
    """Adds n_words, hits (binary: pairs of word positions [from, to)), items and the longest match to each row; with carried, to those that an
    earlier block found."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(test)
    names = [c for c in docs.columns if not c.startswith("__tess_")] if carried else docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), _FOUND_DDL])

    def run(batches: Iterator[pa.RecordBatch]):
        test = shared.value
        get = test.vocabulary.get
        for batch in batches:
            for part in common.slices(batch, text_col):
                tokens = [common.words(t if t is None or isinstance(t, bytes) else t.encode()) for t in common.pylist(part, text_col)]
                n = np.array([len(t) for t in tokens], np.int64)
                starts = np.concatenate([[0], np.cumsum(n + 1)])
                ids = np.zeros(int(starts[-1]), np.int64)
                for at, t in zip(starts, tokens, strict=False):
                    ids[at : at + len(t)] = np.fromiter((get(w, 0) for w in t), np.int64, len(t))
                places, which = match_shard(test, ids)
                doc = np.searchsorted(starts, places, "right") - 1
                hits, items, best = [b""] * len(tokens), [[]] * len(tokens), [(None, None, None, None)] * len(tokens)
                order = np.lexsort((places, doc))
                doc, places, which = doc[order], places[order], which[order]
                for d in np.unique(doc):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    begin = places[lo:hi] - starts[d]
                    hits[d] = merged(np.stack([begin, begin + test.lengths[which[lo:hi]]], 1)).tobytes()
                    items[d] = sorted({i for w in set(which[lo:hi].tolist()) for i in test.items[w]})
                    best[d] = longest(test, begin, which[lo:hi])
                if carried:
                    old = zip(*(common.pylist(part, c) for c in list(_FOUND)[1:]), strict=True)
                    for d, (spans, had, *match) in enumerate(old):
                        hits[d] = merged(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in (spans, hits[d])])).tobytes()
                        items[d] = sorted({*had, *items[d]})
                        best[d] = min((m for m in (tuple(match), best[d]) if m[0] is not None), key=lambda m: (m[0] - m[1], m[0], m[2], m[3]), default=best[d])
                found = [n, hits, items, *(zip(*best, strict=True) if best else [[]] * 4)]
                cols = [pa.array(list(v) if k != "__tess_n" else v, t) for (k, t), v in zip(_FOUND.items(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *cols], [*names, *_FOUND])

    return docs.mapInArrow(run, schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans with the same union."""
    if not len(spans):
        return spans.astype("<i8").reshape(-1, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], 1).astype("<i8")


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Test items in blocks of bounded size."""
    held, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), common.as_bytes(text_col)).toLocalIterator():
        held.append((item, bytes(text or b"")))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW) -> DataFrame:
    """docs with n_words, hits and items of every block of the benchmark."""
    out, carried = docs, False
    for block in blocks(benchmark, item_col, item_text_col):
        out, carried = scan(out, TestSuffixes(block, window), text_col, carried), True
    return out


def spans_of(hits: bytes) -> np.ndarray:
    return np.frombuffer(hits, "<i8").reshape(-1, 2)


def report(found: DataFrame, id_col: str) -> DataFrame:
    """The matches' figures by document, and the longest verbatim match with its place and its item's."""

    def run(batches):
        for batch in batches:
            n = common.pylist(batch, "__tess_n")
            spans = [spans_of(h) for h in common.pylist(batch, "__tess_hits")]
            items = common.pylist(batch, "__tess_items")
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            best = [batch.column(batch.schema.get_field_index(c)) for c in list(_FOUND)[3:]]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n, strict=True)], pa.bool_()), *best,
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_from", "longest_to", "longest_item", "longest_at"])

    kept = found.select(F.col(id_col).cast("long").alias("doc_id"), *_FOUND)
    return kept.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_from long, longest_to long, longest_item string, longest_at long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """docs without those of which at least a twentieth of the words lies in test windows."""

    def run(batches):
        for batch in batches:
            hit = [int(np.diff(spans_of(h), axis=1).sum()) for h in common.pylist(batch, "__tess_hits")]
            keep = pa.array([not (h > 0 and 20 * h >= n) for h, n in zip(hit, common.pylist(batch, "__tess_n"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[: -len(_FOUND)], batch.schema.names[: -len(_FOUND)]).filter(keep)

    found = matches(docs, benchmark, text_col, item_col, item_text_col)
    return found.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.as_bytes("text").alias("text"))
    return report(matches(docs, common.table(spark, sf_dir, "benchmark")), "doc_id")

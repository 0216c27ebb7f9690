"""Target-distribution importance resampling (operator 12).

Features of a text are its words and its pairs of neighbouring words, repeats counted, hashed to buckets by CRC-32. A bucket's gain is the
scaled, floored logarithm of its smoothed share in the target texts over that in the raw texts; a document's weight is the floored mean of its features'
gains. Keyed Gumbel noise is added, so drawing the highest scores is drawing without replacement in proportion to the weights.

Weights are scored in arrays: the registers of all words of a batch advance together, a byte at a time, and a pair's CRC is put
together from its words' (CRC-32 is linear over exclusive or). Counting buckets and scoring are one scan each; between them go a row
for each bucket and task, and the gains (a number for each bucket).

The draw: bounds cut the order (score falling, then doc_id rising, nulls last, then row) into ranges of about RANGE_ROWS eligible
rows; they come from a sample, which shapes the ranges' sizes alone. Exact counts by range say where the draw ends; ranges beyond that are not
moved. Every task sorts its eligible rows into runs and sends their pieces, packed, to the tasks of their ranges, through Spark's shuffle files. There the
pieces of a range, a sorted run each, are merged by a k-way tournament tree that emits ranks and stops after the exact count. A
task holds the pieces of one range.

Null and empty texts have no features and weight 0, and aren't eligible. A null doc_id has the noise of the text `null`. Repeated doc_ids are
drawn like others: rows of equal score and doc_id follow each other in any order. Empty tables count nothing; with an empty target all is measured against the smoothing alone. Texts
of many megabytes are scored in blocks. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

BUCKETS = 10_000
LEAST_WORDS = 20
PER_CENT = 25
SEED = 7
#: Eligible rows in a range, which a task holds while it merges them; rows that a task sorts into a run at a time; samples a range.
RANGE_ROWS = 500_000
RUN_ROWS = 250_000
SAMPLES = 64
#: Bytes of text that are hashed at a time.
BLOCK = 4 << 20


# ---------------------------------------------------------------- CRC-32 in arrays


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_TABLE = _byte_table()
_FULL = np.uint32(0xFFFFFFFF)
#: Words of up to so many bytes go through arrays; longer ones one by one.
_LONG = 64


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the register that byte k of a register, b, becomes after n zero bytes."""
    tables = np.empty((_LONG + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, _LONG + 1):
        tables[n] = _TABLE[tables[n - 1] & 0xFF] ^ (tables[n - 1] >> 8)
    return tables


_SHIFTS = _shift_tables()


def _after(register: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes."""
    return (
        _SHIFTS[sizes, 0, register & 0xFF] ^ _SHIFTS[sizes, 1, (register >> 8) & 0xFF]
        ^ _SHIFTS[sizes, 2, (register >> 16) & 0xFF] ^ _SHIFTS[sizes, 3, register >> 24]
    )


def feature_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word of a text whose words have blanks between, and of each word with the next one; the words' places."""
    data = np.frombuffer(text + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(data > 32, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")  # the words that still have bytes are always the first ones
    by_size = -sizes[order]
    register = np.full(len(starts), _FULL, np.uint32)
    for k in range(min(int(sizes.max(initial=0)), _LONG)):
        live = order[: np.searchsorted(by_size, -k)]
        r = register[live]
        register[live] = _TABLE[(r ^ data[starts[live] + k]) & 0xFF] ^ (r >> 8)
    long = np.flatnonzero(sizes > _LONG)
    for k in long.tolist():
        register[k] = zlib.crc32(text[starts[k] : ends[k]]) ^ 0xFFFFFFFF
    if len(starts) < 2:
        return register ^ _FULL, np.empty(0, np.uint32), starts
    left = register[:-1]
    left = _TABLE[(left ^ np.uint32(32)) & 0xFF] ^ (left >> 8)
    pairs = register[1:] ^ _after(left ^ _FULL, np.minimum(sizes[1:], _LONG))
    for k in long[long > 0].tolist():
        pairs[k - 1] = zlib.crc32(text[starts[k] : ends[k]], int(left[k - 1] ^ _FULL)) ^ 0xFFFFFFFF
    return register ^ _FULL, pairs ^ _FULL, starts


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of features, the numbers of the texts that they stand in, and words by text: texts together up to BLOCK bytes; a longer one in
    pieces that are cut between words and begin with the last word of the piece before (`again`)."""

    def hashed(parts: list[bytes], again: bool):
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        one, two, starts = feature_hashes(b" ".join(parts))
        doc = np.searchsorted(begins, starts, "right") - 1
        inside = doc[1:] == doc[:-1]
        words, doc_of = (one[1:], doc[1:]) if again else (one, doc)
        buckets = np.concatenate([words, two[inside]]) % np.uint32(BUCKETS)
        return buckets.astype(np.int64), np.concatenate([doc_of, doc[:-1][inside]]), np.bincount(doc_of, minlength=len(parts))

    held, first, size = [], 0, 0
    for k, text in enumerate(texts):
        if held and size + len(text) > BLOCK:
            buckets, doc, words = hashed(held, False)
            yield buckets, doc + first, np.concatenate([np.zeros(first, np.int64), words])
            held, size = [], 0
        if not held:
            first = k
        if len(text) <= BLOCK:
            held.append(text)
            size += len(text)
            continue
        last, at = b"", 0
        while at < len(text):
            cut = len(text) if len(text) - at <= BLOCK else text.find(b" ", at + BLOCK)
            cut = len(text) if cut < 0 else cut
            piece = text[at:cut]
            if piece.strip():
                buckets, doc, words = hashed([last + b" " + piece], bool(last))
                yield buckets, doc + k, np.concatenate([np.zeros(k, np.int64), words])
                last = piece.rsplit(None, 1)[-1]
            at = cut + 1
    if held:
        buckets, doc, words = hashed(held, False)
        yield buckets, doc + first, np.concatenate([np.zeros(first, np.int64), words])


def _plain(texts: list[bytes | None]) -> list[bytes]:
    return [(t or b"").translate(common._WORD_BYTES) for t in texts]


# ---------------------------------------------------------------- counts, gains and scores


def bucket_counts(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                for buckets, _, _ in blocks(_plain(common.pylist(part, "text"))):
                    total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    rows = docs.select(common.as_bytes(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * BUCKETS
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    raw_all, target_all = float(sum(raw)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (raw_all + BUCKETS) / ((s + 1.0) * (target_all + BUCKETS)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts, ids = _plain(common.pylist(part, "text")), common.pylist(part, "doc_id")
                n_words, n_features, total = (np.zeros(len(ids), np.int64) for _ in range(3))
                for buckets, doc, words in blocks(texts):
                    n_words[: len(words)] += words
                    n_features += np.bincount(doc, minlength=len(ids))
                    np.add.at(total, doc, own[buckets])
                weight = total // np.maximum(n_features, 1)
                score = weight + np.array([noise(d, seed) for d in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.as_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---------------------------------------------------------------- the draw

_KEY = np.dtype([("score", ">u8"), ("null", "u1"), ("doc_id", ">u8"), ("row", ">u8")])
_PAYLOAD = ["doc_id", "n_features", "weight", "score", "row"]
_SIGN = np.uint64(1 << 63)


def keys_of(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Bytes that sort as the draw's order does: falling score, rising doc_id with nulls last, row."""
    out = np.empty(len(rows["score"]), _KEY)
    out["score"] = ~(rows["score"].astype(np.int64).view(np.uint64) ^ _SIGN)
    out["null"], out["doc_id"] = rows["null"], rows["doc_id"].astype(np.int64).view(np.uint64) ^ _SIGN
    out["row"] = rows["row"].astype(np.int64).view(np.uint64)
    return out.view(f"S{_KEY.itemsize}")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    doc = batch.column(batch.schema.get_field_index("doc_id"))
    out = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in batch.schema.names if c != "doc_id"}
    return out | {"doc_id": doc.fill_null(0).to_numpy(), "null": doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)}


class Tournament:
    """A tree of matches between the heads of sorted runs: the loser of each match stays at its node, and the winner goes up.

    Taking the least item costs one match for each level, on the path of the run that it came from."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        return won

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self):
        return self

    def __next__(self):
        won = self.winner
        item = self.heads[won]
        if item is None:
            raise StopIteration
        self.heads[won] = next(self.runs[won], None)
        node = (won + self.size) // 2
        while node:
            if not self._before(won, self.losers[node]):
                won, self.losers[node] = self.losers[node], won
            node //= 2
        self.winner = won
        return item


def range_numbers(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, keys, "right")


def range_cuts(eligible: DataFrame, rows: int) -> np.ndarray:
    """Keys between ranges, from a sample of about SAMPLES rows for each of them."""
    parts = -(-rows // RANGE_ROWS)
    if parts <= 1:
        return np.empty(0, f"S{_KEY.itemsize}")
    some = eligible.select("score", "doc_id", "row").sample(min(1.0, SAMPLES * parts / rows), seed=1).toArrow().combine_chunks().to_batches()
    keys = np.sort(np.concatenate([keys_of(_columns(b)) for b in some])) if some else np.empty(0, f"S{_KEY.itemsize}")
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys


def range_counts(eligible: DataFrame, cuts: np.ndarray) -> np.ndarray:
    """Exact numbers of eligible rows by range."""
    shared = eligible.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]):
        n = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            n += np.bincount(range_numbers(keys_of(_columns(batch)), shared.value), minlength=len(n))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], ["range", "n"])

    out = np.zeros(len(cuts) + 1, np.int64)
    for r in eligible.select("score", "doc_id", "row").mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        out[r["range"]] = r["n"]
    return out


_RESULT = "doc_id long, n_features long, weight long, score long, rank long"


def _result(rows: dict[str, np.ndarray], rank: pa.Array) -> pa.RecordBatch:
    doc = pa.array(rows["doc_id"], pa.int64(), mask=rows["null"].astype(bool))
    return pa.RecordBatch.from_arrays([doc, *(pa.array(rows[c], pa.int64()) for c in ("n_features", "weight", "score")), rank], [c.split()[0] for c in _RESULT.split(", ")])


def sorted_runs(eligible: DataFrame, cuts: np.ndarray, last: int) -> DataFrame:
    """Rows (range, run): a sorted piece of one run, packed, for each range up to `last`; rows of later ranges come as they are, as range -1."""
    shared = eligible.sparkSession.sparkContext.broadcast(cuts)

    def cut(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        keys = keys_of(rows)
        order = np.argsort(keys, kind="stable")
        order = order[: np.searchsorted(range_numbers(keys[order], shared.value), last, "right")]
        owner = range_numbers(keys[order], shared.value)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        pieces = np.split(order, edges[1:]) if len(order) else []
        packed = [b"".join(rows[c][p].astype("<i8").tobytes() for c in (*_PAYLOAD, "null")) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array(owner[edges].astype(np.int32)), pa.array(packed, pa.binary())], ["range", "run"])

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in common.gathered(batches, _columns, RUN_ROWS):
            yield cut(rows)

    return eligible.mapInArrow(run, "range int, run binary")


def merged(runs: DataFrame, ranges: int, before: np.ndarray, draw: int) -> DataFrame:
    """Ranked rows of all ranges. `before`: rows in the ranges before each; what is beyond the draw has no rank."""
    shared = runs.sparkSession.sparkContext.broadcast(before)

    def merge(number: int, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(p, "<i8").reshape(len(_PAYLOAD) + 1, -1) for p in pieces]
        rows = {c: np.concatenate([p[k] for p in parts]) for k, c in enumerate((*_PAYLOAD, "null"))}
        keys, ends = keys_of(rows), np.cumsum([p.shape[1] for p in parts]).tolist()
        first = int(shared.value[number])
        need = min(draw - first, len(keys))

        def of(a: int, b: int):
            return zip(keys[a:b].tolist(), range(a, b), strict=True)

        tree = Tournament([of(a, b) for a, b in zip([0, *ends], ends, strict=False)])
        order = np.fromiter((at for (_, at), _ in zip(tree, range(need), strict=False)), np.int64, need)
        left = np.ones(len(keys), bool)
        left[order] = False
        for at in range(0, need, 50_000):
            mine = order[at : at + 50_000]
            yield _result({c: v[mine] for c, v in rows.items()}, pa.array(np.arange(len(mine), dtype=np.int64) + first + at + 1))
        if left.any():
            yield _result({c: v[left] for c, v in rows.items()}, pa.nulls(int(left.sum()), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]):
        number, pieces = None, []
        for batch in batches:
            for own, piece in zip(common.pylist(batch, "range"), common.pylist(batch, "run"), strict=True):
                if own != number and pieces:
                    yield from merge(number, pieces)
                    pieces = []
                number = own
                pieces.append(piece)
        if pieces:
            yield from merge(number, pieces)

    dealt = runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return dealt.mapInArrow(run, _RESULT)


def draw(scores: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of a staged table of scores; undrawn rows have no rank."""
    scores = scores.withColumn("row", F.monotonically_increasing_id())
    fits = F.col("n_words") >= least_words
    eligible = scores.where(fits).select(*_PAYLOAD)
    rows = eligible.count()
    count = per_cent * rows // 100
    undrawn = scores.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not count:
        return undrawn
    cuts = range_cuts(eligible, rows)
    sizes = range_counts(eligible, cuts)
    before = np.cumsum(sizes) - sizes
    last = int(np.flatnonzero(before < count)[-1])
    ranked = merged(sorted_runs(eligible, cuts, last), last + 1, before, count)
    beyond = later(scores, cuts, last, fits)
    return ranked.unionByName(beyond)


def later(scores: DataFrame, cuts: np.ndarray, last: int, fits) -> DataFrame:
    """Rows that are not eligible or lie in ranges beyond the draw, without a rank; they stay where they are."""
    shared = scores.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = _columns(batch)
            out = ~rows["fits"].astype(bool) | (range_numbers(keys_of(rows), shared.value) > last)
            yield _result({c: v[out] for c, v in rows.items()}, pa.nulls(int(out.sum()), pa.int64()))

    return scores.select(*_PAYLOAD, F.coalesce(fits, F.lit(False)).cast("int").alias("fits")).mapInArrow(run, _RESULT)


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, id_col="doc_id", text_col="text", target_text_col="text", seed: int = SEED) -> DataFrame:
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    return draw(common.stage(scored(docs, gain, id_col, text_col, seed), "resample-scores"), per_cent, least_words)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

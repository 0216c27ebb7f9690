"""Shared parts of the training-data operators: tables, staging, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII letters and digits and every byte of a non-ASCII character belong to words; A-Z is lower-cased.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_M64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, an own one if all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tessellon-shared')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessellon/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage durably."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_tess_path"] = path
    return out


def drop_stage(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for frame in frames:
        own = frame.__dict__.get("_tess_path")
        for folder in [own] if own else {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            drop_path(spark, folder)


def leaving(frame: DataFrame, *tables: DataFrame) -> DataFrame:
    """frame, which reads staged tables that nothing else needs: whoever has written it may delete them (left_by)."""
    frame.__dict__["_tess_left"] = [*left_by(frame), *tables]
    return frame


def left_by(frame: DataFrame) -> list[DataFrame]:
    return frame.__dict__.get("_tess_left", [])


def drop_path(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of queries that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python workers small, whatever the texts' length: they and their copies are what a
    worker's memory holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_CACHES: dict[str, Callable[[], None]] = {}


def cache(name: str, clear: Callable[[], None]) -> None:
    """Names a cache that Python workers keep from task to task."""
    _CACHES[name] = clear


def use_only(name: str = "") -> None:
    """Empties the caches of other operators: workers are reused, and their memory is for the operator at work."""
    others = [clear for key, clear in _CACHES.items() if key != name]
    for clear in others:
        clear()
    if others:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # where the C library has it


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


def as_bytes(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _M64(30))
    x = x * _M64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M64(27))
    x = x * _M64(0x94D049BB133111EB)
    return x ^ (x >> _M64(31))


#: A word's bytes enter its hash eight at a time; a mask leaves out what follows the word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG_WORD = 64


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text whose words have blanks between, and the places where they start."""
    data = np.frombuffer(text + b" " * 8, np.uint8)
    edge = np.flatnonzero(np.diff(data > 32, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix64((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _M64(0x9E3779B97F4A7C15))
        more, done = np.flatnonzero(size > 8), 8
        while len(more) and done < _LONG_WORD:
            left = size[more] - done
            out[more] = mix64(out[more] + (eight[starts[more] + done] & _MASKS[np.minimum(left, 8)]) * _M64(0xD1B54A32D192ED03))
            more, done = more[left > 8], done + 8
    for k in more.tolist():
        out[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    return out, starts


def hash_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts laid end to end, and the number of words of each."""
    parts = [t or b"" for t in texts]
    hashes, starts = hash_words(b" ".join(parts).translate(_WORD_BYTES))
    begins = np.cumsum(np.array([0, *(len(p) + 1 for p in parts)], np.int64))
    at = np.searchsorted(starts, begins)
    return hashes, np.diff(at)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each window of k word hashes; a shorter, non-empty text is one window."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        k = n
    m = n - k + 1
    out = np.full(m, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out + hashes[i : i + m])
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: str, bytes_each: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into pieces with about so many bytes in a column, so memory stays bounded for long texts."""
    rows = batch.num_rows
    if not rows:
        return
    mean = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // rows)
    step = max(1, bytes_each // mean)
    for at in range(0, rows, step):
        yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def pylist(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


#: Ranges of a column, whatever its length: their tasks hold no range whole, so ranges may be long.
MOST_RANGES = 4096


def bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending values, fewer than `parts` and MOST_RANGES, that cut a column of longs into ranges of like size."""
    parts = min(parts, MOST_RANGES)
    if parts <= 1:
        return []
    cuts = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(column, cuts, 4 * MOST_RANGES).alias("c")).first()["c"]
    return sorted(set(got or []))


def range_of(column: Column, cuts: list[int]) -> Column:
    """How many of the cuts lie below the value: its range's number; null counts as below all. Looks at every 64th cut first."""
    if not cuts:
        return F.lit(0)

    def below(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda n, c: n + F.when(c < column, 1).otherwise(0))

    longs = lambda some: F.expr(f"array({','.join(f'{c}L' for c in some)})")
    if len(cuts) <= 64:
        return F.coalesce(below(longs(cuts)), F.lit(0))
    coarse = F.greatest(below(longs(cuts[::64])) - 1, F.lit(0)) * 64
    return F.coalesce(coarse + below(F.slice(longs(cuts), coarse + 1, F.lit(64))), F.lit(0))


def shingle_runs(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts laid end to end (counts: words of each), and the number of shingles of each text."""
    ends = np.cumsum(counts)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    full = shingles(hashes, k) if len(hashes) >= k else np.empty(0, np.uint64)
    starts = ends - counts
    # a text of k words or more takes its windows from the common run; windows across texts are left out
    take = np.repeat(counts >= k, many)
    place = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    out = np.empty(int(many.sum()), np.uint64)
    out[take] = full[place[take]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[int(many[:i].sum())] = shingles(hashes[starts[i] : ends[i]], k)[0]
    return out, many


class SortedLists:
    """Candidate pairs from rows that arrive sorted by list. Rows of a list of at most `most` rows are paired all with all; rows
    of a longer list are paired with the list's first row at most, and handed on for another step. Holds `most` rows at
    a time and one batch.

    keep(rows, i, j) says which pairs of row numbers are worth emitting (i before j). near(rows, i, j), where given, must
    turn false for good as j moves away from i."""

    def __init__(self, columns: list[str], most: int, keep, near=None):
        self.columns, self.most, self.keep, self.near = columns, most, keep, near
        self.held: dict[str, np.ndarray] | None = None
        self.long = False  # whether the held list is longer; then only its first row is held

    def _open(self, rows: dict[str, np.ndarray], last: bool):
        """Rows with the held ones before them, and per row: its list's first row, its place, whether its list is long,
        and whether it is short and complete; the rows to hand on."""
        if self.held is not None:
            rows = {c: np.concatenate([self.held[c], rows[c]]) for c in self.columns}
        key = rows[self.columns[0]]
        n = len(key)
        if not n:
            none = np.empty(0, np.int64)
            return rows, none, none, none.astype(bool), none.astype(bool), none
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([begins, [n]]))
        long = sizes > self.most
        carried = self.long
        long[0] |= carried
        ready = np.ones(len(begins), bool)
        ready[-1] = last or bool(long[-1])
        first = np.repeat(begins, sizes)
        in_long, in_short = np.repeat(long, sizes), np.repeat(ready & ~long, sizes)
        handed = np.flatnonzero(in_long)
        if carried:
            handed = handed[handed > 0]  # its first row has been handed on before
        if last:
            self.held, self.long = None, False
        else:
            self.long = bool(long[-1])
            a = begins[-1]
            self.held = {c: v[a : a + 1] if self.long else v[a:] for c, v in rows.items()}
        return rows, first, np.arange(n) - first, in_long, in_short, handed

    def _likely(self, rows: dict[str, np.ndarray], place: np.ndarray, in_short: np.ndarray):
        """Pairs within short lists, a lag at a time: no row comes twice on the same side of what is yielded at once."""
        rest, lag = np.flatnonzero(in_short), 0
        while True:
            lag += 1
            rest = rest[place[rest] >= lag]
            if self.near is not None and len(rest):
                rest = rest[self.near(rows, rest - lag, rest)]
            if not len(rest):
                return
            ok = self.keep(rows, rest - lag, rest)
            yield rest[ok] - lag, rest[ok]

    def add(self, rows: dict[str, np.ndarray], last: bool = False):
        """Rows, i and j of the pairs, whether i is its list's first row, and the numbers of rows that are handed on."""
        rows, first, place, in_long, in_short, handed = self._open(rows, last)
        j = np.flatnonzero(in_long & (place > 0))
        j = j[self.keep(rows, first[j], j)]
        found = [(first[j], j), *self._likely(rows, place, in_short)]
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return rows, i, j, first[j] == i, handed


class Nearest(SortedLists):
    """The same lists, but each row keeps only its nearest likely partners (`partners` of them, by `gap`) with ids not above its own. Longer lists are cut
    into pieces of `most` rows, and partners are looked for within the piece."""

    gap: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]
    partners = 8

    def add(self, rows: dict[str, np.ndarray], last: bool = False):
        """Nodes, their partners, whether they have one, and whether there may be further ones: all rows of pieces, and rows with more
        likely partners than are kept. Rows with neither are left out."""
        held = 0
        if self.held is not None:
            held = len(self.held[self.columns[0]])
            rows = {c: np.concatenate([self.held[c], rows[c]]) for c in self.columns}
        key = rows[self.columns[0]]
        n = len(key)
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([begins, [n]]))
        first = np.repeat(begins, sizes)
        cut = np.repeat(sizes > self.most, sizes)
        if self.long and held:
            cut[: sizes[0]] = True
        piece = (np.arange(n) - first) // self.most
        first = first + piece * self.most
        ready = np.ones(n, bool)
        if n and not last:
            a = int(first[-1])
            ready[a:] = False
            self.held, self.long = {c: v[a:] for c, v in rows.items()}, bool(cut[-1])
        else:
            self.held, self.long = None, False
        far = np.iinfo(np.int64).max
        best, partner, seen = np.full((n, self.partners), far), np.full((n, self.partners), -1), np.zeros(n, np.int64)
        ids = rows["id"]

        def offer(i: np.ndarray, j: np.ndarray, gap: np.ndarray) -> None:
            ok = ids[j] <= ids[i]
            i, j, gap = i[ok], j[ok], gap[ok]
            seen[i] += 1
            worst = best[i].argmax(1)
            nearer = gap < best[i, worst]
            i, worst = i[nearer], worst[nearer]
            best[i, worst], partner[i, worst] = gap[nearer], j[nearer]

        for i, j in self._likely(rows, np.arange(n) - first, ready):
            gap = self.gap(rows, i, j)
            offer(i, j, gap)
            offer(j, i, gap)
        many = (seen > self.partners) | (cut & ready)
        row, slot = np.nonzero((partner >= 0) | (many[:, None] & (np.arange(self.partners) == 0)))
        found = partner[row, slot]
        return rows["node"][row], rows["node"][found], found >= 0, many[row]


def longs(columns: list[str]) -> Callable[[pa.RecordBatch], dict[str, np.ndarray]]:
    return lambda batch: {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns}


def gathered(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], dict[str, np.ndarray]], rows: int = 40_000) -> Iterator[dict[str, np.ndarray]]:
    """Rows of several batches together, as arrays."""
    held, n = [], 0
    for batch in batches:
        held.append(read(batch))
        n += batch.num_rows
        if n >= rows:
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held, n = [], 0
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def open_pairs(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], dict[str, np.ndarray]], likely, cells: int = 500_000) -> Iterator[pa.RecordBatch]:
    """For rows sorted by list ("token") and within it by "closed", open ones first: every open row with every other of its
    list, in blocks, where their nodes differ and likely(rows, i, j). Yields a, b: the greater and the lesser node."""

    def across(left, right):
        step = max(1, cells // max(1, len(right["node"])))
        both = {c: np.concatenate([left[c], right[c]]) for c in left}
        for at in range(0, len(left["node"]), step):
            i, j = np.divmod(np.arange(min(step, len(left["node"]) - at) * len(right["node"])), len(right["node"]))
            i, j = i + at, j + len(left["node"])
            ok = both["node"][i] != both["node"][j]
            i, j = i[ok], j[ok]
            ok = likely(both, i, j)
            yield both["node"][i[ok]], both["node"][j[ok]]

    key, held = None, []
    for batch in batches:
        rows = read(batch)
        closed = rows["closed"]
        found = []
        for at in np.split(np.arange(len(closed)), np.flatnonzero(np.diff(rows["token"])) + 1):
            if not len(at):
                continue
            if rows["token"][at[0]] != key:
                key, held = rows["token"][at[0]], []
            for block in np.array_split(at, -(-len(at) // 1024)):
                mine = {c: v[block] for c, v in rows.items()}
                for other in held:
                    found += across(other, mine)
                fresh = {c: v[~closed[block]] for c, v in mine.items()}
                if len(fresh["node"]):
                    found += across(fresh, fresh)
                    if (~closed[block]).sum() < len(block):
                        found += across(fresh, {c: v[closed[block]] for c, v in mine.items()})
                    held.append(fresh)
        none = np.empty(0, np.int64)
        a, b = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


BLOOM_BITS = 1 << 25


def bloom_place(node: str = "node") -> Column:
    """A node is a hash already: its low bits are its place."""
    return F.col(node).bitwiseAND(BLOOM_BITS - 1)


def bloom(nodes: DataFrame) -> np.ndarray:
    """A bit for each node's hash, in a table of fixed size (4 MB), whatever the number of nodes."""
    place = bloom_place() + 1
    rows = nodes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    table = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in rows:
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def in_bloom(table: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    places = nodes & (BLOOM_BITS - 1)
    return ((table[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool)


def bits_apart(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, columns: tuple[str, ...] = ("x", "y")) -> np.ndarray:
    """In how many bits the columns of two rows differ."""
    return sum(np.bitwise_count((rows[c][i] ^ rows[c][j]).view(np.uint64)).astype(np.int64) for c in columns)

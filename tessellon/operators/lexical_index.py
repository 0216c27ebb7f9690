"""An index for searches over hashed texts: lists by component in falling order of impact, searched no further than the k best need.

A document's vector counts its terms by hashed component, with a sign, at unit length (the same numbers as functions.vectors.sparse_embedding). Tasks
cut their stream of documents into parts and write each part as one Arrow file: for every component a list of documents and values, the greatest first, and the
documents' own vectors. There is no exchange. A manifest, itself a table in the folder, names the files that count, so what a lost or repeated
task has left is never read.

A search sends blocks of queries to all parts. A part's lists are read in blocks, always the list whose next block can add most. A sign belongs to a
component, so all products are positive, and what the lists' next blocks hold is a bound on every document not met yet: as soon as the k-th best
document met is above it, the rest is skipped. Documents met that may still be among the k best are scored from their own vectors. A part answers with k rows
a query at most; no row stands for a pair. Documents that share no component with a query are left out: they would be at distance 2.

Null and empty texts have no components. Rows with equal ids stay rows of their own; ids are longs or strings.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import vectors as vx
from tessellon.operators.retrieval import top_k

DIM = 768
#: Documents in a part at most, entries of a list that are read at a time, and queries that are sent at once.
PART_DOCS, BLOCK, QUERIES = 10_000, 1024, 1000
#: Scores nearer than this count as equal until they are compared exactly.
MARGIN = 1e-8
_MANIFEST = "path string, docs long, entries long"


@dataclass(frozen=True)
class Components:
    dim: int

    def of(self, terms: pa.Array) -> np.ndarray:
        """Component of each term (a string), the sign in the lowest bit: FNV-1a over the bytes, the terms in step, the longest first."""
        data, n = terms.cast(pa.large_binary()), len(terms)
        start = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + n + 1] if n else np.zeros(1, np.int64)
        size = np.diff(start)
        order = np.argsort(-size, kind="stable")
        at, falling = start[:-1][order], -size[order]
        buffer = data.buffers()[2] if n else None
        raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        h = np.full(n, vx._BASIS ^ vx.SEED, np.uint64)
        for k in range(int(-falling[0]) if n else 0):
            m = np.searchsorted(falling, -k)
            h[:m] = (h[:m] ^ raw[at[:m] + k]) * np.uint64((1 << 40) + 435)
        out = np.empty(n, np.int64)
        out[order] = (h % np.uint64(self.dim) * np.uint64(2) + (h & np.uint64(1))).astype(np.int64)
        return out


def dense_rows(terms: pa.ListArray, known: Components) -> np.ndarray:
    """Unit vectors of lists of terms; zeros for a list without terms."""
    n = len(terms)
    coded = terms.flatten().dictionary_encode()
    code = known.of(coded.dictionary)
    own = code[coded.indices.to_numpy()] if len(code) else code
    doc = np.repeat(np.arange(n), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.bincount(doc * known.dim + own // 2, np.where(own % 2, -1.0, 1.0), n * known.dim).reshape(n, known.dim)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None]


@dataclass
class Part:
    ids: pa.Array
    starts: np.ndarray  # of each component's list
    docs: np.ndarray
    values: np.ndarray  # absolute, falling within a list
    row_starts: np.ndarray
    row_components: np.ndarray
    row_values: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, doc: np.ndarray, component: np.ndarray, value: np.ndarray, dim: int) -> Part:
        rank = pa.compute.sort_indices(pa.table({"id": ids}), [("id", "ascending")], null_placement="at_start").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        doc = place[doc]
        by_row, by_list = np.lexsort((component, doc)), np.lexsort((doc, -np.abs(value), component))
        return cls(
            ids.take(pa.array(rank)), np.searchsorted(component[by_list], np.arange(dim + 1)), doc[by_list].astype(np.int32), np.abs(value)[by_list],
            np.searchsorted(doc[by_row], np.arange(len(ids) + 1)), component[by_row].astype(np.int16), value[by_row],
        )

    def write(self, folder: str) -> str:
        columns = {"ids": self.ids} | {k: pa.array(v) for k, v in vars(self).items() if k != "ids"}
        table = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"lists-{uuid.uuid4().hex}.arrow"
        with store.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        return f"{folder}/{name}"

    @classmethod
    def read(cls, uri: str) -> Part:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as source:
            table = pa.ipc.open_file(source).read_all()
        columns = {c: table.column(c).combine_chunks().flatten() for c in table.column_names}
        return cls(columns.pop("ids"), **{k: v.to_numpy() for k, v in columns.items()})

    def search(self, components: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents' numbers (in the order of ids) and d2 (nine decimals) of the k nearest, ties by number; and how many list entries were read."""
        score, read, floor = np.zeros(len(self.ids)), 0, 0.0
        places = self.starts[components].tolist()
        ends = self.starts[components + 1].tolist()
        weight = np.abs(weights)
        heads = [(-weight[i] * self.values[places[i]], i) for i in range(len(places)) if places[i] < ends[i]]
        heapq.heapify(heads)
        bound = -sum(h for h, _ in heads)
        while heads and bound >= floor - MARGIN:
            top, i = heads[0]
            at, upto = places[i], min(places[i] + BLOCK, ends[i])
            score[self.docs[at:upto]] += weight[i] * self.values[at:upto]
            read, places[i] = read + upto - at, upto
            bound += top
            if upto < ends[i]:
                heapq.heapreplace(heads, (-weight[i] * self.values[upto], i))
                bound += weight[i] * self.values[upto]
            else:
                heapq.heappop(heads)
            if k < len(score):
                floor = np.partition(score, len(score) - k)[len(score) - k]
        found = np.flatnonzero((score > 0) & (score + bound >= floor - MARGIN))
        query = np.zeros(len(self.starts) - 1)
        query[components] = weights
        sizes = self.row_starts[found + 1] - self.row_starts[found]
        entries = np.repeat(self.row_starts[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        products = self.row_values[entries] * query[self.row_components[entries]]
        dots = np.add.reduceat(products, np.cumsum(sizes) - sizes) if len(found) else np.empty(0)
        d2 = np.round(2 - 2 * dots, 9)
        order = np.lexsort((found, d2))[:k]
        return found[order], d2[order], read


@dataclass
class LexicalIndex:
    folder: str
    manifest: DataFrame
    id_type: str

    @classmethod
    def open(cls, spark: SparkSession, folder: str, id_type: str = "bigint") -> LexicalIndex:
        return cls(folder, spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest"), id_type)


def build(docs: DataFrame, folder: str, terms: Column, id_col: str = "doc_id", dim: int = DIM, part_docs: int = PART_DOCS, split: Callable[[str | None], list[str]] | None = None) -> LexicalIndex:
    """Indexes every document that has terms (an array of strings; or, with split, texts that it makes terms of, which spares sending all terms to the tasks)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def flushed(held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        part = Part.of(ids, *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)), dim)
        return pa.RecordBatch.from_arrays([pa.array([part.write(f"{folder}/parts")]), pa.array([len(ids)]), pa.array([len(part.docs)])], [c.split()[0] for c in _MANIFEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]):
        known, held, n = Components(dim), [], 0
        for batch in batches:
            step = min(500, part_docs)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                own = some.column(1) if split is None else pa.array([split(x) for x in some.column(1).to_pylist()], pa.list_(pa.string()))
                rows = dense_rows(own, known)
                some, rows = some.filter(pa.array(rows.any(1))), rows[rows.any(1)]
                if not len(rows):
                    continue
                doc, component = np.nonzero(rows)
                held.append((some.column(0), doc + n, component, rows[doc, component]))
                n += len(rows)
                if n >= part_docs:
                    yield flushed(held)
                    held, n = [], 0
        if held:
            yield flushed(held)

    docs.select(F.col(id_col).alias("id"), terms.alias("terms")).mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return LexicalIndex.open(docs.sparkSession, folder, kind)


def search(index: LexicalIndex, queries: DataFrame, terms: Column, k: int, query_id: str = "query_id", dim: int = DIM) -> DataFrame:
    """query_id, id, d2 and rank of the k nearest documents of each query, ties by id. Queries are a stated set; blocks of QUERIES of them are sent to the
    tasks in turn, so what is sent stays bounded."""
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query_id"), terms.alias("terms"))
    blocks = max(1, -(-queries.count() // QUERIES))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        table = own.toArrow().combine_chunks()
        rows = dense_rows(pa.concat_arrays(table.column("terms").chunks) if table.num_rows else pa.array([], pa.list_(pa.string())), Components(dim))
        shared = queries.sparkSession.sparkContext.broadcast((table.column("query_id").combine_chunks(), [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            ids, vectors = shared.value
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    part = Part.read(path)
                    found = [part.search(*v, k) for v in vectors]
                    size = np.array([len(f[0]) for f in found], np.int64)
                    docs, d2 = (np.concatenate([np.empty(0, t), *(f[j] for f in found)]) for j, t in ((0, np.int64), (1, float)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), size))), part.ids.take(pa.array(docs)), pa.array(d2)], ["query_id", "id", "d2"])

        parts = index.manifest.select("path").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = parts.mapInArrow(run, f"query_id {kind}, id {index.id_type}, d2 double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, ["query_id"], [F.col("d2"), F.col("id")], k)

"""A vector index for searches that need not be exact: graphs of near neighbours, one for each part of the vectors.

Vectors are dealt to cells by the nearest of some centroids (fitted on a bounded sample; every vector is indexed) and large cells to parts of
bounded size. A task builds a part's graph: layers that thin out upwards, links chosen so that they lead in different directions, and a way from the
entry to every node. It writes the graph as one Arrow file into the index's folder, which all executors share. A manifest, itself a table in that folder, names
the files that count, so what a lost or repeated task has left is never read.

A search asks the parts of the nearest cells (`probes`; None: all of them). Parts are held together in bundles of about PART_ROWS vectors, and a query goes once to each
bundle in which it asks a part. A task reads a bundle's files one after the other and walks their graphs for a block of queries at a time, or, where a walk would see
most of the nodes, compares all of them by a matrix product; k rows of a query leave it. ``retrieval.nearest`` stays the exact way; ``recall`` says how much of
its answer the index finds.

Vectors that are null, empty or of another length than most, or that hold null, NaN or an infinity, are left out. Equal vectors are one
node with several ids. An empty table gives an index without parts, and searches without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.operators.retrieval import nearest, top_k

#: Links of a node (twice as many in the lowest layer), candidates for them, and the width of a search.
LINKS, CANDIDATES, WIDTH = 32, 200, 128
#: Vectors in a part about, cells at most, and sampled vectors for each cell's centroid.
PART_ROWS, MOST_CELLS, SAMPLED = 20_000, 4096, 64
#: Queries that walk a graph together, and that one task takes about of a bundle.
TOGETHER, TASK_QUERIES = 64, 4096
#: A graph of at most so many times a walk's width is searched whole; pairs of queries and nodes, or of queries and cells, that are held at once.
WHOLE, PAIRS_AT_ONCE = 8, 1_000_000


# ---------------------------------------------------------------- one part's graph


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of all rows of a to all rows of b (last two axes)."""
    cross = a @ np.swapaxes(b, -1, -2)
    return (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * cross


@dataclass
class Graph:
    vectors: np.ndarray  # distinct, float32
    layers: list[np.ndarray]  # from the lowest: links of each node, -1 where there is none
    entry: int

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        n = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(n).random(n) + 1e-12) / np.log(links)).astype(int)
        layers = []
        for layer in range(int(height.max()) + 1):
            members = np.flatnonzero(height >= layer)
            most = links if layer else 2 * links
            own = _linked(vectors[members], links, most, candidates)
            table = np.full((n, own.shape[1]), -1, np.int32)
            table[members] = np.where(own < 0, -1, members[own])
            layers.append(table)
        entry = int(np.argmax(height))
        layers[0] = _reachable(vectors, layers[0], entry)
        return cls(vectors, layers, entry)

    def search(self, queries: np.ndarray, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances, rising, of about the k nearest of each query; -1 and infinity beyond the graph's nodes."""
        found, apart = zip(*(self._walk(queries[a : a + TOGETHER], max(k, width)) for a in range(0, len(queries), TOGETHER)), strict=True)
        return np.concatenate(found)[:, :k], np.concatenate(apart)[:, :k]

    def near(self, queries: np.ndarray, k: int, width: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and nodes: about the k nearest of each query, or, in a small graph, all that may be among these and as near as `within` (squared distances)."""
        if len(self.vectors) > WHOLE * width:
            nodes, _ = self.search(queries, k, width)
            rows, place = np.nonzero(nodes >= 0)
            return rows, nodes[rows, place]
        found, step = [], max(1, PAIRS_AT_ONCE // len(self.vectors))
        with np.errstate(all="ignore"):
            most = (self.vectors * self.vectors).sum(1).max()
            for a in range(0, len(queries), step):
                q = queries[a : a + step]
                d = _distances(q, self.vectors)
                error = 8 * (q.shape[1] + 4) * np.finfo(np.float32).eps * ((q * q).sum(1) + most)
                limit = within[a : a + step] + error
                take = ~(d > limit[:, None])
                many = np.flatnonzero(np.count_nonzero(take, axis=1) > k)
                if len(many) and len(self.vectors) > k:
                    own = d[many]
                    take[many] &= ~(own > (np.partition(own, k - 1, axis=1)[:, k - 1] + error[many])[:, None])
                rows, nodes = np.nonzero(take)
                found.append((rows + a, nodes))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _apart(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gaps = self.vectors[nodes] - queries[:, None, :]
        return np.einsum("qnd,qnd->qn", gaps, gaps)

    def _walk(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(queries))
        at = np.full(len(queries), self.entry)
        best = self._apart(queries, at[:, None])[:, 0]
        for table in self.layers[:0:-1]:
            while True:  # downhill as far as it goes
                near = table[at]
                d = np.where(near < 0, np.inf, self._apart(queries, near))
                step = d.argmin(1)
                nearer = d[rows, step] < best
                if not nearer.any():
                    break
                at, best = np.where(nearer, near[rows, step], at), np.where(nearer, d[rows, step], best)
        nodes, apart = np.full((len(queries), width), -1), np.full((len(queries), width), np.inf)
        opened, seen = np.ones((len(queries), width), bool), np.zeros((len(queries), len(self.vectors)), bool)
        nodes[:, 0], apart[:, 0], opened[:, 0], seen[rows, at] = at, best, False, True
        while not opened.all():
            step = np.where(opened, np.inf, apart).argmin(1)
            live = rows[~opened.all(1)]
            opened[live, step[live]] = True
            near = self.layers[0][nodes[live, step[live]]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            i, j = np.nonzero(fresh)
            seen[live[i], near[i, j]] = True
            d = np.where(fresh, self._apart(queries[live], near), np.inf)
            nodes_now, apart_now = np.concatenate([nodes[live], near], 1), np.concatenate([apart[live], d], 1)
            opened_now = np.concatenate([opened[live], ~fresh], 1)
            order = np.argpartition(apart_now, width - 1, axis=1)[:, :width]
            take = (np.arange(len(live))[:, None], order)
            nodes[live], apart[live], opened[live] = nodes_now[take], apart_now[take], opened_now[take] | np.isinf(apart_now[take])
        order = np.argsort(apart, axis=1, kind="stable")
        return np.where(np.isinf(apart), -1, nodes)[rows[:, None], order], apart[rows[:, None], order]


def _linked(vectors: np.ndarray, links: int, most: int, candidates: int, block: int = 64) -> np.ndarray:
    """Links of each vector to near ones: a candidate that is nearer to one chosen before than to the vector itself waits until no others are left.
    Links count both ways; a node with more than `most` keeps the nearest."""
    n = len(vectors)
    c = min(candidates, n - 1)
    if c <= 0:
        return np.full((n, 1), -1)
    source, target, apart = [], [], []
    for a in range(0, n, block):
        own = vectors[a : a + block]
        rows = np.arange(len(own))
        d = _distances(own, vectors)
        d[rows, rows + a] = np.inf
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        d = np.take_along_axis(d, near, 1)
        between = _distances(vectors[near], vectors[near])
        chosen, shade, count = np.zeros(near.shape, bool), np.full(near.shape, np.inf), np.zeros(len(own), int)
        for k in range(c):
            take = (d[:, k] < shade[:, k]) & (count < links)
            chosen[take, k] = True
            count += take
            shade = np.where(take[:, None], np.minimum(shade, between[:, k]), shade)
        chosen |= ~chosen & (np.cumsum(~chosen, 1) <= (links - count)[:, None])
        i, k = np.nonzero(chosen)
        source.append(i + a)
        target.append(near[i, k])
        apart.append(d[i, k])
    source, target, apart = np.concatenate(source), np.concatenate(target), np.concatenate(apart)
    source, target, apart = np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([apart, apart])
    order = np.lexsort((target, apart, source))
    source, target = source[order], target[order]
    again = np.concatenate([[False], (source[1:] == source[:-1]) & (target[1:] == target[:-1])])
    source, target = source[~again], target[~again]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    kept = place < most
    out = np.full((n, most), -1)
    out[source[kept], place[kept]] = target[kept]
    return out


def _reachable(vectors: np.ndarray, table: np.ndarray, entry: int) -> np.ndarray:
    """Links with further ones where nodes can't be reached from the entry: each such group is joined at its nearest reached node."""
    reached = np.zeros(len(table), bool)

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(table[front])
            front = front[(front >= 0) & ~reached[front]]

    spread(np.array([entry]))
    lost = np.flatnonzero(~reached)
    if not len(lost):
        return table
    known = np.flatnonzero(reached)
    nearest, apart = np.empty(len(lost), int), np.empty(len(lost))
    for a in range(0, len(lost), 256):
        d = _distances(vectors[lost[a : a + 256]], vectors[known])
        nearest[a : a + 256], apart[a : a + 256] = known[d.argmin(1)], d.min(1)
    for k in np.argsort(apart, kind="stable"):
        if not reached[lost[k]]:
            own = table[nearest[k]]
            if (own >= 0).all():
                table = np.concatenate([table, np.full((len(table), 8), -1, table.dtype)], 1)
                own = table[nearest[k]]
            own[np.argmax(own < 0)] = lost[k]
            spread(lost[k : k + 1])
    return table


# ---------------------------------------------------------------- files

_MANIFEST = "cell int, part int, path string, rows long, distinct_rows long"


def _write_part(folder: str, vectors: np.ndarray, ids: pa.Array, links: int, candidates: int) -> tuple[str, int]:
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(owner.ravel(), kind="stable")
    starts = np.searchsorted(owner.ravel()[order], np.arange(len(distinct) + 1)).astype(np.int32)
    graph = Graph.build(distinct, links, candidates)
    lists = lambda table: pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1]).astype(np.int32), pa.array(table.ravel()))
    columns = {"ids": pa.ListArray.from_arrays(pa.array(starts), ids.take(pa.array(order)).cast(pa.int64())), "vector": lists(distinct)}
    columns |= {f"layer{k}": lists(t) for k, t in enumerate(graph.layers)}
    table = pa.table(columns).replace_schema_metadata({"entry": str(graph.entry)})
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"graph-{uuid.uuid4().hex}.arrow"
    with store.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    return f"{folder}/{name}", len(distinct)


def _read_part(uri: str) -> tuple[Graph, pa.ListArray]:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        table = pa.ipc.open_file(source).read_all().combine_chunks()
    square = lambda c: np.array(c.combine_chunks().flatten()).reshape(len(table), -1)
    layers = [square(table.column(c)) for c in table.column_names if c.startswith("layer")]
    return Graph(square(table.column("vector")), layers, int(table.schema.metadata[b"entry"])), table.column("ids").combine_chunks()


# ---------------------------------------------------------------- the index


@dataclass
class VectorIndex:
    """An index in a folder: its manifest (cell, part, path, rows, distinct_rows) and its cells' centroids (at most MOST_CELLS)."""

    folder: str
    manifest: DataFrame
    centroids: np.ndarray

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        rows = spark.read.schema("cell int, centroid array<float>").parquet(f"{folder}/centroids").orderBy("cell").collect()
        size = len(rows[0]["centroid"]) if rows else 0
        return cls(folder, spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest"), np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), size))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Vectors without nulls, NaN and infinities, of the length that most have."""
    e = F.col(vec_col)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.size(e) > 0).where(finite)
    size = whole.groupBy(F.size(e).alias("s")).count().orderBy(F.desc("count"), F.desc("s")).limit(1).collect()
    return whole.where(F.size(e) == (size[0]["s"] if size else 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten(), np.float32).reshape(-1, size)


def fit_cells(vectors: DataFrame, vec_col: str, rows: int, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of cells by Lloyd's rounds over a sample of about SAMPLED vectors for each, MOST_CELLS * SAMPLED at most."""
    share = min(1.0, SAMPLED * cells / rows)
    some = np.array([r[0] for r in vectors.select(vec_col).sample(share, seed=3).collect()], np.float32)
    if not len(some):
        some = np.array([r[0] for r in vectors.select(vec_col).limit(1).collect()], np.float32)
    some = np.unique(some, axis=0)
    centers = some[np.random.default_rng(5).permutation(len(some))[:cells]]
    for _ in range(rounds if len(centers) > 1 else 0):
        own = np.concatenate([_distances(some[a : a + 1024], centers).argmin(1) for a in range(0, len(some), 1024)])
        sums = np.zeros(centers.shape)
        np.add.at(sums, own, some)
        count = np.bincount(own, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers).astype(np.float32)
    return centers


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = PART_ROWS, links: int = LINKS, candidates: int = CANDIDATES) -> VectorIndex:
    """Indexes every usable vector; ids are longs."""
    spark = vectors.sparkSession
    source = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")), "vec")
    rows = source.count()
    cells = min(MOST_CELLS, -(-rows // part_rows))
    centers = fit_cells(source, "vec", rows, cells) if cells > 1 else np.zeros((min(cells, 1), 1), np.float32)
    dealt = _nearest_cells(source, "id long, vec array<float>", centers, 1) if cells > 1 else source.withColumn("cell", F.lit(0))
    # a row for each cell: bounded by MOST_CELLS
    sizes = dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int"))

    def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        vec = group.column("vec").combine_chunks()
        path, distinct = _write_part(f"{folder}/parts", _matrix(vec, len(vec[0])), group.column("id").combine_chunks(), links, candidates)
        cell, part = (k.as_py() for k in key)
        return pa.table([pa.array([v], t) for v, t in ((cell, pa.int32()), (part, pa.int32()), (path, pa.string()), (group.num_rows, pa.int64()), (distinct, pa.int64()))], [c.split()[0] for c in _MANIFEST.split(", ")])

    dealt.select("cell", "part", "id", "vec").groupBy("cell", "part").applyInArrow(one, _MANIFEST).write.parquet(f"{folder}/manifest")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, centroid array<float>").write.parquet(f"{folder}/centroids")
    return VectorIndex.open(spark, folder)


def _nearest_cells(vectors: DataFrame, schema: str, centers: np.ndarray, probes: int) -> DataFrame:
    """Rows with each of the `probes` cells whose centroids are nearest to column vec."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        centers = shared.value
        p = min(probes, len(centers))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                d = _distances(_matrix(part.column(names.index("vec")), centers.shape[1]), centers)
                cells = np.argpartition(d, p - 1, axis=1)[:, :p].astype(np.int32)
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), p)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel())], [*names, "cell"])

    return vectors.select(*names).mapInArrow(run, f"{schema}, cell int")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, width: int = WIDTH, query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """query_id, id, d2 and rank of about the k nearest vectors of each query, ties by id; queries without a usable vector have no rows."""
    kind = queries.schema[query_id].dataType.simpleString()
    asked = usable(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<float>").alias("vec")), "vec")
    sizes = {r["cell"]: r["rows"] for r in index.manifest.groupBy("cell").agg(F.sum("rows").alias("rows")).collect()}  # bounded by MOST_CELLS
    groups, salts = max(1, min(len(index.centroids), -(-sum(sizes.values()) // PART_ROWS))), max(1, -(-asked.count() // TASK_QUERIES))
    # a bundle is a group of cells, or, of cells in many parts, a slice of them
    held = np.zeros(groups, int)
    for cell, rows in sizes.items():
        held[cell % groups] += rows
    slices = F.broadcast(queries.sparkSession.createDataFrame([(g, -(-n // (2 * PART_ROWS))) for g, n in enumerate(held.tolist()) if n], "group int, slices int"))
    files = index.manifest.select("cell", "part", "path", F.pmod("cell", F.lit(groups)).alias("group"))
    if probes is None or probes >= len(index.centroids):
        asked = asked.withColumn("cells", F.lit(None).cast("array<int>")).crossJoin(slices)
    else:
        asked = _asked_groups(asked, kind, index.centroids, probes, groups).join(slices, "group")
    # a bundle that many queries ask goes to several tasks
    asked = asked.select("group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int").alias("salt"), "query_id", "vec", "cells")
    files = files.join(slices, "group").select("group", F.pmod("part", "slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "cell", "path")

    def answer(asked: pa.Table, files: pa.Table) -> pa.Table:
        wanted, best = asked.column("cells").combine_chunks(), None
        owner, cells = np.repeat(np.arange(len(wanted)), pc.fill_null(pc.list_value_length(wanted), 0)), wanted.flatten().to_numpy(zero_copy_only=False)
        everywhere, vectors = wanted.null_count > 0, asked.column("vec").combine_chunks()
        for cell, path in zip(files.column("cell").to_pylist(), files.column("path").to_pylist(), strict=True) if asked.num_rows else ():
            own = np.arange(asked.num_rows) if everywhere else owner[cells == cell]
            if not len(own):
                continue
            graph, ids = _read_part(path)
            best = best or _Best(_matrix(vectors, graph.vectors.shape[1]), k)
            best.add(own, graph, ids, width)
        places, ids, d2 = best.rows() if best else (np.zeros(0, int), pa.array([], pa.int64()), np.zeros(0))
        return pa.table([asked.column("query_id").take(pa.array(places)), ids, pa.array(d2)], ["query_id", "id", "d2"])

    # twice as many tasks as bundles, so that few tasks have several
    bundle = ["group", "slice", "salt"]
    dealt = [d.repartition(2 * groups * salts, *bundle).groupBy(*bundle) for d in (asked, files)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(answer, f"query_id {kind}, id long, d2 double")
    return top_k(found, ["query_id"], [F.col("d2"), F.col("id")], k)


def _asked_groups(asked: DataFrame, kind: str, centers: np.ndarray, probes: int, groups: int) -> DataFrame:
    """Queries (query_id, vec) with each group (cell modulo groups) that has some of the `probes` nearest cells, and these cells."""
    shared = asked.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]):
        centers = shared.value
        p = min(probes, len(centers))
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, PAIRS_AT_ONCE // (10 * p))):
                part = batch.slice(a, step)
                d = _distances(_matrix(part.column(1), centers.shape[1]), centers)
                cells = np.argpartition(d, p - 1, axis=1)[:, :p].ravel()
                rows = np.repeat(np.arange(part.num_rows), p)
                order = np.lexsort((cells, cells % groups, rows))
                rows, cells = rows[order], cells[order]
                starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (cells[1:] % groups != cells[:-1] % groups)]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(cells.astype(np.int32)))
                own = part.take(pa.array(rows[starts]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array((cells[starts] % groups).astype(np.int32)), lists], ["query_id", "vec", "group", "cells"])

    return asked.select("query_id", "vec").mapInArrow(run, f"query_id {kind}, vec array<float>, group int, cells array<int>")


class _Best:
    """The k nearest so far of each query, ties by id, null first."""

    _NULL = np.iinfo(np.int64).min

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k = vectors, k
        self.d2, self.ids = np.full((len(vectors), k), np.inf), np.full((len(vectors), k), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, graph: Graph, ids: pa.ListArray, width: int) -> None:
        """With a part's nodes, of which the queries at `own` are asked."""
        several = ids.value_lengths().to_numpy()
        every, node = pc.fill_null(ids.flatten(), int(self._NULL)).to_numpy(), np.repeat(np.arange(len(several)), several)
        if several.max() > 1:  # of equal vectors the k least ids are enough
            every = every[np.lexsort((every, node))]
        starts, several = np.cumsum(several) - several, np.minimum(several, self.k)
        for a in range(0, len(own), TASK_QUERIES):
            some = own[a : a + TASK_QUERIES]
            rows, nodes = graph.near(self.vectors[some], self.k, width, self.d2[some, -1])
            rows = some[rows]
            for b in range(0, len(rows), step := PAIRS_AT_ONCE // 16):
                r, n = rows[b : b + step], nodes[b : b + step]
                gaps = self.vectors[r].astype(float) - graph.vectors[n].astype(float)
                d2 = (gaps * gaps).sum(1)
                near = d2 <= self.d2[r, -1]
                r, n, d2 = r[near], n[near], d2[near]
                count = several[n]
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                self._merge(np.repeat(r, count), every[np.repeat(starts[n], count) + nth], np.repeat(d2, count))

    def _merge(self, rows: np.ndarray, ids: np.ndarray, d2: np.ndarray) -> None:
        touched, at = np.unique(rows, return_inverse=True)
        at, n = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at]), len(touched)
        ids, d2 = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.d2[touched].ravel(), d2])
        order = np.lexsort((ids, d2, at))
        at, ids, d2 = at[order], ids[order], d2[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.ids[touched], self.d2[touched] = ids[first].reshape(n, self.k), d2[first].reshape(n, self.k)

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Places of the queries, ids and distances."""
        rows, place = np.nonzero(np.isfinite(self.d2))
        ids = self.ids[rows, place]
        return rows, pa.array(ids, mask=ids == self._NULL), self.d2[rows, place]


def probes_needed(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, share: float = 0.98, least: int = 1, sample: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query_vec") -> int:
    """The fewest cells, `least` at least, that hold this share of the exact answers of a sample of the queries: more vectors in more cells need more of them."""
    if len(index.centroids) <= least:
        return least
    asked = usable(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<float>").alias("query_vec")), "query_vec").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    held = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")), "vec")
    found = nearest(held, asked, k, "id", "vec").select("query_id", "id").join(held, "id").join(asked, "query_id").select("vec", "query_vec").collect()  # sample * k rows at most
    if not found:
        return least
    cell = _distances(np.array([r["vec"] for r in found], np.float32), index.centroids).argmin(1)
    apart = _distances(np.array([r["query_vec"] for r in found], np.float32), index.centroids)
    nth = np.sort((apart < apart[np.arange(len(found)), cell][:, None]).sum(1) + 1)
    return max(least, int(nth[int(np.ceil(share * len(nth))) - 1]))


def recall(found: DataFrame, exact: DataFrame, id_col: str = "id") -> DataFrame:
    """queries, and the mean share of each query's exact answers (query_id, id) that are found."""
    hits = exact.select("query_id", F.col(id_col).alias("id")).join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))


def round_trip(index: VectorIndex, vectors: DataFrame, sample: int = 100, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: vectors that the index holds, their length, how many were asked for themselves, and the greatest distance of an answer."""
    source = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")), "vec")
    some = source.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256), "id").limit(sample).withColumn("query_id", F.monotonically_increasing_id())
    answers = search(index, some.withColumnRenamed("vec", "query_vec"), 1)
    asked = some.select("query_id", F.size("vec").alias("dim")).join(answers.select("query_id", "d2"), "query_id", "left")
    figures = asked.agg(F.max("dim").alias("dim"), F.count(F.lit(1)).alias("sampled"), F.max(F.sqrt(F.coalesce("d2", F.lit(float("inf"))))).alias("error_max"))
    return index.manifest.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("vectors")).crossJoin(figures)

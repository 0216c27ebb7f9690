"""Exact vector search, lexical and vector search together, and search with fallbacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import stats
from tessellon.functions import text as tx
from tessellon.functions import vectors as vx

#: Vectors and queries that meet in one group at most, about; and pairs of them that are held at once.
VECTOR_BLOCK, QUERY_BLOCK = 10_000, 10_000
PAIRS_AT_ONCE = 2_000_000
#: Rows of sparse queries that are broadcast at once; more are searched in turn, so what is sent to all executors stays bounded.
SPARSE_BLOCK = 200_000


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's part to k before rows are exchanged."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """query_id, id, d2 and rank of the k nearest vectors of each query, ties by id. d2 is null, and last, where a vector is null, holds a null or has another length than the query's.
    Vectors and queries are dealt to blocks by their ids; each block of vectors meets each block of queries in a group of bounded size, which leaves k rows of each query."""
    rows, columns = max(1, -(-vectors.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell, kind = ["_row", "_column"], (queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())
    v = vectors.select(own(id_col, rows).alias("_row"), every(columns).alias("_column"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(every(rows).alias("_row"), own(query_id, columns).alias("_column"), F.col(query_id).alias("id"), F.col(query_vec).alias("vec"))

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, [("id", "ascending")], null_placement="at_start"))
        i, j, d2, known = nearest_in_block(held.column("vec"), asked.column("vec"), k)
        return pa.table([asked.column("id").take(pa.array(i)), held.column("id").take(pa.array(j)), pa.array(d2, mask=~known)], ["query_id", "id", "d2"])

    # twice as many tasks as groups, so that few tasks have several
    dealt = [d.repartition(2 * rows * columns, *cell).groupBy(*cell) for d in (v, q)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(meet, f"query_id {kind[0]}, id {kind[1]}, d2 double").toDF(query_id, id_col, "d2")
    return top_k(found, [query_id], [F.col("d2").asc_nulls_last(), F.col(id_col)], k)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (a matrix of doubles) by the vectors' length, without those that are or hold null."""
    lists = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = lists.flatten(), np.cumsum(size)
    whole = lists.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        whole[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    places = {int(s): np.flatnonzero(whole & (size == s)) for s in np.unique(size[whole])}
    return {s: (at, values[(ends[at] - s)[:, None] + np.arange(s)]) for s, at in places.items()}


def nearest_in_block(vectors: pa.ChunkedArray, queries: pa.ChunkedArray, k: int) -> tuple[np.ndarray, ...]:
    """Place of the query, place of the vector, d2 and whether it is known: the k nearest of each query, ties and unknown distances by the vector's place."""
    held, out = _by_length(vectors), []
    asked = _by_length(queries)
    rest = np.setdiff1d(np.arange(len(queries)), np.concatenate([at for at, _ in asked.values()] or [np.zeros(0, int)]))
    for size, (at, q) in [*asked.items(), (-1, (rest, None))]:
        own = held.get(size, (np.zeros(0, int), np.zeros((0, max(size, 0)))))
        if len(own[0]):
            i, j, d2 = _closest(own[1], q, k)
            out.append((at[i], own[0][j], d2, np.ones(len(i), bool)))
        if len(own[0]) < k:
            unknown = np.setdiff1d(np.arange(len(vectors)), own[0])[: k - len(own[0])]
            n = len(at) * len(unknown)
            out.append((np.repeat(at, len(unknown)), np.tile(unknown, len(at)), np.zeros(n), np.zeros(n, bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _closest(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the vector and d2, summed in order. A matrix product leaves those whose distance, within its error, may be among the k least."""
    if vectors.shape[1] and len(vectors) > k:  # of equal vectors the first k are enough
        _, copy = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(copy, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(copy[order], copy[order])
        place = np.sort(order[nth < k])
    else:
        place = np.arange(len(vectors))
    vectors = vectors[place]
    out = []
    with np.errstate(all="ignore"):
        norms, own = (vectors * vectors).sum(1), (queries * queries).sum(1)
        odd, odd_query = ~np.isfinite(norms), ~np.isfinite(own)
        most = norms[~odd].max(initial=0.0)
        error = 8 * (vectors.shape[1] + 4) * np.finfo(float).eps * (own + most)
        step = max(1, PAIRS_AT_ONCE // max(1, len(vectors)))
        for a in range(0, len(queries), step):
            part = slice(a, a + step)
            near = own[part, None] + norms - 2 * (queries[part] @ vectors.T)
            near[:, odd] = np.inf
            least = np.partition(near, k - 1, axis=1)[:, k - 1] + error[part] if len(vectors) > k else np.full(len(near), np.inf)
            near[:, odd] = -np.inf
            i, j = np.nonzero((near <= least[:, None]) | odd_query[part, None])
            d2 = np.zeros(len(i))
            for b in range(0, len(i), PAIRS_AT_ONCE // 64):
                some = slice(b, b + PAIRS_AT_ONCE // 64)
                gaps = vectors[j[some]] - queries[a + i[some]]
                if gaps.shape[1]:
                    d2[some] = np.cumsum(gaps * gaps, axis=1)[:, -1]
            order = np.lexsort((j, d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((a + i[first], place[j[first]], d2[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def snippet(text: Column, size: int = 280) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, size)


def blended(hits: DataFrame, text_col: str = "text", query_col: str = "query_text", k: int = 10, vector_share: float = 0.7, size: int = 280) -> DataFrame:
    """Candidates (query_id, id, d2, text, query_text) by vector_share / (1 + d2) + the rest times the share of query terms in the snippet."""
    snip = snippet(F.col(text_col), size)
    share = lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.terms(snip))) / F.size(q)).otherwise(F.lit(0.0))
    boost = tx.let(F.array_distinct(tx.terms(F.col(query_col))), share)
    scored = hits.withColumn("lexical", boost).withColumn("score", F.lit(vector_share) / (1 + F.col("d2")) + F.lit(1 - vector_share) * F.col("lexical"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("d2"), F.col("id")], k)


def sparse_search(docs: DataFrame, queries: DataFrame, k: int, candidates: int = 100) -> DataFrame:
    """Squared distances between unit vectors given as sparse rows (id, idx, value) and (query_id, idx, value): 2 - 2 dot.
    Nine decimals, so that equal vectors tie whatever the order of sums. Queries are a stated, counted set: each block of their rows is broadcast, so that documents' rows, dealt by id, stay where they are. Only
    shared components are joined; documents that share none would be at distance 2 and are left out, so a
    query may have fewer rows than asked for."""
    parts = max(1, -(-queries.count() // SPARSE_BLOCK))
    out = None
    for p in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else queries
        dots = docs.join(F.broadcast(own.withColumnRenamed("value", "qv")), "idx").groupBy("query_id", "id").agg(F.sum(F.col("value") * F.col("qv")).alias("dot"))
        d = dots.select("query_id", "id", F.round(2 - 2 * F.col("dot"), 9).alias("d2"))
        found = top_k(d, ["query_id"], [F.col("d2"), F.col("id")], max(k, candidates))
        out = found if out is None else out.unionByName(found)
    return out


def first_answer(results: list[tuple[str, DataFrame]], queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Each query's rows from the first backend that has any, with the backend's name and whether it was a fallback."""
    every = None
    for place, (name, rows) in enumerate(results):
        one = rows.withColumn("backend", F.lit(name)).withColumn("place", F.lit(place))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(query_id).agg(F.min("place").alias("place"))
    return every.join(best, [query_id, "place"]).join(queries.select(query_id), query_id).withColumn("fallback_used", F.col("place") > 0).drop("place")


def outliers(vectors: DataFrame, vec_col: str = "embedding", spread: float = 4.0) -> DataFrame:
    """Vectors whose norm is further from the median than `spread` times the distance of Tukey's hinges; with no distance, any that differs."""
    v = vectors.withColumn("norm", vx.l2_norm(F.col(vec_col)))
    low, median, high = stats.hinge_values(v, "norm")
    gap = F.abs(F.col("norm") - F.lit(median))
    return v.withColumn("outlier", gap > spread * (high - low))

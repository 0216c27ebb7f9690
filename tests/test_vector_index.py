"""The vector index against exact search, on awkward rows and awkward shapes of data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.operators import retrieval, vector_index
from tessellon.plans.session import scratch

SCHEMA = "vec_id long, embedding array<float>, path string, cell string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "p", "c") for i, v in rows], SCHEMA).repartition(parts)


def asked(df):
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def exact(vectors, queries, k):
    d = ((vectors[None].astype(float) - queries[:, None].astype(float)) ** 2).sum(-1)
    return [np.lexsort((np.arange(len(vectors)), row))[:k].tolist() for row in d]


def shapes():
    rng = np.random.default_rng(1)
    yield "one", rng.normal(size=(1, 3))
    yield "two", rng.normal(size=(2, 3))
    yield "cloud", rng.normal(size=(900, 16))
    yield "line", np.arange(700.0)[:, None] * np.ones((1, 2))
    yield "islands", np.concatenate([rng.normal(size=(300, 8)) * 0.01 + 100 * k for k in range(4)])
    yield "steps", rng.integers(0, 5, (800, 4)).astype(float)


@pytest.mark.parametrize("name, x", list(shapes()))
def test_graphs_find_what_is_near(name, x):
    x = np.unique(x.astype(np.float32), axis=0)
    graph = vector_index.Graph.build(x, links=8, candidates=40)
    rng = np.random.default_rng(2)
    queries = np.concatenate([x[rng.integers(0, len(x), 60)], rng.normal(size=(20, x.shape[1])).astype(np.float32) + x[:1]])
    nodes, apart = graph.search(queries, 5, 64)
    want = exact(x, queries, 5)
    far = ((x[None] - queries[:, None]).astype(float) ** 2).sum(-1)
    good = [np.isclose(np.sort(far[q])[: len(w)], a[: len(w)], rtol=1e-3, atol=1e-3).mean() for q, (w, a) in enumerate(zip(want, apart, strict=True))]
    assert np.mean(good) >= 0.98 and (np.sort(apart, axis=1) == apart).all()
    assert (apart[:60, 0] < 1e-3).all()  # every vector finds itself
    assert (nodes[:, len(x) :] == -1).all()


def test_every_node_can_be_reached():
    for _, x in shapes():
        x = np.unique(x.astype(np.float32), axis=0)
        graph = vector_index.Graph.build(x, links=2, candidates=3)
        reached, front = {graph.entry}, [graph.entry]
        while front:
            front = [v for v in {int(w) for u in front for w in graph.layers[0][u] if w >= 0} if v not in reached]
            reached.update(front)
        assert len(reached) == len(x)


@pytest.mark.parametrize("part_rows, probes, least", [(10_000, None, 0.99), (100, None, 0.99), (100, 5, 0.9)])
def test_index_against_exact_search(spark, part_rows, probes, least):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 12)) * 4
    x = (centers[rng.integers(0, 6, 600)] + rng.normal(size=(600, 12))).astype(np.float32)
    df = frame(spark, list(enumerate(x)))
    built = vector_index.build(df, scratch(spark, "index"), part_rows=part_rows)
    index = vector_index.VectorIndex.open(spark, built.folder)
    assert index.manifest.agg(F.sum("rows")).first()[0] == 600 and (index.manifest.count() > 5) == (part_rows == 100)
    queries = asked(df.where("vec_id % 6 = 0"))
    got = vector_index.recall(vector_index.search(index, queries, 10, probes), retrieval.nearest(df, queries, 10), "vec_id").first()
    assert got["queries"] == 100 and got["recall"] >= least
    assert vector_index.round_trip(index, df).first()["error_max"] == 0


def test_cells_enough_for_the_recall(spark):
    x = np.random.default_rng(8).normal(size=(1200, 16)).astype(np.float32)
    df = frame(spark, list(enumerate(x)))
    index = vector_index.build(df, scratch(spark, "index"), part_rows=40)
    queries = asked(df.where("vec_id % 6 = 0"))
    exact = retrieval.nearest(df, queries, 10)
    share = lambda probes: vector_index.recall(vector_index.search(index, queries, 10, probes), exact, "vec_id").first()["recall"]
    assert share(3) < 0.9
    assert share(vector_index.probes_needed(index, df, queries, 10, least=3)) >= 0.95


def test_answers_are_ordered_and_ties_go_by_id(spark):
    rows = [(k, [1.0, 0.0]) for k in (9, 3, 5, 3)] + [(None, [1.0, 0.0]), (7, [2.0, 0.0])]
    index = vector_index.build(frame(spark, rows), scratch(spark, "index"))
    query = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.5])], "query_id string, query_vec array<double>")
    got = [tuple(r) for r in vector_index.search(index, query, 3).orderBy("query_id", "rank").collect()]
    assert [r[1] for r in got if r[0] == "a"] == [None, 3, 3] and [r[:3] for r in got if r[0] == "b"][0] == ("b", 7, 0.25)
    assert index.manifest.first()["distinct_rows"] == 2


def test_unusable_vectors_and_queries(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 2]), (2, [3, 4]), (3, None), (4, []), (5, [1, None]), (6, [nan, 1]), (7, [inf, 1]), (8, [1, 2, 3])]
    df = frame(spark, rows)
    index = vector_index.build(df, scratch(spark, "index"))
    got = vector_index.search(index, asked(df), 5).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_empty_tables(spark):
    none = frame(spark, [])
    index = vector_index.build(none, scratch(spark, "index"))
    assert vector_index.search(index, asked(none), 3).count() == 0
    some = frame(spark, [(1, [1.0, 2.0])])
    assert vector_index.search(index, asked(some), 3).count() == 0
    index = vector_index.build(some, scratch(spark, "index"))
    assert vector_index.search(index, asked(none), 3).count() == 0


def test_many_queries_of_one_part_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TASK_QUERIES", 20)
    x = np.random.default_rng(4).normal(size=(80, 4)).astype(np.float32)
    df = frame(spark, list(enumerate(x)))
    index = vector_index.build(df, scratch(spark, "index"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector_index.search(index, asked(df), 3).collect()}
    assert got == {(q, n + 1): v for q, row in enumerate(exact(x, x, 3)) for n, v in enumerate(row)}


def exchanged(spark):
    """Rows that all stages so far have written for others."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("probes", [None, 40])
def test_a_query_goes_once_to_many_small_parts(spark, probes):
    x = np.random.default_rng(6).normal(size=(1500, 8)).astype(np.float32)
    df = frame(spark, [(k // 2, v) for k, v in enumerate(np.repeat(x, 2, axis=0))])
    index = vector_index.build(df, scratch(spark, "index"), part_rows=40)
    queries = asked(df.where("vec_id % 15 = 0").dropDuplicates(["vec_id"]))
    parts, before = index.manifest.count(), exchanged(spark)
    got = vector_index.search(index, queries, 4, probes).collect()
    assert parts > 60 and len(got) == 400 and exchanged(spark) - before < 3000  # queries by parts were 4,000 rows and more
    if probes is None:
        want = retrieval.nearest(df, queries, 4).collect()
        assert sorted((r["query_id"], r["rank"], r["id"], round(r["d2"], 9)) for r in got) == sorted((r["query_id"], r["rank"], r["vec_id"], round(r["d2"], 9)) for r in want)

"""The lexical index against exact sparse search and brute force; ties, copies, nulls, empty tables, many queries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.functions import vectors as vx
from tessellon.operators import lexical_index, retrieval
from tessellon.plans.session import scratch


def texts(n, seed, words=400):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randint(0, 40))) for _ in range(n)]


def terms():
    return tx.terms(F.col("text"))


def test_components_are_those_of_the_sparse_embedding(spark):
    df = spark.createDataFrame(list(enumerate(["one two two three", "", "one"])), "id long, text string")
    want = {(r["id"], r["idx"]): r["value"] for r in vx.sparse_embedding(df, "id", terms(), 768).collect()}
    rows = lexical_index.dense_rows(df.select(terms().alias("t")).toArrow().column("t").combine_chunks(), lexical_index.Components(768))
    assert {(int(i), int(j)): pytest.approx(rows[i, j]) for i, j in zip(*np.nonzero(rows), strict=True)} == want


@pytest.mark.parametrize("k, block", [(1, 4), (5, 4), (5, 1024), (50, 16), (5000, 8)])
def test_parts_find_the_nearest_and_skip_the_rest(monkeypatch, k, block):
    monkeypatch.setattr(lexical_index, "BLOCK", block)
    rng = np.random.default_rng(k)
    signs = rng.choice([-1, 1], 30)
    rows = rng.random((600, 30)) ** 8 * (rng.random((600, 30)) < 0.3) * signs
    rows[::7] = rows[0]
    rows = rows[rows.any(1)]
    rows /= np.sqrt((rows**2).sum(1))[:, None]
    doc, component = np.nonzero(rows)
    part = lexical_index.Part.of(pa.array(range(len(rows))), doc, component, rows[doc, component], 30)
    skipped = False
    for q in rows[:40]:
        own = np.flatnonzero(q)
        found, d2, read = part.search(own, q[own], k)
        dots = rows @ q
        exact = np.round(2 - 2 * dots, 9)
        order = [i for i in np.lexsort((np.arange(len(rows)), exact)) if dots[i] > 0][:k]
        assert found.tolist() == order and np.allclose(d2, exact[order], atol=2e-9)
        skipped |= read < (part.starts[own + 1] - part.starts[own]).sum()
    assert skipped or k > len(rows) or block > 1000


@pytest.mark.parametrize("part_docs, queries", [(10_000, 1000), (30, 7)])
def test_search_is_that_of_the_sparse_rows(spark, monkeypatch, part_docs, queries):
    monkeypatch.setattr(lexical_index, "QUERIES", queries)
    docs = spark.createDataFrame([*enumerate(texts(200, 1)), (300, None), (301, "")], "id long, text string").repartition(3)
    asked = spark.createDataFrame([*enumerate(texts(20, 2)), (99, None), (100, "wordless unseen")], "query_id long, text string")
    index = lexical_index.build(docs, scratch(spark, "lexical"), terms(), "id", part_docs=part_docs)
    index = lexical_index.LexicalIndex.open(spark, index.folder)
    got = {(r["query_id"], r["rank"]): (r["id"], r["d2"]) for r in lexical_index.search(index, asked, terms(), 10).collect()}
    exact = retrieval.sparse_search(vx.sparse_embedding(docs, "id", terms()), vx.sparse_embedding(asked, "query_id", terms()), 10, 10)
    want = {(r["query_id"], r["rank"]): (r["id"], r["d2"]) for r in exact.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in got)
    assert index.manifest.count() >= (7 if part_docs == 30 else 1)


def test_names_as_ids_copies_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "red blue"), ("a", "red blue"), ("c", "red"), ("c", "red blue"), (None, "red blue")], "chunk string, text string")
    asked = spark.createDataFrame([("q", "red blue")], "query_id string, text string")
    index = lexical_index.build(docs, scratch(spark, "lexical"), terms(), "chunk")
    got = [(r["id"], r["d2"]) for r in lexical_index.search(index, asked, terms(), 4).orderBy("rank").collect()]
    assert got == [(None, 0.0), ("a", 0.0), ("b", 0.0), ("c", 0.0)]
    assert lexical_index.search(index, asked.limit(0), terms(), 4).count() == 0
    none = lexical_index.build(docs.limit(0), scratch(spark, "lexical"), terms(), "chunk")
    assert lexical_index.search(none, asked, terms(), 4).count() == 0

"""Numbering, percentiles, shuffles and draws against plain Python, with groups over several ranges."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessellon.operators import ordering


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def rows_of(seed, n=400):
    rng = random.Random(seed)
    out = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, -0.0, 1.5, float(rng.randint(-5, 5)), rng.random()])) for k in range(n)]
    return [*out, (n, "lone", 2.0), (n + 1, "nothing", None), (n + 2, "pair", 3.0), (n + 3, "pair", -1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_places_within_groups_and_over_all(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    by_group = {r["id"]: r["place"] for r in ordering.placed(df, [F.col("x").desc_nulls_last(), F.col("id")], ["g"]).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [by_group[r[0]] for r in own] == list(range(len(own)))
    everywhere = ordering.placed(df.withColumn("w", F.col("id") % 3), [F.col("id")], weight="w").orderBy("id").collect()
    sofar = 0
    for r in everywhere:
        assert r["place"] == sofar
        sofar += r["w"]


def test_a_group_over_all_ranges(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("g", F.when(F.col("id") < 990, F.lit(1.0)).otherwise(F.lit(float("nan"))))
    got = ordering.placed(df, [F.col("id")], ["g"])
    assert "Window" in plan(got) and got.where("place <> if(id < 990, id, id - 990)").count() == 0
    assert ordering.placed(df.limit(0), [F.col("id")], ["g"]).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_percentiles_by_definition(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(4)
    wanted = {
        "nearest": ordering.nearest_rank(0.9), "floored": ordering.floor_index(0.95), "evened": ordering.even_index(0.5), "upper": ordering.upper_median, "middle": ordering.median, "q1": ordering.lower_hinge, "q3": ordering.upper_hinge,
    }

    def figures(v):
        n, v = len(v), sorted(v)
        if not n:
            return (None,) * 7
        half = n // 2
        hinges = (statistics.median(v[:half]), statistics.median(v[n - half :])) if half else (None, None)
        return (v[math.ceil(0.9 * n) - 1], v[int(0.95 * (n - 1))], v[round(0.5 * (n - 1))], v[n // 2], statistics.median(v), *hinges)

    found = ordering.percentiles(df, "x", wanted, ["g"])
    got = {r["g"]: tuple(r)[1:] for r in found.collect()}
    assert got == {g: figures([r[2] for r in rows if r[1] == g and r[2] is not None]) for g in {r[1] for r in rows}}
    assert "collect" not in plan(found)
    assert [tuple(r) for r in ordering.percentiles(df, "x", wanted).collect()] == [figures([r[2] for r in rows if r[2] is not None])]
    assert [tuple(r) for r in ordering.percentiles(df.limit(0), "x", wanted).collect()] == [(None,) * 7]


def test_shuffles_draws_and_deals(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    digest = lambda k: hashlib.sha1(f"42/{k}".encode()).hexdigest()
    assert [r["k"] for r in ordering.shuffled(df, "k").orderBy("place").collect()] == sorted(range(50), key=digest)
    want = [(d, int(digest(d)[:12], 16) % 50) for d in range(80)]
    draws = ordering.with_replacement(df, "k", 80)
    assert sorted((r["draw"], r["k"]) for r in draws.collect()) == want
    assert ordering.with_replacement(df.limit(0), "k", 5).columns == ["draw", "k"]
    dealt = ordering.round_robin(df, [F.col("k").desc()], ["a", "b", "c"], "who").collect()
    assert {r["k"]: r["who"] for r in dealt} == {k: "abc"[(49 - k) % 3] for k in range(50)}

"""Versioned tables and packed files."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellon.plans import catalog
from tessellon.plans.session import scratch
from tessellon.sources import versions, writers


SCHEMA = "k long, v string, tags array<long>"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def first(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 3 > 0, F.array("id")).alias("tags"))
    table = versions.VersionedTable(spark, scratch(spark, "versions"), "k", 8)
    assert table.version() is None and table.versions() == []
    made = table.write(df)
    assert made.number == 1 and made.written == list(range(8))
    return table, df


def test_update_writes_the_touched_part_alone(spark, first):
    table, df = first
    assert table.update(df).number == 1 and table.versions() == [1]  # nothing has changed
    changed = df.withColumn("v", F.when(F.col("k") == 5, "new").otherwise(F.col("v")))
    made = table.update(changed)
    assert made.number == 2 and len(made.written) == 1
    untouched = set(range(8)) - set(made.written)
    old = table.version(1)
    assert all(made.parts[p] == old.parts[p] for p in untouched)
    assert rows_of(table.read()) == rows_of(changed) and rows_of(table.read(1)) == rows_of(df)
    more = spark.createDataFrame([(1000, None, None), (6, "six", [6])], SCHEMA)
    assert len(table.update(more).written) in (1, 2) and table.read().count() == 201 and table.read().where("k = 6").first()["v"] == "six"
    assert [r["v"] for r in table.read().where("k = 1000").collect()] == [None]
    assert table.update(more).number == 3


def test_nulls_can_keep_what_was_there(spark, first):
    table, df = first
    some = spark.createDataFrame([(1, None), (2, "two"), (999, "new")], "k long, v string")
    made = table.update(some, keep_old_for_null=True)
    got = {r["k"]: (r["v"], r["tags"]) for r in table.read().where("k in (1, 2, 999)").collect()}
    assert made.number == 2 and got == {1: ("v1", [1]), 2: ("two", [2]), 999: ("new", None)}


def test_remove_and_roll_back(spark, first):
    table, df = first
    gone = df.where("k % 2 = 0").select("k")
    table.remove(gone)
    assert rows_of(table.read()) == rows_of(df.where("k % 2 = 1")) and rows_of(table.read(1)) == rows_of(df)
    assert table.remove(gone).number == 2  # they are gone already
    table.remove(df.select("k"))
    assert table.read().count() == 0 and table.read().columns == df.columns
    back = table.roll_back(1)
    assert back.number == 4 and back.written == [] and rows_of(table.read()) == rows_of(df)
    with pytest.raises(KeyError):
        table.read(9)


def test_two_writers_and_what_an_attempt_leaves(spark, first):
    table, df = first
    before = table.version()
    table.update(spark.createDataFrame([(1, "a", None)], SCHEMA))
    with pytest.raises(versions.Conflict):
        table._put(table._marked(df), range(8), before, before.schema)
    assert table.versions() == [1, 2] and table.read().where("k = 1").first()["v"] == "a"
    assert not any(n.startswith(".") and not n.endswith(".crc") for n in os.listdir(table.folder.removeprefix("file:") + "/versions"))


def test_expire(spark, first):
    table, df = first
    for k in range(3):
        table.update(spark.createDataFrame([(k, "x", None)], SCHEMA))
    want = rows_of(table.read())
    assert table.expire(2) == [1, 2] and table.versions() == [3, 4] and rows_of(table.read()) == want and table.read(3).count() == 200
    assert table.expire(2) == []


def test_keys_are_unique(spark):
    table = versions.VersionedTable(spark, scratch(spark, "versions"), "k", 2)
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="unique key"):
            table.write(spark.createDataFrame(rows, "k long, v string"))
    assert table.versions() == []
    empty = spark.createDataFrame([], "k long, v string")
    assert table.write(empty).parts == {} and table.read().count() == 0


def test_many_keys_in_a_file(spark):
    df = spark.range(600).select((F.col("id") % 97).alias("doc"), F.col("id").alias("seq"), F.repeat(F.lit("x"), F.when(F.col("id") == 5, 5000).otherwise(40)).alias("text"), F.lit(None).cast("string").alias("none"))
    folder = scratch(spark, "packed")
    manifest = writers.packed_json_lines(df, "doc", folder, 4000, "seq")
    sizes = {r["file"]: r["b"] for r in manifest.groupBy("file").agg(F.sum("bytes").alias("b")).collect()}
    largest = manifest.orderBy(F.desc("bytes")).first()
    assert largest["key"] == 5 and len(sizes) > 5 and all(b < 8000 for f, b in sizes.items() if f != largest["file"])
    for path, size in sizes.items():
        here = path.removeprefix("file:")
        files = [f for f in os.listdir(here) if f.startswith("part-")]
        assert len(files) == 1 and os.path.getsize(f"{here}/{files[0]}") == size
    schema = "doc long, seq long, text string, none string"
    got = writers.read_packed(spark, folder, schema, "doc", [5, 50])
    assert rows_of(got.select("doc", "seq")) == rows_of(df.where("doc in (5, 50)").select("doc", "seq")) and len(got.inputFiles()) <= 2
    assert writers.read_packed(spark, folder, schema, "doc", [1000]).count() == 0
    lines = spark.read.text(largest["file"]).collect()
    assert '"none":null' in lines[0][0]


@pytest.mark.parametrize("first", [12.5, None])
def test_one_balance_changes_and_zeros_keep_their_sign(spark, tmp_path, first):
    rows = [(k, f"c{k}", first if k == 0 else -0.0 if k % 3 else 0.25 * k) for k in range(100)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["versioned_update"]).fetchall()
    assert rows_of(catalog.versioned_update(spark, str(tmp_path))) == sorted(want)

"""Every query against its SQL twin on the smallest tables, and the flagship entry."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    rows = [[r[names.index(c)] for c in cols] for r in want.fetchall()]
    assert ordered(df.select(cols).collect()) == ordered(rows)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"id_a", "id_b", "jaccard"}


def test_rows_only(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            df = entry.queries()[name](spark, SF)
            rows = df.collect()
            assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows), name


@pytest.mark.parametrize("name", ["diversity_merge", "fallback_answers"])
def test_hits_are_searched_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "embedding" not in plan


def test_distant_chunks_are_compared_once(spark):
    plan = entry.queries()["nonadjacent_p95"](spark, SF)._jdf.queryExecution().toString()
    assert "regexp" not in plan

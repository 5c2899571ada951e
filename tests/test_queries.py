"""Every query that has SQL gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from fringework.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_no_nested_loops(spark):
    for name in sorted(n for n in QUERIES if not n.startswith("stream_")):
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_columns_are_pruned(spark):
    plan = QUERIES["xengine_tri"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_narrow_floats_have_the_signs_of_sql(spark, tmp_path):
    """A value of 0 gives zero, not minus zero; what is rounded to nothing from below keeps its sign in both."""
    v = [0.0, -0.0, 0.01, 0.02, 199.99, 200.0, 200.01, 350.0, 560.21, 4000.0, -3.5, None]
    spark.createDataFrame(list(enumerate(v)), "event_id bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["narrow_floats"])
    names = [c[0] for c in want.description]
    got = QUERIES["narrow_floats"](spark, str(tmp_path)).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_stream_dedisp_of_beams_over_several_files(spark, duck, tmp_path):
    """Files of ten vectors, four in a micro-batch: beams of 16 vectors lie in two batches."""
    (tmp_path / "embeddings.parquet").mkdir()
    for k in range(12):
        duck.execute(f"COPY (SELECT * FROM embeddings WHERE vec_id BETWEEN {10 * k} AND {10 * k + 9}) TO '{tmp_path}/embeddings.parquet/part-{k:04d}.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["stream_dedisp"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES["stream_dedisp"](spark, str(tmp_path)).select(names).collect())) == sorted(want.fetchall())

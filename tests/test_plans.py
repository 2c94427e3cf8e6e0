"""Every named query against its SQL on the smallest tables."""

import math
import os

import pytest

from quillgraph.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(row):
    return repr(tuple(("nan" if math.isnan(x) else f"{x:.6g}") if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(plain, df.select(*columns).collect())) == sorted(map(plain, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "item_id", "n", "first_pos"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_push_down(spark):
    plan = QUERIES["pricing_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    scan = next(x for x in plan.split("\n") if "ReadSchema" in x)
    assert "l_orderkey" not in scan.split("ReadSchema")[1] and "l_comment" not in scan

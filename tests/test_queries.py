"""Every query with SQL, over whole tables, against DuckDB; the others must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in sorted(os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    return c


CORE = sorted({n for m in (entry.queries_data, entry.queries_graph) for n in m.QUERIES})


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        assert mine == rows_of([c[0] for c in rel.description], rel.fetchall())
    else:
        assert mine[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_descendant_rows_agree_with_counts(spark):
    queries = entry.queries()
    rows = queries["p1_descendant_rows"](spark, FOLDER).groupBy("graph_id", "ancestor").count().collect()
    counts = queries["p1_descendants"](spark, FOLDER).filter("descendants > 0").collect()
    assert {(r["graph_id"], r["ancestor"], r["count"]) for r in rows} == {(r["graph_id"], r["node"], r["descendants"]) for r in counts}

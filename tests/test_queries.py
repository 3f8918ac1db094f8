"""Every query with SQL gives DuckDB's rows on the smallest tables; every other query runs."""

from __future__ import annotations

import duckdb
import pytest

from newsdesk import plans
from tools.compare import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in plans.ORACLES:
        out = db.execute(plans.ORACLES[name])
        assert got == rows([c[0] for c in out.description], out.fetchall())
    else:
        assert got[0]


@pytest.mark.parametrize("name", ["near_duplicate_pairs", "timed_similar_parts", "similar_parts", "phrase_links", "alias_link"])
def test_similarity_plans_have_no_cross_join(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

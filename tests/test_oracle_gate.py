"""Every registered query against its DuckDB oracle at sf0.001 (the driver's gate, smaller)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan  # no cross joins
    srows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, srows) == rows_of(ocols, res.fetchall())


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() >= 0 and "optimized_context" in out.columns

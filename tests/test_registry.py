"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from patchloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(frame, columns):
    def text(v):
        return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    found = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    expected = con.sql(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found, sorted(found.columns)) == rows(expected, sorted(found.columns))


def test_plans_prune_columns_and_keep_no_python(spark):
    plan = registry.queries()["hash_stats_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert "l_shipdate" not in plan and "l_comment" not in plan

"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tests.conftest import DATA, plan_of
from tools.check_oracles import TABLES, compare
from twinproof.registry import all_queries, all_sql


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_its_sql(spark, con, name):
    answer = all_queries()[name](spark, DATA)
    plan = plan_of(answer)
    # Nothing compares all with all, and no row passes through Python.
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"))
    took, text, ok = compare(spark, con, DATA, name, lambda *_: answer, all_sql().get(name))
    assert ok, text


def test_only_queries_without_a_sql_form_lack_one():
    # The claims report joins five checks that each have their own.
    assert set(all_queries()) - set(all_sql()) == {"verify_claims"}


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

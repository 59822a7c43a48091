"""Every query against its SQL on the smallest tables, and what plans must not contain."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# No Python in the plan, no cross or nested-loop join, no rows from the driver.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoop", "PythonUDF", "EvalPython", "ExistingRDD")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF)
    if sql is not None:
        plan = explained(df)
        # The stop-word table comes from the driver.
        allowed = {"ExistingRDD"} if name == "stopword_filter" else set()
        assert [w for w in UNWANTED if w in plan and w not in allowed] == []
    ok, note = compare(spark, con, name, SF, lambda *_: df, sql)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["window_end", "keyword_text", "mentions"]


def explained(df):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_the_time_range_reaches_the_scan(spark):
    plan = explained(entry.queries()["time_range_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_only_needed_columns_are_read(spark):
    plan = explained(entry.queries()["keyword_rollup"](spark, SF))
    schemas = sorted(line.strip() for line in plan.splitlines() if "ReadSchema" in line)
    assert schemas == [
        "ReadSchema: struct<doc_id:bigint,text:string>",
        "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>",
    ]

"""Every registered query against its SQL twin on the smallest tables, and the plans of some."""

import contextlib
import io
import os
import sys
from pathlib import Path

import pytest

from tidemill.plans.registry import all_queries, all_sql

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_oracle import TABLES, canon  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("stream_", "rf_")  # their plans are covered by their own tests
QUICK = [n for n in all_queries() if not n.startswith(SLOW)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, duck, name):
    got = all_queries()[name](spark, SF_DIR).toPandas()
    if name not in all_sql():
        assert len(got) > 0
        return
    want = duck.execute(all_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_sql_text_belongs_to_a_query():
    assert set(all_sql()) <= set(all_queries())


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", QUICK)
def test_no_cross_join_in_any_plan(spark, name):
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["retention_expired", "top_values", "duplicate_keys"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") >= 2


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(all_queries()["orphan_rows"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "Not(EqualTo(c_mktsegment,MACHINERY))" in plan

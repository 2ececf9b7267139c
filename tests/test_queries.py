"""Driver queries against their DuckDB oracles on the smallest tables, plus
plan checks (SURVEY section 5, items 1 and 5)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
SUBSET = ["row_ordinal", "range_list", "col_letters", "cells_update", "mixed_batch", "mixed_touched",
          "modified_cells", "profile_types", "stacked_split", "history_replay", "sessionize", "tag_rewrite",
          "selection_roundtrip", "csv_roundtrip", "code_block", "retention"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    sc, sv = digest(df.columns, [tuple(r) for r in df.collect()])
    oc, ov = digest([d[0] for d in res.description], res.fetchall())
    assert sc == oc
    assert sv == ov


def test_every_query_has_an_oracle():
    """The library's own queries; those of the text operators are tested by brute force."""
    from gridframe.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ["mixed_batch", "modified_cells", "profile_samples", "sessionize", "blank_rows"])
def test_plans_have_no_nested_loops_or_python(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan
    # The first values of columns pass one Arrow function; nothing else leaves the JVM.
    python = {"BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"} - ({"MapInArrow"} if name == "profile_samples" else set())
    assert not any(node in plan for node in python)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["_row", "o_custkey", "o_orderstatus", "o_totalprice"]
    assert df.count() > 0

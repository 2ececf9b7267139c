"""First values of each column in one pass."""

import math
import random

import pytest

from gridframe.operators import profile
from gridframe.sheet import Sheet

SCHEMA = "_row long, n int, x double, t string, ts timestamp_ntz, none string"


def table(n, seed):
    r = random.Random(seed)
    cell = lambda v, gap: None if r.random() < gap else v
    return [(i, cell(i * 3, 0.7), r.choice([None, math.nan, i / 4]), cell(r.choice(["", "a,b", "ü"]), 0.5), None, None)
            for i in range(n)]


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_first_values_for_any_order_of_rows(spark, order, k):
    rows = table(400, 3)
    moved = {"forward": rows, "backward": rows[::-1], "mixed": random.Random(5).sample(rows, len(rows))}[order]
    df = spark.createDataFrame(moved, SCHEMA).repartition(3)
    got = {(r.position, r.rank): (r.row, r.value) for r in profile.sample_values(Sheet(df), k).collect()}
    want = {}
    for c in range(5):
        held = [r for r in rows if r[c + 1] is not None and r[c + 1] == r[c + 1]][:k]
        want |= {(c, i + 1): (r[0], str(r[c + 1])) for i, r in enumerate(held)}
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert {x: v[1] for x, v in got.items()} == {x: v[1] for x, v in want.items()}


def test_nothing_and_no_columns(spark):
    assert profile.sample_values(Sheet(spark.createDataFrame([], SCHEMA))).collect() == []
    assert profile.sample_values(Sheet(spark.createDataFrame([(0,), (1,)], "_row long"))).collect() == []
    odd = Sheet(spark.createDataFrame([(0, None, [1]), (1, "v", None)], "_row long, `a.b` string, `row` array<int>"))
    assert {(r.position, r.row, r.value) for r in profile.sample_values(odd).collect()} == {(0, 1, "v"), (1, 0, "[1]")}


def test_few_candidates_and_one_scan(spark, tmp_path):
    n = 50_000
    spark.range(n).selectExpr("id AS _row", "id AS a", "if(id % 1000 = 999, 'x', null) AS b").coalesce(2).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    kept = profile.first_candidates(df, "_row", 3)
    assert kept.count() <= 40
    assert sorted(r._row for r in kept.where("b is not null").collect())[:3] == [999, 1999, 2999]
    plan = profile.sample_values(Sheet(df))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan parquet") == 1 and "WindowGroupLimit" in plan

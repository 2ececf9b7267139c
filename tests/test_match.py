"""Matching of columns by name and content."""

from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.operators import conform, match


def most(score):
    """Greatest total by trying every assignment; rows may stay alone."""
    n, m = score.shape
    wide = np.hstack([score, np.zeros((n, n))])
    return max((sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(m + n), n)), default=0.0)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.randoms(use_true_random=False))
def test_assignment_is_the_best_of_all(n, m, r):
    score = np.array([[r.choice([0, 0.25, 0.5, 1, r.random()]) for _ in range(m)] for _ in range(n)], float).reshape(n, m)
    got = match.best_assignment(score)
    used = [int(j) for j in got if j >= 0]
    assert len(got) == n and len(set(used)) == len(used)
    assert abs(sum(score[i, j] for i, j in enumerate(got) if j >= 0) - most(score)) < 1e-9


def test_a_greedy_choice_is_not_the_best():
    assert match.best_assignment(np.array([[0.9, 0.8], [0.85, 0.1]])).tolist() == [1, 0]


def stack(sheet_of):
    rows = [("id", "state", "price")]
    rows += [(str(i), "AB"[i % 2], f"{i * 7}.25") for i in range(20)]
    rows += [(None,) * 3, ("cost", "ident", "mode")]
    rows += [(f"{i * 9}.75", str(i), "AB"[i % 2]) for i in range(20, 40)]
    rows += [(None,) * 3, ("state", "id", None)]
    rows += [("B", str(i), None) for i in range(40, 60)]
    rows += [(None,) * 3, ("day", "remark", "who")]
    rows += [(f"2020-01-{i + 1:02d}", "a long remark about nothing", "somebody") for i in range(20)]
    return sheet_of(rows, "c0 string, c1 string, c2 string")


def test_renamed_reordered_and_missing_columns(sheet_of):
    split = conform.split_stacked(stack(sheet_of))
    got = {r.table_id: r for r in match.match_tables(split, ["c0", "c1", "c2"], 0).collect()}
    assert [p.name for p in got[0].pairs] == ["id", "state", "price"] and got[0].likeness == 1.0
    assert [p.name for p in got[1].pairs] == ["ident", "mode", "cost"]
    assert [p.position for p in got[2].pairs] == [1, 0, None]
    assert [got[t].similar for t in range(4)] == [True, True, True, False]
    target = [("price", "float"), ("id", "integer"), ("absent", "string")]
    rows = match.unite_matched(split, ["c0", "c1", "c2"], 0, target).collect()
    by = {(r.table_id, r._row): (r.price, r.id, r.absent) for r in rows}
    assert len(rows) == len(by) == 60
    assert by[0, 3] == (21.25, 3, None) and by[1, 0] == (180.75, 20, None) and by[2, 19] == (None, 59, None)


def test_values_outweigh_misleading_order(sheet_of):
    a = sheet_of([(f"N{i}", f"K{i % 5}") for i in range(30)], "x string, y string")
    b = sheet_of([(f"K{i % 5}", f"N{i}") for i in range(30)], "u string, v string")
    assert match.column_mapping(a, b) == {"u": "y", "v": "x"}


def test_nulls_blanks_and_nothing(spark, sheet_of):
    empty = sheet_of([(None, " ", None)] * 3, "name string, o_key string, n double")
    full = sheet_of([("a", "1", 1.5), ("b", "2", 2.5)], "name string, c_key string, other double")
    rows = {(r.target_name, r.source_name): r.status for r in match.compare_matched(empty, full).collect()}
    # Columns without values go by their names alone.
    assert rows == {("name", "name"): "matched", ("c_key", "o_key"): "matched", ("other", None): "missing", (None, "n"): "extra"}
    none = spark.createDataFrame([], "table_id long, header array<string>, c0 string")
    assert match.match_tables(none, ["c0"], 0).count() == 0
    bare = spark.createDataFrame([(0, None, None), (1, [None], "5")], "table_id long, header array<string>, c0 string")
    assert {r.table_id: r.similar for r in match.match_tables(bare, ["c0"], 0).collect()} == {0: False, 1: False}
    assert match.match_tables(bare, ["c0"], 7).count() == 0


def test_typed_sheets_and_odd_names(spark, sheet_of):
    s = sheet_of([(1, True, 2.0)], "`a.b` int, `c``d` boolean, e double")
    got = match.compare_matched(s, s).select("target_name", "source_name", "score").collect()
    assert sorted((r.target_name, r.source_name, r.score) for r in got) == [("a.b", "a.b", 1.0), ("c`d", "c`d", 1.0), ("e", "e", 1.0)]


def test_a_hot_table_is_reduced_before_it_moves(spark, sheet_of):
    plan = match.match_tables(conform.split_stacked(stack(sheet_of)), ["c0", "c1", "c2"], 0)._jdf.queryExecution().toString()
    assert "partial_theta_sketch_agg" in plan and "BroadcastNestedLoopJoin" in plan

import random

import pytest

from gridframe.operators.history import replay

LOG = "sheet_id long, seq long, action string"


def by_hand(log):
    out, state = [], {}
    for sheet, seq, action in sorted(log):
        pos, length, shown = state.get(sheet, (-1, 0, {}))
        if action == "commit":
            pos, length = pos + 1, pos + 2
            shown = {p: s for p, s in shown.items() if p < pos} | {pos: seq}
        elif action == "undo" and pos > 0:
            pos -= 1
        elif action == "redo" and pos < length - 1:
            pos += 1
        state[sheet] = (pos, length, shown)
        out.append((sheet, seq, action, pos, length, pos > 0, pos < length - 1, shown.get(pos)))
    return out


def logs(seed, n, weights):
    r = random.Random(seed)
    kinds = ["commit", "undo", "redo", "note", None]
    # One sheet holds most of the log; seqs have gaps.
    return [(0 if r.random() < 0.6 else r.randint(1, 5), 3 * i + 1, r.choices(kinds, weights)[0]) for i in range(n)]


@pytest.mark.parametrize("weights", [(5, 2, 2, 1, 1), (1, 6, 5, 0, 0), (2, 9, 1, 0, 0), (1, 30, 30, 0, 1), (0, 1, 1, 0, 0)])
def test_runs_of_any_length_give_the_same_states(spark, weights):
    log = logs(sum(weights), 260, weights)
    df = spark.createDataFrame(log, LOG).repartition(3)
    want = sorted(by_hand([(a, b, c or "") for a, b, c in log]))
    for run, group in ((2, 4), (7, 5), (256, 256)):
        got = sorted((tuple(x) for x in replay(df, run, group).collect()), key=lambda x: x[:2])
        assert [(*x[:2], x[2] or "", *x[3:]) for x in got] == want, (run, group)


def test_replay_has_no_python_and_splits_a_sheet(spark):
    log = spark.range(4000).selectExpr("1L as sheet_id", "id as seq", "case when id % 3 = 0 then 'undo' else 'commit' end as action")
    out = replay(log)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
    last = out.orderBy("seq").tail(1)[0]
    assert (last.pos, last.len) == (1332, 1334)
    assert replay(log.limit(0)).collect() == []
    with pytest.raises(ValueError):
        replay(log, 2, 3)


def test_versions_store_changes_and_read_back(spark, sheet_of, tmp_path):
    from pyspark.sql import functions as F

    from gridframe.operators.history import VersionLog

    r = random.Random(2)
    rows = [(i, f"v{i}" if i % 3 else None) for i in range(300)]
    log = VersionLog(spark, str(tmp_path / "log"), chain=3)
    kept = []
    for v in range(6):
        log.commit(sheet_of(rows, "a long, b string"))
        kept.append(list(rows))
        rows = rows[: len(rows) - r.randint(0, 5)] if v % 2 else rows + [(1000 + v, None)] * 2
        rows[r.randrange(len(rows))] = (v, None)
    for v in (4, 3, 2, 1, 0):
        assert [tuple(x)[1:] for x in log.undo().df.orderBy("_row").collect()] == kept[v], v
    assert log.undo() is None and log.redo().n_rows == len(kept[1])
    stored = spark.read.parquet(f"{log.path}/versions").groupBy("version").agg(F.count("*").alias("n")).collect()
    n = {x["version"]: x["n"] for x in stored}
    assert n[0] > 250 and n[4] > 250 and all(n[v] < 20 for v in (1, 2, 3, 5))  # every fourth one is whole

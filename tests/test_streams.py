import datetime as dt

from gridframe.streaming.edits import current_cells, merge_batch, run_edit_stream
from gridframe.streaming.sessions import run_session_stream

T0 = dt.datetime(2024, 1, 1)


def accesses(spark, path, rows):
    df = spark.createDataFrame([(s, str(T0 + dt.timedelta(minutes=m))) for s, m in rows], "session_id bigint, ts string")
    df.selectExpr("session_id", "cast(ts as timestamp_ntz) as ts").coalesce(1).write.mode("append").parquet(path)


def test_files_out_of_time_order_lose_nothing(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(u, m) for u in range(5) for m in (0, 10, 50, 200, 230, 900)]
    for k in range(8):
        accesses(spark, src, rows[k::8][::-1])
    got = run_session_stream(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), delay="0 seconds").collect()
    # The sessions of minutes 0-50 and 200-230 are closed; those at 900 are still open.
    assert sorted((r.session_id, r.accesses) for r in got) == [(u, n) for u in range(5) for n in (2, 3)]


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_late_accesses_correct_closed_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    args = (spark, src, str(tmp_path / "out"), str(tmp_path / "ck"))

    def at(m):
        return T0 + dt.timedelta(minutes=m)

    accesses(spark, src, [(1, 0), (1, 100), (2, 0)])
    run_session_stream(*args, delay="1 minute")
    accesses(spark, src, [(1, 5000)])
    first = result(run_session_stream(*args, delay="1 minute"))
    assert first == [(1, at(0), at(0), 1), (1, at(100), at(100), 1), (2, at(0), at(0), 1)]
    # Late: joins user 1's closed sessions, exactly the timeout apart, and starts one of user 3.
    accesses(spark, src, [(1, 50), (3, 7), (2, 60)])
    want = [(1, at(0), at(100), 3), (2, at(0), at(60), 2), (3, at(7), at(7), 1)]
    for _ in range(2):  # the second run has nothing new and returns no less
        assert result(run_session_stream(*args, delay="1 minute")) == want


def test_any_split_into_batches_gives_the_batch_answer(spark, tmp_path):
    import random

    from gridframe.operators.logs import sessionize
    from gridframe.streaming.sessions import stored_sessions

    r = random.Random(5)
    rows = [(0 if r.random() < 0.5 else r.randint(1, 4), r.randint(0, 4000)) for _ in range(300)]
    src = str(tmp_path / "src")
    for k in range(5):
        accesses(spark, src, rows[k::5])
    run_session_stream(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), delay="0 seconds", max_files=1)
    whole = sessionize(spark.read.schema("session_id bigint, ts timestamp_ntz").parquet(src))
    assert result(stored_sessions(spark, str(tmp_path / "out"))) == result(whole)


def edits(spark, rows):
    return spark.createDataFrame(rows, "sheet_id bigint, seq bigint, row bigint, col bigint, value string")


def cells(df):
    return {(r.row, r.col): (r.seq, r.value) for r in df.collect()}


def test_edit_batches_merge_replay_and_touch_only_their_buckets(spark, tmp_path):
    base = str(tmp_path / "cells")
    merge_batch(edits(spark, [(0, r - 100, r, 0, f"a{r}") for r in range(40)]), 0, base)
    first = {p: p.stat().st_mtime_ns for p in tmp_path.glob("cells/cells/*/*/part*")}
    for _ in range(2):  # the second run replays the batch
        merge_batch(edits(spark, [(0, 5, 3, 0, "b"), (0, -300, 4, 0, "stale"), (0, 5, 3, 0, "b"), (0, 6, 99, 1, None)]), 1, base)
        got = cells(current_cells(spark, base))
        assert got[3, 0] == (5, "b") and got[4, 0] == (-96, "a4") and got[99, 1] == (6, None) and len(got) == 41
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in first.items())
    assert cells(current_cells(spark, base, before=1))[3, 0] == (-97, "a3")
    merge_batch(edits(spark, []), 2, base)
    merge_batch(edits(spark, [(0, 9, 3, 0, "c")]), 3, base)
    assert cells(current_cells(spark, base))[3, 0] == (9, "c") and len(cells(current_cells(spark, base))) == 41
    assert len(list(tmp_path.glob("cells/manifest/turn=*"))) == 2


def test_buckets_follow_the_cells_and_grow_without_losing_versions(spark, tmp_path, monkeypatch):
    from gridframe.streaming import edits as stream

    monkeypatch.setattr(stream, "CELLS_PER_BUCKET", 2)
    monkeypatch.setattr(stream, "MIN_BUCKETS", 2)
    assert stream.buckets_for(16, None) == 8 and stream.buckets_for(17, 8) == 8 and stream.buckets_for(40, 8) == 32
    base, want, seq, sizes = str(tmp_path / "cells"), {}, 0, []
    for batch, n in enumerate((4, 60, 5)):
        rows = []
        for k in range(n):
            seq += 1
            row, col = (k * 7 + batch) % (1 + 2 * n), k % 3
            rows.append((0, seq, row, col, f"v{seq}"))
            want[row, col] = (seq, f"v{seq}")
        before = cells(stream.current_cells(spark, base)) if batch else None
        for _ in range(2):  # the second run replays the batch, also one that grows
            merge_batch(edits(spark, rows), batch, base)
            assert cells(stream.current_cells(spark, base)) == want
            if batch:
                assert cells(stream.current_cells(spark, base, before=batch)) == before
        buckets, held = stream._manifest(spark, base, None)
        assert sum(c for _, c in held.values()) == len(want) and max(held) < buckets
        sizes.append(buckets)
    assert sizes[0] == 2 and sizes[1] >= 16 and sizes[2] == sizes[1]


def test_edit_stream_drains_files(spark, tmp_path):
    src = str(tmp_path / "src")
    for k in range(4):
        edits(spark, [(0, s, s % 7, s % 3, f"v{s}") for s in range(k, 100, 4)]).coalesce(1).write.mode("append").parquet(src)
    got = cells(run_edit_stream(spark, src, str(tmp_path / "c"), str(tmp_path / "k"), max_files=1))
    want = {}
    for s in range(100):
        want[s % 7, s % 3] = (s, f"v{s}")
    assert got == want

import random

import pytest
from pyspark.sql import functions as F

from gridframe.operators import address, clean, conform, diff, history, logs, profile
from gridframe.sheet import Sheet


def test_diff_rules(spark, sheet_of):
    old = sheet_of([(1, "a", 1.0), (2, None, 2.0), (3, "c", None)], "i long, s string, d double")
    assert diff.modified_cells(old, old).count() == 0  # D1(x, x) is empty
    new = Sheet(old.df.where("_row < 2").select(
        "_row", F.col("i").cast("double").alias("i"), F.when(F.col("_row") == 0, "z").otherwise(F.col("s")).alias("s"),
        F.lit(5).alias("n")))
    got = sorted(tuple(r) for r in diff.modified_cells(old, new).collect())
    assert got == [(0, 1), (0, 2), (1, 2)]


def test_diff_is_exact(spark, sheet_of):
    big = 9007199254740992
    one = lambda v, t: sheet_of([(v,)], f"x {t}")
    pairs = [(big, "long", big + 1, "long", 1), (big, "long", float(big), "double", 0), (big + 1, "long", float(big), "double", 1),
             (2, "long", 2.5, "double", 1), (3, "long", 3.0, "double", 0), (True, "boolean", 1, "long", 0),
             (5, "long", float("inf"), "double", 1), (2**63 - 1, "long", float(2**63), "double", 1)]
    for a, ta, b, tb, n in pairs:
        assert diff.modified_cells(one(a, ta), one(b, tb)).count() == n, (a, b)


def test_names_with_dots_and_backticks(spark, sheet_of):
    s = sheet_of([("k", "v"), ("1", "a"), (None, None), ("K", "V"), ("2", "b")], "x string, y string")
    s = Sheet(s.df.toDF("_row", "a.1", "b`c"))
    assert clean.drop_blank_rows(s).columns == ["a.1", "b`c"]
    assert s.reindexed().columns == ["a.1", "b`c"]
    n = Sheet(s.df.selectExpr("_row", "_row as `a.1`", "_row as `b``c`"))
    from gridframe.operators import edits

    assert [r["s"] for r in edits.derived_sum(n, "a.1", "B", "s").df.orderBy("_row").collect()] == [0, 2, 4, 6, 8]
    assert "a.1" in profile.profile_document(s).first()[0]
    assert profile.sample_values(s).count() == 6 and address.cell_listing(s).count() == 2 + 5 + 10
    assert conform.split_stacked(s).columns[-2:] == ["a.1", "b`c"]


def test_decimal_profile_and_falsy_previews(spark, sheet_of):
    from decimal import Decimal

    s = sheet_of([(Decimal("1.00"), 0, False, 0.0), (Decimal("2.50"), 7, True, 1.5)],
                 "m decimal(10,2), i int, b boolean, d double")
    assert {r.name: r.type for r in profile.column_types_df(s).collect()} == {"m": "float", "i": "integer", "b": "integer", "d": "float"}
    cells = {r.text: r.description for r in address.cell_listing(s).where("kind = 2").collect()}
    assert [cells[x] for x in ("B1", "C1", "D1", "B2", "C2")] == ["Cell B1", "Cell C1", "Cell D1", "Cell B2: 7", "Cell C2: true"]


def test_blank_rows_cols_and_examples(spark, sheet_of):
    s = sheet_of([("a", None, None), ("  ", None, None), (None, None, None), ("327-049224", "x y", None)],
                 "p string, q string, r string")
    kept = clean.drop_blank_rows(s)
    assert [r["p"] for r in kept.df.orderBy("_row").collect()] == ["a", "327-049224"]
    assert clean.drop_blank_cols(s).columns == ["p", "q"]
    ex = clean.keep_rows_by_example(s, ["111-222", "Other assets"])
    assert [r["_row"] for r in ex.df.collect()] == [0]
    iso = clean.iso_to_date(sheet_of([("2023-01-01T00:00:00",), ("2023-01-01",)], "t string"))
    assert [r["t"] for r in iso.df.orderBy("_row").collect()] == ["2023-01-01", "2023-01-01"]


def test_profile_types_and_doc(spark, sheet_of):
    s = sheet_of([(1, 1.0, 2.5, True, None, "x"), (2, 3.0, float("nan"), False, None, None)],
                 "i long, fi double, f double, b boolean, u string, t string")
    types = {r.name: r.type for r in profile.column_types_df(s).collect()}
    assert types == {"i": "integer", "fi": "integer", "f": "float", "b": "integer", "u": "unknown", "t": "string"}
    doc = profile.profile_document(s).first()[0]
    assert '"row_count":2' in doc and '"column_count":6' in doc
    empty = Sheet(s.df.where("false"))
    assert profile.profile_document(empty).first()[0] == '{"columns":[],"sample_data":[]}'


def test_header_promote_and_conform(spark, sheet_of):
    s = sheet_of([("id", "", "id"), ("1", "x", "2")], "c0 string, c1 string, c2 string")
    h = conform.promote_header(s)
    assert h.columns == ["id", "Column2", "id.1"] and h.df.first()["_row"] == 0
    blank_first = sheet_of([(None, ""), ("1", "2")], "c0 string, c1 string")
    assert conform.promote_header(blank_first).columns == ["A", "B"]
    target = [("id", "integer"), ("missing", "string")]
    out, fails = conform.conform(h, target)
    assert out.columns == ["id", "missing"] and fails.first()["id"] == 0


def test_stacked_split(spark, sheet_of):
    rows = [("k", "v"), ("1", "a"), (None, None), ("K", "V"), ("2", "b"), ("3", "c"), (None, None), ("x", "y"), ("9", "z")]
    out = conform.split_stacked(sheet_of(rows, "c0 string, c1 string")).orderBy("table_id", "_row").collect()
    assert [(r.table_id, r.similar_to, r._row, r.c0) for r in out] == [
        (0, 0, 0, "1"), (1, 0, 0, "2"), (1, 0, 1, "3"), (2, 2, 0, "9")]


def test_version_log(spark, sheet_of):
    s0, s1, s2 = (sheet_of([(i, "x")], "a long, b string") for i in range(3))
    s1 = Sheet(s1.df.withColumn("more.x", F.lit(1)))  # versions may differ in columns
    log = history.VersionLog(spark)
    first = lambda s: s.df.first()["a"]
    assert log.current() is None and log.undo() is None and log.state()["visible_seq"] is None
    log.commit(s0)
    log.commit(s1)
    assert log.current().columns == ["a", "b", "more.x"]
    assert first(log.undo()) == 0 and log.undo() is None and first(log.redo()) == 1 and log.redo() is None
    log.undo()
    log.commit(s2)
    assert first(log.current()) == 2 and log.redo() is None and log.state()["can_undo"]
    assert first(history.VersionLog(spark, log.path).undo()) == 0  # a new handle reads the same log


def test_steps_commit_once_and_leave_no_state_on_error(spark, sheet_of):
    from gridframe.operators.steps import run_step

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b[b["a"] % 2 == 0]

    s = sheet_of([(i, "x") for i in range(1000)], "a long, b string")
    log = history.VersionLog(spark)
    log.commit(s)
    got = run_step(s, lambda d: d.mapInPandas(counted, "_row long, a long, b string"), log)
    assert [r._row for r in got.sheet.df.orderBy("_row").collect()] == list(range(500)) and runs.value == 1000
    assert got.touched.count() == 499 and log.current().df.count() == 500
    some = run_step(s, lambda d: d.where(F.rand(3) < 0.5)).sheet
    assert [r._row for r in some.df.orderBy("_row").collect()] == list(range(some.n_rows))
    with pytest.raises(Exception):
        run_step(s, lambda d: d.select("_row", F.raise_error(F.lit("no")).alias("a")), log)
    assert log.state()["visible_seq"] == 1 and log.current().df.count() == 500


def test_history_replay(spark):
    log = spark.createDataFrame([(1, 1, "commit"), (1, 2, "undo"), (1, 3, "commit"), (1, 4, "undo"),
                                 (1, 5, "redo"), (1, 6, "redo"), (2, 1, "undo")], "sheet_id long, seq long, action string")
    got = [(r.seq, r.pos, r.len, r.visible_seq) for r in history.replay(log).orderBy("sheet_id", "seq").collect()]
    assert got == [(1, 0, 1, 1), (2, 0, 1, 1), (3, 1, 2, 3), (4, 0, 2, 1), (5, 1, 2, 3), (6, 1, 2, 3), (1, -1, 0, None)]


def test_sessions_strictly_over_timeout(spark):
    rows = [(1, "2000-01-01 00:00:00"), (1, "2000-01-01 01:00:00"), (1, "2000-01-01 02:00:01"), (2, "2000-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "session_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = sorted((r.session_id, r.accesses) for r in logs.sessionize(df).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_one_user_on_one_day_spans_tasks(spark):
    import datetime as dt
    import random

    r = random.Random(3)
    t0 = dt.datetime(2024, 5, 1)
    times = [(7, r.randint(0, 86_399)) for _ in range(3000)] + [(u, r.randint(0, 86_399)) for u in (1, 9, 11) for _ in range(40)]
    rows = [(u, str(t0 + dt.timedelta(seconds=s))) for u, s in times]
    df = spark.createDataFrame(rows, "session_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        for timeout in (20, 90, 3600):
            got = sorted((x.session_id, str(x.session_start), x.accesses) for x in logs.sessionize(df, timeout).collect())
            want = []
            for u, s in sorted(times):
                if want and want[-1][0] == u and s - want[-1][2] <= timeout:
                    want[-1][2:] = [s, want[-1][3] + 1]
                else:
                    want.append([u, s, s, 1])
            assert got == sorted((u, str(t0 + dt.timedelta(seconds=a)), n) for u, a, _, n in want)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    from gridframe import session

    def fake(master):
        sc = N(getCheckpointDir=lambda: None, master=master, getConf=lambda: {}, setCheckpointDir=lambda d: None)
        return N(sparkContext=sc, conf={})

    assert session.checkpoint_dir(fake("local[4]")).startswith("/tmp/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_dir(fake(master))


def test_listing_and_search(spark, sheet_of):
    s = sheet_of([("alpha",), ("a very long value indeed",), ("",)], "v string")
    lst = {(r.kind, r.row): r.description for r in address.cell_listing(s).collect()}
    assert lst[(0, -1)] == "Column A" and lst[(2, 1)] == "Cell A2: a very long val..." and lst[(2, 2)] == "Cell A3"
    top = address.cell_search(s, "alp").collect()
    assert [r.text for r in top] == ["A1"]


def test_sessions_ignore_session_time_zone(spark):
    rows = [(1, "2024-03-10 01:30:00"), (1, "2024-03-10 03:00:00"), (1, "2024-03-10 03:45:00")]
    df = spark.createDataFrame(rows, "session_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = sorted((r.accesses, str(r.session_start)) for r in logs.sessionize(df).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = sorted((r.accesses, str(r.session_start)) for r in logs.sessionize(df).collect())
    # 01:30 -> 03:00 is 90 minutes of wall clock: two sessions in any zone
    assert la == utc == [(1, "2024-03-10 01:30:00"), (2, "2024-03-10 03:00:00")]


def test_selections_that_leave_the_sheet_raise(spark, sheet_of):
    from gridframe.operators import address
    from gridframe.operators.edits import EditError, drop_cols_by_letters

    s = sheet_of([(i, f"v{i}") for i in range(4)], "a long, b string")
    for bad in ("C1", "A5", "A1:B9", "3, D", "5"):
        with pytest.raises(ValueError):
            address.read_range(s, bad)
    with pytest.raises(EditError):
        drop_cols_by_letters(s, ["A", "C"])
    asked = spark.createDataFrame([(1, "B2:A1"), (2, "C1"), (3, "x!"), (4, "B, 4"), (5, "")], "id long, selection string")
    assert {r.id: r.error for r in address.parsed_selections(s, asked).collect()} == {
        1: None, 2: "leaves the sheet", 3: "invalid", 4: None, 5: None}
    got = sorted(tuple(r) for r in address.read_ranges(s, asked).collect())
    assert got == [(1, 0, 0, 0, ["0", "v0"]), (1, 0, 1, 0, ["1", "v1"]), *[(4, 0, i, 1, [f"v{i}"]) for i in range(4)],
                   (4, 1, 3, 0, ["3", "v3"])]


def test_search_index_finds_what_single_searches_find(spark, sheet_of, monkeypatch):
    """Over many blocks; the index has a row for a gram and block, not for each entry."""
    monkeypatch.setattr(address, "BLOCK_ROWS", 8)
    monkeypatch.setattr(address, "ENTRIES_PER_PART", 20)
    rnd = random.Random(8)
    words = ["Alpha", "alphabet", "BETA", "", None, "Äpfel", "a%_b", "Cell"]
    s = sheet_of([(rnd.choice(words), rnd.randrange(200), None) for _ in range(70)], "v string, n long, gone string")
    index = address.SearchIndex(s)
    terms = ["a", "al", "alp", "ALPHA", "alphabet", "eta", "äpf", "%_", "1", "17", "170", "cell", "Cell C", "Row 6", "zzz", "alphb", "e", ""]
    got = {}
    for r in index.search(spark.createDataFrame([(t,) for t in terms + ["a", None]], "term string"), 5).collect():
        got.setdefault(r.term, []).append((r.rank, r.kind, r.col, r.row, r.text, r.description))
    listing = sorted(address.cell_listing(s).collect(), key=lambda r: r[:3])
    for t in terms:
        want = [r for r in listing if t.lower() in r.text.lower() or t.lower() in r.description.lower()] if t else []
        assert sorted(got.get(t, [])) == [(i + 1, *r) for i, r in enumerate(want[:5])], t
    assert sorted(got["alp"]) == [(i + 1, *r) for i, r in enumerate(address.cell_search(s, "alp", 5).collect())]
    blocks = index.postings().select("kind", "col", "block").distinct().count()
    assert index.postings().where("gram = 'e'").count() <= blocks == 3 + 4 * 9
    assert index.postings().groupBy("gram").count().agg(F.max("count")).first()[0] <= blocks

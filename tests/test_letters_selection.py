import pytest
from pyspark.sql import functions as F

from gridframe.functions import (column_index, column_letters, format_selection, parse_cell_id,
                                 parse_selection, selection_in_bounds)
from gridframe.operators.address import index_to_letters, letters_to_index, parse_selection_text


def test_letters_fixed_points(spark):
    pairs = [(0, "A"), (25, "Z"), (26, "AA"), (51, "AZ"), (701, "ZZ"), (702, "AAA"), (18277, "ZZZ"), (18278, "AAAA")]
    df = spark.createDataFrame([(i,) for i, _ in pairs], "i long")
    got = df.select("i", column_letters("i").alias("s"), column_index(column_letters("i")).alias("back")).collect()
    assert {r.i: r.s for r in got} == dict(pairs)
    assert all(r.i == r.back for r in got)


def test_letters_roundtrip_many(spark):
    df = spark.range(0, 50000).select(F.col("id"), column_letters("id").alias("s"))
    bad = df.where(column_index("s") != F.col("id")).count()
    assert bad == 0
    sample = {r.id: r.s for r in df.where(F.col("id") % 997 == 0).collect()}
    assert all(index_to_letters(i) == s for i, s in sample.items())


def test_column_index_bad_input(spark):
    df = spark.createDataFrame([("a",), ("aa",), ("A1",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(column_index("s")).collect()]
    assert got == [0, 26, -1, -1, -1]


def test_cell_id(spark):
    df = spark.createDataFrame([("A1",), (" c3 ",), ("A0",), ("1A",)], "s string")
    got = [r[0] for r in df.select(parse_cell_id("s")).collect()]
    assert got[0].asDict() == {"row": 0, "col": 0}
    assert got[1].asDict() == {"row": 2, "col": 2}
    assert got[2] is None and got[3] is None


CASES = {
    "A1": [(0, 0, 0, 0)],
    "c3": [(2, 2, 2, 2)],
    "A1:C3": [(0, 0, 2, 2)],
    "C3:A1": [(0, 0, 2, 2)],
    "A:C": [(0, 0, None, 2)],
    "A": [(0, 0, None, 0)],
    "2": [(1, 0, 1, None)],
    "1:5": [(0, 0, 4, None)],
    "A1, B2:C4, 7": [(0, 0, 0, 0), (1, 1, 3, 2), (6, 0, 6, None)],
}


def test_parse_selection(spark):
    texts = list(CASES) + ["A0", "A1,,B2", "1A", "a1:c3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p for r in df.select("t", parse_selection("t").alias("p")).collect()}
    for t, want in CASES.items():
        assert [tuple(x) for x in got[t]] == want, t
        assert [tuple(x) for x in parse_selection_text(spark, t)] == want
    for bad in ["A0", "A1,,B2", "1A", "a1:c3"]:
        assert got[bad] is None
        with pytest.raises(ValueError):
            parse_selection_text(spark, bad)


def test_bounds_and_format_roundtrip(spark):
    texts = ["A1", "A1:C3", "A:C", "A", "2", "1:5", "A1, B2:C4, 7", "ZZ9", "B2:D10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rects = parse_selection("t")
    n, m = F.lit(10).cast("long"), F.lit(5).cast("long")
    got = {r.t: (r.ok, r.f) for r in df.select("t", selection_in_bounds(rects, n, m).alias("ok"),
                                               format_selection(rects, n, m).alias("f")).collect()}
    assert got["ZZ9"][0] is False
    assert got["A1"] == (True, "A1")
    assert got["A:C"] == (True, "A:C")
    assert got["2"] == (True, "2")
    assert got["1:5"] == (True, "1:5")
    assert got["A1, B2:C4, 7"] == (True, "A1, B2:C4, 7")
    # A5 o A7 is the identity on formatted text (inverse law)
    again = spark.createDataFrame([(v[1],) for k, v in got.items() if v[0]], "t string")
    f2 = again.select("t", format_selection(parse_selection("t"), n, m).alias("f")).collect()
    assert all(r.t == r.f for r in f2)


def test_driver_letters():
    assert letters_to_index("AA") == 26 and letters_to_index("a") == 0 and letters_to_index("1") == -1
    assert index_to_letters(702) == "AAA"

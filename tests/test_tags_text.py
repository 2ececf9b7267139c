import re

from gridframe.functions import code_block, extract_tags, rewrite_tags, value_shape
from gridframe.functions.tags import RANGE_LIST, SINGLE_RULES
from gridframe.operators.clean import shape_of


def model_rewrite(text: str) -> str:
    """Brute-force model with Python's re (callback + ordered rules)."""
    def cb(m):
        refs = []
        for r in m.group(1).split(","):
            a, b = r.strip().split(":")
            refs.append(f"range from {a.strip()} to {b.strip()}")
        return "cells in " + ", ".join(refs)

    out = re.sub(RANGE_LIST.replace("(?U)", ""), cb, text)
    for pat, rep in SINGLE_RULES:
        out = re.sub(pat.replace("(?U)", ""), rep.replace("$1", r"\1").replace("$2", r"\2"), out)
    return out


COMMANDS = ["sum #A1:B2, C3:D4", "clear #A", "remove columns #O, #P and #Q", "#A1:#B2", "#A:#C", "#1:#5",
            "#AB:#C", "lower #a1 stays", "#A1 and #B", "rows #3 and #3:7", "mix #A1:B2,#C:D, 1:4 end",
            "no tags here", "#Z9:AA10 , B1:C2"]


def test_rewrite_matches_model(spark):
    df = spark.createDataFrame([(c,) for c in COMMANDS], "c string")
    got = {r.c: r.r for r in df.select("c", rewrite_tags("c").alias("r")).collect()}
    for c in COMMANDS:
        assert got[c] == model_rewrite(c), c
    assert got["#A1:#B2"] == "cell A1:cell B2"
    assert got["#A:#C"] == "#A:column C"
    assert got["#1:#5"] == "#1:row 5"
    assert got["#AB:#C"].startswith("column AB:")
    assert got["sum #A1:B2, C3:D4"] == "sum cells in range from A1 to B2, range from C3 to D4"


def test_extract_tags(spark):
    df = spark.createDataFrame([("sum #A1:B2 and #c3",), ("#A1:#B2",), ("none",)], "c string")
    got = [r[0] for r in df.select(extract_tags("c")).collect()]
    assert got == ["A1:B2, c3", "A1:, B2", ""]


def test_shapes(spark):
    ex = ["2023-01-01T00:00:00", "327-049224", "013000", "Other intangible assets"]
    df = spark.createDataFrame([(e,) for e in ex], "e string")
    got = [r[0] for r in df.select(value_shape("e")).collect()]
    assert got == [shape_of(e) for e in ex] == ["9-9-9A9:9:9", "9-9", "9", "A"]


def test_code_block(spark):
    rows = [("```python\nx = 1\n```",), ("text ```\ny\n``` more",), ("  plain  ",), ("```\n```",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r[0] for r in df.select(code_block("r")).collect()]
    assert got == ["x = 1", "y", "plain", ""]

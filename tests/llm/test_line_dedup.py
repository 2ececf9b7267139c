from collections import defaultdict

import numpy as np
import pytest

from gridframe.llm import bloom
from gridframe.llm.common import text_buffer
from gridframe.llm.line_dedup import NO_ID, drop_repeated_lines, line_keys

from .cases import DOCS, awkward, clashing, nothing, prose

BLANKS = " \t\n\v\f\r"


def lowered(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def by_hand(rows, min_chars=10):
    docs = [(NO_ID if i is None else i, (t or "").split("\n"), i) for i, t in rows]
    held = defaultdict(set)
    for i, lines, _ in docs:
        for line in lines:
            held[lowered(line.strip(BLANKS))].add(i)
    out = []
    for i, lines, real in docs:
        kept = []
        for line in lines:
            key = lowered(line.strip(BLANKS))
            if len(key) < min_chars or len(held[key]) < 2 or min(held[key]) == i:
                kept.append(line)
        out.append((real, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


LINED = [
    (5, "A shared line here\nonly mine\nA shared line here"),
    (2, "  a SHARED line here\r\n\nshort\n"),
    (9, "short\nÄ shared line here\nä shared line here"),
    (7, "ä shared line here\n\n\n"),
    (None, "a shared line here\nno id line one"),
    (None, "no id line one\nno id line one"),
    (4, "no id line one"), (4, "twice in a document\ntwice in a document"), (4, "twice in a document"),
    (6, "123456789 \n1234567890"), (8, "123456789\n 1234567890\t"), (3, None), (1, ""), (11, "\n\n"),
    (12, prose(1, 40_000).replace(" ", "\n", 9)), (13, prose(1, 40_000).replace(" ", "\n", 9)),
]


@pytest.mark.parametrize("max_bits", [bloom.MAX_BITS, 512])
def test_equals_brute_force(spark, max_bits):
    rows = LINED + [(100 + i, f"{prose(i % 40, 12)}\n{prose(i % 7, 5)}\nline {i}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(5)
    assert got(drop_repeated_lines(docs, max_bits=max_bits)) == by_hand(rows)


def test_awkward_clashing_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert got(drop_repeated_lines(awkward(spark))) == by_hand(rows)
    assert got(drop_repeated_lines(clashing(spark))) == by_hand(rows)
    assert got(drop_repeated_lines(nothing(spark))) == []


def test_one_line_held_by_most_documents(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('the very common line\nown ', id, ' text') as text")
    out = drop_repeated_lines(docs)
    assert out.where("n_dropped = 1").count() == 29_999
    assert out.where("n_dropped = 0").first().doc_id == 0


def test_lines_of_rows_that_end_in_line_feeds():
    import pyarrow as pa

    data, bounds = text_buffer(pa.array(["ab\n", "", None, "\ncd", "x"]))
    row, line, start, end, _ = line_keys(data, bounds, 0)
    assert row.tolist() == [0, 0, 1, 2, 3, 3, 4] and line.tolist() == list(range(7))
    assert [data[s:e].tobytes() for s, e in zip(start, end)] == [b"ab", b"", b"", b"", b"", b"cd", b"x"]


def test_filter_misses_no_key_and_few_others_look_alike():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    blocks = bloom.blocks_for(len(keys), 12)
    bits = bloom.empty_filter(blocks)
    bloom.add_keys(bits, keys, 0, blocks, 4)
    assert bloom.has_keys(bits, keys, 0, blocks, 4).all()
    others = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert bloom.has_keys(bits, others, 0, blocks, 4).mean() < 0.02
    assert bloom.blocks_for(10**15, 12) * 512 == bloom.MAX_BITS

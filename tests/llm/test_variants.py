import random
import re
from collections import Counter
from zlib import crc32

import pytest

from gridframe.llm.variants import spelling_variants, word_hashes

from .cases import DOCS, awkward, clashing, nothing


def by_hand(rows, min_chars=5, min_count=3, ratio=2, every=97):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        ns = sorted((-words[v], v) for v in words if near(w, v))
        ok = bool(ns) and -ns[0][0] >= ratio * n
        out[w] = (ns[0][1] if ok else None, n, len(ns), -ns[0][0] if ok else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted(((w, f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("max_bits", [1 << 28, 4096])
def test_equals_all_pairs(spark, max_bits):
    r = random.Random(4)
    words = ["".join(r.choice("abÀé÷ÿz") for _ in range(r.randint(3, 8))) for _ in range(300)]
    chain = ["colours", "colourss", "colourrss", "ccolourrss"]
    rows = [(i, " ".join(r.choices(words, k=90))) for i in range(60)]
    rows += [(100 + i, f"{chain[0]} " * 40 + f"{chain[1]} " * 18 + f"{chain[2]}, " * 8 + f"{chain[3].upper()}-" * 4) for i in range(3)]
    rows += [(None, "Zebra ZEBRA zebra zèbra zèbra zèbra"), (7, None), (8, ""), (9, "12 - \n")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)
    assert got(spelling_variants(docs, max_bits=max_bits)) == by_hand(rows)


def test_awkward_clashing_empty_and_very_long_runs(spark):
    rows = [(x.doc_id, x.text) for x in awkward(spark).collect()]
    assert got(spelling_variants(awkward(spark))) == by_hand(rows) == got(spelling_variants(clashing(spark)))
    assert got(spelling_variants(nothing(spark))) == []
    long = "ab" * 15_000
    rows = [(1, f"{long} " * 7), (2, f"{long[:-1]} " * 3), (3, f"x{long[1:]} " * 3)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = {len(w): (None if f is None else len(f), n, k) for w, f, _, n, k, _ in got(spelling_variants(docs, every=1 << 40))
           if w[0] == "a"}
    assert out == {30_000: (None, 7, 2), 29_999: (30_000, 3, 1)}


def test_hashes_tell_lengths_and_letters_apart():
    words = ["a" * n for n in range(5, 60)] + ["abcde", "edcba", "abcdé"]
    assert len(set(word_hashes(words).tolist())) == len(words)

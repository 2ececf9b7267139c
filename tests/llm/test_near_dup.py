import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from gridframe.llm import minhash
from gridframe.llm.common import text_buffer
from gridframe.llm.components import components
from gridframe.llm.minhash import distinct_shingles, keep_representatives, near_duplicates, sketches

from .cases import DOCS, awkward, awkward_rows, clashing, nothing, plain_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num=80, den=100):
    """Component of each row's position by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[top(n)].append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return [(i, len(sets[n]), least[top(n)] if sets[n] else i) for n, (i, _) in enumerate(rows)]


def test_groups_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for family in range(14):
        words = prose(50 + family, r.choice([1, 2, 6, 40, 150, 400])).split()
        for _ in range(r.randint(1, 9)):
            rows.append(" ".join(words))
            words = [prose(r.randint(0, 10**9), 1) if r.random() < r.choice([0.0, 0.03, 0.08]) else w for w in words]
    shared = prose(77, 60)
    rows += [shared + " " + prose(900 + i, 25) for i in range(12)]  # one passage in many: alike, not linked
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)
    for k in (2, 5):
        got = near_duplicates(docs, words=k).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(list(enumerate(rows)), k))
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_awkward_rows(spark):
    want = sorted(brute([(r[0], r[1]) for r in awkward_rows()], 2), key=repr)
    for frame in (awkward(spark), clashing(spark)):
        got = near_duplicates(frame, words=2).collect()
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == want
    assert near_duplicates(nothing(spark)).collect() == []


def test_representatives_keep_their_columns(spark):
    frame = clashing(spark)
    kept = keep_representatives(frame)
    assert kept.columns == frame.columns and keep_representatives(nothing(spark)).collect() == []
    rows = plain_rows(kept)
    assert all(r in plain_rows(frame) for r in rows)
    # 1 copies 0, 2 extends it; both rows of id 3 with that text stay, its copy without an id goes.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 4) == [0, 3, 3, 3]
    assert [r.text for r in rows if r.doc_id is None] == [None]


def test_sketch_agreement_estimates_similarity():
    texts = [prose(60, 500), " ".join(prose(60, 500).split()[:400] + prose(61, 100).split()), "a b", "one"]
    data, bounds = text_buffer(pa.array(texts))
    h, edge = distinct_shingles(data, bounds, 1)
    s = sketches(h, edge, 400)
    a, b = ({*h[edge[i] : edge[i + 1]].tolist()} for i in (0, 1))
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.1
    assert (s != np.uint64((1 << 64) - 1)).all()  # every coordinate is filled, for small sets too


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(4)
    ids = r.sample(range(-(10**6), 10**6), 240)
    path = list(zip(ids[:90], ids[1:90]))
    star = [(ids[100], x) for x in ids[101:200]]
    ring = list(zip(ids[200:220], ids[201:220] + ids[200:201]))
    links = path + star + ring + [(b, a) for a, b in path[:5]] + [(ids[230], ids[230])]
    r.shuffle(links)
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 90 + 100 + 20
    for part in (ids[:90], ids[100:200], ids[200:220]):
        assert len({got[i] for i in part}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_that_nothing_links_make_no_pairs(spark, monkeypatch):
    """Copies of one text just below the threshold share most buckets: they are
    held against pivots one by one, and against one another in blocks only."""
    r = random.Random(12)
    base = prose(40, 200).split()
    texts = []
    for i in range(70):
        words = list(base)
        for at in r.sample(range(200), 20):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    texts += [texts[5] + " tail", " ".join(base[:197]), prose(41, 200), prose(41, 200) + " more"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    pairs = []

    def counted(p, *more):
        pairs.append(p.count())
        return measured(p, *more)

    measured = minhash.measured
    monkeypatch.setattr(minhash, "measured", counted)
    for block in (4, 512):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = near_duplicates(docs, words=2).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(list(enumerate(texts)), 2))
    assert len({x.component_id for x in got}) > 40
    assert max(pairs) <= minhash.PIVOTS * len(texts)


def test_blocks_count_and_join_as_sets_do(monkeypatch):
    monkeypatch.setattr(minhash, "_WIDTH", 7)
    r = random.Random(3)
    sets = [sorted({r.randrange(60) for _ in range(r.randrange(40))}) for _ in range(25)] + [[]]
    raw = [np.array(s, np.uint64).tobytes() for s in sets]
    both = minhash.common_members(raw, raw[:9])
    assert both.tolist() == [[len({*a} & {*b}) for b in sets[:9]] for a in sets]
    a, b = (np.array([r.randrange(-30, 30) for _ in range(25)]) for _ in range(2))
    up = {v: v for v in {*a.tolist(), *b.tolist()}}

    def classes(links):
        label, links = dict(up), list(links)
        for _ in up:
            for x, y in links:
                label[x] = label[y] = min(label[x], label[y])
        return label

    c, d = minhash.forest(a, b)
    assert len(c) < len(up) and classes(zip(a.tolist(), b.tolist())) == classes(zip(c.tolist(), d.tolist()))

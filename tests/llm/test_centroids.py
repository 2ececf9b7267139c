import math
from hashlib import sha256

import numpy as np

from gridframe.llm.centroids import cluster_vectors, nearest, pivot_distances, spread_pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(v))) for v in e]) for i, e in rows
            if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(x) for _, x in start[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cs]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(cs)):
            mine = [x for (_, x), (b, _) in zip(kept, own) if b == c]
            if mine:
                cs[c] = [sum(v) // len(mine) for v in zip(*mine)]
    own = assign()
    total = sum(d for _, d in own)
    by = {c: sum(d for b, d in own if b == c) for c, _ in own}
    return sorted(((i, c, d, by[c], total, sha256(",".join(map(str, cs[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(kept, own)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_lloyd_on_integers(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    rows = [(i, [float(v) for v in (centres[i % 9] + rng.normal(scale=0.2, size=6)).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(200)] + [(3, rows[3][1])] * 4
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(4)
    assert got(cluster_vectors(df, k=12, rounds=4, dims=6)) == by_hand(rows, 12, 4, 6)


def test_awkward_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 0.0]), (None, [0.1, 0.3]), (None, [0.1, 0.3]), (8, [-0.0, -0.001]), (9, [5.0, 5.0]), (9, [5.0, 5.0])]
    df = spark.createDataFrame([(i, e, None) for i, e in rows], SCHEMA)
    for k in (2, 40):
        assert got(cluster_vectors(df, k=k, rounds=3, dims=2)) == by_hand(rows, k, 3, 2)
    from pyspark.sql import functions as F

    more = df.withColumns({c: F.lit(c) for c in ("x", "far", "cluster", "distance", "a.b")})
    assert got(cluster_vectors(more, k=2, rounds=3, dims=2)) == by_hand(rows, 2, 3, 2)
    assert got(cluster_vectors(df.limit(0), dims=2)) == [] == got(cluster_vectors(df, dims=3))
    far = spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 0.0], 0), (3, [0.0, 0.0], 0)], SCHEMA)
    assert {r.vec_id for r in cluster_vectors(far, k=1, rounds=1, dims=2).collect()} == {1, 2, 3}


def test_bounds_rule_out_only_what_is_farther():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-500, 500, (30, 8))
    x = (centroids[rng.integers(0, 30, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(np.int64)
    pivots = spread_pivots(centroids, 8)
    best, least, n_exact = nearest(x, pivot_distances(x, pivots), centroids, pivots)
    d = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()
    assert n_exact < 0.3 * d.size

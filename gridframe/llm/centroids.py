"""Centroid clustering of integer vectors with a LAESA pivot table.

Vectors become integers once, and their distances to a few fixed pivots are
stored with them.  In each round the driver holds the centroids only; a task
takes the differences between a vector's and a centroid's stored pivot
distances as lower bounds of their distance, for all centroids, and computes
exact integer distances for those that the bound doesn't rule out.  Sums and
counts by cluster are grouped in Spark; centroids x components numbers reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import staged

#: Components beyond this are cut to it, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Pivots of the table.
PIVOTS = 16
#: Vectors that one numpy step handles.
STEP = 4096


def integer_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): ``x`` the components floor(scale * component), of the rows with ``dims`` finite ones."""
    wide = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    whole = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    step = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    return rows.where((F.size("embedding") == dims) & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, step).alias("x")
    )


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims).astype(np.int64)


def spread_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of ``points``, each the farthest from those taken before."""
    taken = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(n, len(points)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to each pivot; integers up to 2^62 below the root."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1).astype(np.float64))


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, and how many exact distances
    that took.  Ties go to the smaller number."""
    of_centroid = pivot_distances(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(table[:, p, None] - of_centroid[None, :, p]), out=bound)
    # Roots are off by less than one part in 2^50 of the terms: give that much away.
    bound -= (table.max(1, initial=0)[:, None] + of_centroid.max(1, initial=0)[None, :]) * 2.0**-48
    np.maximum(bound, 0, out=bound)
    best = bound.argmin(1)
    least = ((x - centroids[best]) ** 2).sum(1)
    done, n_exact = best.copy(), len(x)
    # In ascending order of number; an equal distance at a smaller number wins.
    for c in range(len(centroids)):
        left = np.flatnonzero((done != c) & (bound[:, c] ** 2 <= least * (1 + 2.0**-48) + 1))
        if not len(left):
            continue
        d = ((x[left] - centroids[c]) ** 2).sum(1)
        n_exact += len(left)
        better = (d < least[left]) | ((d == least[left]) & (c < best[left]))
        best[left[better]], least[left[better]] = c, d[better]
    return best, least, n_exact


def _name(vector: list[int]) -> str:
    return sha256(",".join(map(str, vector)).encode()).hexdigest()


def cluster_vectors(
    rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", n_pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for
    every row with ``dims`` components, none null or not finite.

    The first centroids are the ``k`` vectors of least sha256 of
    ``<seed>:<vec_id>`` (ties by components); fewer vectors are that many
    centroids.  Rows are vectors: repeated rows count each, rows without a
    vec_id are clustered but start no centroid while others can.  Components
    beyond 2^27 are cut to that.  An inertia beyond 64 bits is 2^63 - 1.  No
    vectors give no rows; other columns are ignored."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dims, scale)
    order = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.col("x")]
    first = [r.x for r in vectors.orderBy(*order).limit(k).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array(first, np.int64)
    pivots = spread_pivots(centroids, n_pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                far = pivot_distances(matrix(part.column("x"), dims), pivots)
                far = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), far], names=["vec_id", "x", "far"])

    table = staged(vectors.mapInArrow(measure, "vec_id long, x array<int>, far array<double>"), "pivot-table")

    def steps(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                x = matrix(part.column("x"), dims)
                far = np.asarray(part.column("far").flatten()).reshape(-1, len(pivots))
                yield part, x, *nearest(x, far, centroids, pivots)[:2]

    def summed(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), dims), np.int64)
            count = np.zeros(len(centroids), np.int64)
            for _, x, best, _ in steps(batches, centroids):
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=len(centroids))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))),
                 pa.array(total[some].ravel()), pa.array(np.repeat(count[some], dims))],
                names=["cluster", "dim", "total", "n"],
            )

        return run

    for _ in range(rounds):
        sums = table.select("x", "far").mapInArrow(summed(centroids), "cluster int, dim int, total long, n long")
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.cluster, r.dim] = r.total // r.n
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, least in steps(batches, centroids):
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"]
            )

    assigned = staged(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(wide.alias("d")).collect()}
    cap = lambda v: min(v, (1 << 63) - 1)
    whole = cap(sum(by_cluster.values()))
    facts = spark.createDataFrame(
        [(c, cap(d), whole, _name(centroids[c].tolist())) for c, d in by_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(*[f.split(" ")[0] for f in schema.split(", ")])

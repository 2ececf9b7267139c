"""Connected components of links by repeated contraction.

Every vertex takes the smallest vertex among itself and its neighbours; edges
are rewritten to the vertices taken and the rest of the graph is handled the
same way, in an order that is drawn anew in each round, so that a path of any
numbering shrinks by a constant share a round.  Edges and labels stay
distributed; only the number of edges left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every vertex of ``links`` (a, b): two vertices have
    the same label if and only if links connect them.  Repeated links, both
    directions of one, and links of a vertex to itself are allowed."""
    edges = staged(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = staged(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")),
        "labels", n,
    )
    vertices, turn = n, 0
    while n:
        rank = F.col if turn == 0 else lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023
        ends = edges.select(
            F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                              F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")
        ).select("e.v", "e.w")
        # The min over neighbours is combined before the shuffle: hot vertices stay small.
        least = ends.groupBy("v").agg(F.min(F.struct(rank("w").alias("r"), F.col("w").alias("to"))).alias("m"))
        own = F.struct(rank("v").alias("r"), F.col("v").alias("to"))
        taken = staged(least.select("v", F.least("m", own)["to"].alias("to")), "taken", n)
        a = taken.withColumnsRenamed({"v": "a", "to": "to_a"})
        b = taken.withColumnsRenamed({"v": "b", "to": "to_b"})
        moved = edges.join(a, "a").join(b, "b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
        )
        edges = staged(moved.where("a <> b").distinct(), "edges", n)
        labels = staged(
            labels.join(taken.withColumnRenamed("v", "label"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ),
            "labels", vertices,
        )
        n = edges.count()
        turn += 1
    return labels

"""Sharding by longest processing time (LPT).

Rows with equal texts form a group that stays in one shard.  Groups, largest
first, go to the least-loaded shard through a heap, so shard sizes come out
near equal (law ``bytes``).

Scale: only *units* reach the driver, never rows or all groups.  A group that
holds at least one ``n_shards * grain``-th of all bytes is a unit of its own
(so there are at most ``n_shards * grain`` of these); all smaller groups are
pooled by their key into ``n_shards * grain`` bins, each of which is a unit.
The heap therefore sees at most ``2 * n_shards * grain`` units at any input
size, and the two assignment tables that are broadcast back have that bound
as well.  Slots are numbered from per-chunk counts, without a window over a
whole shard.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import staged
from gridframe.session import cut_lineage

#: Rows that are numbered together when slots are dealt.
SLOT_CHUNK = 1024


def longest_first(sizes: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """LPT: units (size, key), largest first and ties by key, each to the shard
    with the least bytes so far (ties: the lowest shard)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, n_shards: int = 40, grain: int = 500) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Null texts form one group (size 16, checksum of no bytes); empty texts
    another; a null ``doc_id`` is kept as null; repeated rows each get a slot;
    an empty table gives no rows; further input columns are ignored."""
    spark = docs.sparkSession
    slim = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64(F.lit("group"), F.col("text")).alias("k2"),
        ),
        "shard-rows",
    )
    units = n_shards * grain
    groups = slim.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    own = F.col("bytes") * F.lit(units) >= F.lit(total)
    bin_of = F.pmod("k1", F.lit(units)).cast("int")
    sized = groups.withColumn("own", own).withColumn("bin", bin_of)
    large = sized.where("own").select("k1", "k2", "bytes").toPandas()  # at most `units` rows
    small = sized.where(~F.col("own")).groupBy("bin").agg(F.sum("bytes").alias("bytes"))
    small = small.toPandas()  # at most `units` rows
    placed = longest_first(
        [(int(b), (0, int(a), int(c))) for a, c, b in large.itertuples(index=False)]
        + [(int(b), (1, int(a), 0)) for a, b in small.itertuples(index=False)],
        n_shards,
    )
    of_group = pd.DataFrame(
        [(k[1], k[2], s) for k, s in placed.items() if k[0] == 0], columns=["k1", "k2", "gs"]
    )
    of_bin = pd.DataFrame([(k[1], s) for k, s in placed.items() if k[0] == 1], columns=["bin", "bs"])
    of_group = spark.createDataFrame(of_group.astype("int64"), "k1 long, k2 long, gs long")
    of_bin = spark.createDataFrame(of_bin.astype("int64"), "bin long, bs long")
    rows = (
        slim.withColumn("bin", bin_of.cast("long"))
        .join(F.broadcast(of_group), ["k1", "k2"], "left")
        .join(F.broadcast(of_bin), "bin", "left")
        .select(
            "doc_id", "size", "text_crc32",
            F.coalesce("gs", "bs").cast("int").alias("shard"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    rows = cut_lineage(rows)  # places stay as they are from here on
    rows = rows.withColumn("chunk", F.floor(F.col("place") / SLOT_CHUNK).cast("long"))
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("place")) - 1
    return (
        rows.withColumn("within", within)
        .join(offsets, ["shard", "chunk"])
        .select(
            "doc_id", "size", "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("off") + F.col("within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

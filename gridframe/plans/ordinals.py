"""Row ordinals (A1): a contiguous 0-based ``_row`` without a one-partition window.

``row_number() over (order by k)`` plans a single-partition exchange, which
does not scale.  Instead:

1. range-sort by the key (distributed; skipped when the caller keeps the
   input order),
2. cut lineage with a reliable checkpoint, so the partition layout is fixed:
   range bounds come from sampling, and two evaluations of the same sort may
   place boundary rows in different partitions,
3. count rows per partition (one small row per partition),
4. prefix-sum those counts into per-partition offsets (size bounded by the
   partition count, so it is safe to broadcast),
5. ``_row = offset[partition] + position in partition``, where the position
   is the low 33 bits of ``monotonically_increasing_id``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions.text import qc
from gridframe.session import cut_lineage

ROW = "_row"
_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def numbered(
    df: DataFrame,
    order_by: list[str | Column] | None = None,
    name: str = ROW,
    materialize: bool = True,
) -> tuple[DataFrame, int]:
    """``df`` with a leading contiguous 0-based ordinal column ``name``, and
    its row count.

    ``order_by``: sort keys (ties make the order undefined, as in any sort).
    ``materialize``: checkpoint before numbering; pass False only when the
    input layout is already fixed (a checkpointed or freshly read table).
    """
    spark = df.sparkSession
    cols = [qc(c) for c in df.columns if c != name]
    base = df.select(*cols)
    if order_by:
        base = df.orderBy(*order_by).select(*cols)
    if materialize:
        base = cut_lineage(base)
    tagged = base.withColumn("__mid", F.monotonically_increasing_id())
    counts = (
        tagged.groupBy(F.shiftright("__mid", _POS_BITS).alias("__pid"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .collect()
    )
    # One row per non-empty partition: bounded by the partition count.
    pids = sorted((r["__pid"], r["__n"]) for r in counts)
    offsets = list(accumulate((n for _, n in pids), initial=0))
    rows = [(pid, off) for (pid, _), off in zip(pids, offsets)]
    off_df = spark.createDataFrame(rows, "__pid BIGINT, __off BIGINT")
    joined = tagged.join(
        F.broadcast(off_df),
        F.shiftright(tagged["__mid"], _POS_BITS) == off_df["__pid"],
        "inner",
    )
    row = (F.col("__off") + F.col("__mid").bitwiseAND(F.lit(_POS_MASK))).alias(name)
    return joined.select(row, *cols), offsets[-1]


def assign_ordinals(
    df: DataFrame,
    order_by: list[str | Column] | None = None,
    name: str = ROW,
    materialize: bool = True,
) -> DataFrame:
    """``numbered`` without the count."""
    return numbered(df, order_by, name, materialize)[0]


def reindexed(df: DataFrame, name: str = ROW, materialize: bool = True) -> tuple[DataFrame, int]:
    """Renumber ``name`` to 0..k-1 keeping its order, after a step left gaps;
    also k.

    ``df`` is evaluated once: it is materialised first, because a step may be
    costly or random and its rows are read three times here (pass False for an
    input that is cheap to read again and always the same).  No global
    sort: the order is in the values, so rows are cut into buckets of ``_row``
    (bucket counts -> small prefix table, broadcast) and numbered inside each
    bucket by a window partitioned by the bucket."""
    from gridframe.plans.running import bucket_width, span_of

    df = cut_lineage(df) if materialize else df
    w = bucket_width(span_of(df, name, None))
    b = F.floor(F.col(name) / F.lit(w)).cast("bigint")
    bucketed = df.withColumn("__b", b)
    # At most 2^17 buckets, by the choice of the width.
    counts = bucketed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).collect()
    counts = sorted((r["__b"], r["__n"]) for r in counts)
    ends = list(accumulate((n for _, n in counts), initial=0))
    offsets = df.sparkSession.createDataFrame(
        [(b, off) for (b, _), off in zip(counts, ends)], "__b BIGINT, __off BIGINT"
    )
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(name)) - 1
    out = bucketed.withColumn("__in", inner).join(F.broadcast(offsets), "__b")
    cols = [qc(c) for c in df.columns if c != name]
    return out.select((F.col("__off") + F.col("__in")).alias(name), *cols), ends[-1]


def dense_reindex(df: DataFrame, name: str = ROW) -> DataFrame:
    """``reindexed`` without the count."""
    return reindexed(df, name)[0]

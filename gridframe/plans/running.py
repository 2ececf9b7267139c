"""Bucketed scans: running sums and carry-forward without one-partition windows.

Rows are cut into buckets of ``width`` consecutive order values.  Each bucket
is scanned with an ordinary window partitioned by the bucket (many tasks);
bucket totals form a small table (rows / width) whose own scan gives each
bucket its carry-in, which is broadcast back.  A hot partition key is thus
split across buckets instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAX_BUCKETS = 1 << 17
_MIN_WIDTH = 1 << 12


def bucket_width(n_rows: int | None) -> int:
    """Bucket width keeping the bucket table under ``_MAX_BUCKETS`` rows."""
    return max(_MIN_WIDTH, math.ceil((n_rows or 0) / _MAX_BUCKETS))


def span_of(df: DataFrame, order_col: str, n_rows: int | None) -> int:
    """Upper bound of a non-negative order column: the given row count, or
    one aggregate when unknown, so the bucket table size is always bounded."""
    if n_rows is not None:
        return n_rows
    top = df.agg(F.max(order_col)).first()[0]
    return 0 if top is None else int(top) + 1


def running_sum(
    df: DataFrame,
    order_col: str,
    value: Column,
    out: str,
    n_rows: int | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Global running sum of ``value`` in ``order_col`` order (``order_col`` is
    a non-negative integer such as ``_row``)."""
    w = bucket_width(span_of(df, order_col, n_rows))
    b = F.floor(F.col(order_col) / F.lit(w)).cast("bigint")
    staged = df.withColumn("__b", b).withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0)))
    frame = Window.partitionBy("__b").orderBy(order_col)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = staged.withColumn("__in", F.coalesce(F.sum("__v").over(frame), F.lit(0)))
    totals = staged.groupBy("__b").agg(F.sum("__v").alias("__t"))
    # The bucket table has at most _MAX_BUCKETS rows: its scan is cheap and
    # its broadcast size is bounded.
    carry_w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__b", F.coalesce(F.sum("__t").over(carry_w), F.lit(0)).alias("__c"))
    joined = inner.join(F.broadcast(carry), "__b", "inner")
    return joined.withColumn(out, F.col("__c") + F.col("__in")).drop("__b", "__v", "__in", "__c")


def carry_last(
    df: DataFrame,
    keys: list[str],
    order_col: str,
    value: Column,
    pred: Column,
    out: str,
    width: int = 1 << 16,
) -> DataFrame:
    """For each row, ``out`` = struct(v) of ``value`` on the latest *earlier* row
    (same ``keys``, smaller ``order_col``) where ``pred`` holds; null if none.

    The struct wrapper distinguishes "no such row" (null) from "that row's
    value was null" (struct with a null field).
    """
    b = F.floor(F.col(order_col) / F.lit(width)).cast("bigint")
    marked = F.when(pred, F.struct(value.alias("v")))
    staged = df.withColumn("__b", b).withColumn("__m", marked)
    frame = (
        Window.partitionBy(*keys, "__b").orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = staged.withColumn("__in", F.last("__m", ignorenulls=True).over(frame))
    # One row per (keys, bucket) with the bucket's last marked value: an
    # aggregate, so partial aggregation absorbs hot keys before the shuffle.
    marked_order = F.when(F.col("__m").isNotNull(), F.col(order_col))
    per_bucket = staged.groupBy(*keys, "__b").agg(F.max_by("__m", marked_order).alias("__lb"))
    # Carry-in of a bucket = last marked value of the buckets before it.  The
    # bucket table has rows / width rows per key, so a hot key stays small.
    cw = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "__b", F.last("__lb", ignorenulls=True).over(cw).alias("__cb"))
    joined = inner.join(carry, keys + ["__b"], "left")
    return joined.withColumn(out, F.coalesce(F.col("__in"), F.col("__cb"))).drop(
        "__b", "__m", "__in", "__cb"
    )

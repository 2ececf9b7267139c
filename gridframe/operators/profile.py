"""Profiling (P1-P7): logical types, samples, counts, profile document,
context rows and schema comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridframe.functions.text import qc

from gridframe.plans.ordinals import ROW
from gridframe.sheet import Sheet

_INT = ("tinyint", "smallint", "int", "bigint")


def column_types_df(sheet: Sheet) -> DataFrame:
    """P1 + P4 as a lazy DataFrame: one row per column (position, name, type,
    non_null) from ONE aggregate; the one-row result is reshaped by ``inline``.

    unknown: no non-missing value; integer: integral type, booleans without
    nulls, or floating and decimal values that are all integral (``x % 1 = 0``,
    which is false for inf and never overflows); float; datetime; else string."""
    t = dict(sheet.df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(sheet.columns):
        x = qc(c)
        if t[c] in ("double", "float") or t[c].startswith("decimal"):
            x = F.when(~F.isnan(x), x) if t[c] in ("double", "float") else x
            aggs.append(F.bool_and(F.when(x.isNotNull(), (x % 1) == 0)).alias(f"i{i}"))
        aggs.append(F.count(x).alias(f"n{i}"))
    one = sheet.df.agg(*aggs)
    rows = []
    for i, c in enumerate(sheet.columns):
        n = F.col(f"n{i}")
        if t[c] in _INT:
            k = F.lit("integer")
        elif t[c] == "boolean":
            k = F.when(n == F.col("__rows"), "integer").otherwise("string")
        elif t[c] in ("double", "float") or t[c].startswith("decimal"):
            k = F.when(F.col(f"i{i}"), "integer").otherwise("float")
        elif t[c].startswith("timestamp") or t[c] == "date":
            k = F.lit("datetime")
        else:
            k = F.lit("string")
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                             F.when(n == 0, "unknown").otherwise(k).alias("type"), n.alias("non_null")))
    return one.select(F.inline(F.array(*rows)))


def first_candidates(df: DataFrame, order_key: str, k: int) -> DataFrame:
    """The rows of ``df`` that may hold one of the first ``k`` non-missing values
    (see ``blank_value``) of some column by ``order_key`` (a bigint).

    One pass.  A task keeps the k least places that it has met for each column
    and passes on the rows of a batch that are not behind them; in order, that
    is k rows a column for the whole task, in the reverse order k for each batch."""
    at = df.columns.index(order_key)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.zeros(0, np.int64)] * len(df_types)
        for batch in batches:
            place = batch.column(at).to_numpy(zero_copy_only=False)
            wanted = np.zeros(len(place), bool)
            for c, floating in enumerate(df_types):
                if c == at:
                    continue
                x = batch.column(c)
                missing = pc.fill_null(pc.is_nan(x), True) if floating else x.is_null()
                # Once k places are known, a column is looked at only where something lies before them.
                near = place <= least[c][-1] if len(least[c]) == k else np.ones(len(place), bool)
                some = np.flatnonzero(near & ~missing.to_numpy(zero_copy_only=False)) if near.any() else np.zeros(0, int)
                if len(some):
                    least[c] = np.sort(np.concatenate([least[c], place[some]]))[:k]
                    wanted[some[place[some] <= least[c][-1]]] = True
            yield batch.filter(pa.array(wanted))

    df_types = [t in ("double", "float") for _, t in df.dtypes]
    return df.mapInArrow(keep, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))


def sample_values(sheet: Sheet, k: int = 3) -> DataFrame:
    """First ``k`` non-missing values per column in row order, as text:
    position, rank (from 1), value, row.

    One scan: each task leaves a few candidate rows, whose cells alone are
    written as text, sorted and cut to k for each column."""
    plain = sheet.df.select(F.col(ROW).alias("row"), *[qc(c).alias(f"c{i}") for i, c in enumerate(sheet.columns)])
    t = dict(plain.dtypes)
    cells = [F.when(~blank_value(c, t[c]), (
        F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t[c].startswith("timestamp") else qc(c).cast("string")))
        for c in plain.columns[1:]]
    found = first_candidates(plain, "row", k).select("row", F.posexplode(
        F.array(*cells) if cells else F.array().cast("array<string>")).alias("position", "value"))
    first = Window.partitionBy("position").orderBy("row")
    ranked = found.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= k).select("position", "rank", "value", "row")


def blank_value(c: str, dtype: str):
    """Missing as a profile sees it: null or NaN, but not blank text."""
    x = qc(c)
    return x.isNull() | F.isnan(x) if dtype in ("double", "float") else x.isNull()


def sample_rows(sheet: Sheet, k: int = 5) -> DataFrame:
    """First ``k`` rows (TakeOrderedAndProject: top-k per task, merged)."""
    return sheet.df.orderBy(ROW).limit(k)


def profile_counts(sheet: Sheet) -> DataFrame:
    """Row and column counts."""
    return sheet.df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(sheet.n_cols).alias("column_count"))


def profile_document(sheet: Sheet) -> DataFrame:
    """P5: the whole profile as one JSON text (columns, sample_data, counts);
    an empty sheet gives only empty columns and sample_data."""
    types = column_types_df(sheet)
    samples = sample_values(sheet)
    cols = types.join(samples.groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s")), "position", "left")
    col_doc = cols.agg(F.array_sort(F.collect_list(F.struct(
        F.col("position"), F.col("name"), F.col("type"),
        F.coalesce(F.transform("s", lambda x: x.value), F.array().cast("array<string>")).alias("sample_values"),
    ))).alias("columns"))
    rows = sample_rows(sheet).drop(ROW)
    row_doc = rows.agg(F.collect_list(F.struct(*[qc(c) for c in rows.columns])).alias("sample_data"))
    counts = profile_counts(sheet)
    doc = col_doc.crossJoin(row_doc).crossJoin(counts)  # three one-row tables
    empty = F.col("row_count") == 0
    return doc.select(F.when(empty, F.to_json(F.struct(
        F.array().cast("array<string>").alias("columns"), F.array().cast("array<string>").alias("sample_data"))))
        .otherwise(F.to_json(F.struct(
            F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"),
                                                       c["sample_values"].alias("sample_values"))).alias("columns"),
            "sample_data", "row_count", "column_count"))).alias("profile"))


def profile_documents(df: DataFrame, sheet_key: str, order_key: str, k: int = 3, rows: int = 5) -> DataFrame:
    """P5 for many sheets at once: (sheet_key, profile), the JSON document of
    each sheet (columns with type and first ``k`` values, first ``rows`` rows,
    counts).

    Types and counts are one partial aggregate by sheet; the first values and
    rows are top-k windows, of which Spark keeps k rows for each group and task
    before the shuffle (WindowGroupLimit), so a hot sheet is not collected."""
    t = dict(df.dtypes)
    cols = [c for c in df.columns if c not in (sheet_key, order_key)]
    key = qc(sheet_key).alias("__sheet")
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.when(~blank_value(c, t[c]), 1)).alias(f"n{i}"))
        if t[c] in ("double", "float") or t[c].startswith("decimal"):
            aggs.append(F.bool_and(F.when(~blank_value(c, t[c]), (qc(c) % 1) == 0)).alias(f"i{i}"))
    counts = df.groupBy(key).agg(*aggs)

    def kind(i: int, c: str):
        if t[c] in _INT:
            k_ = F.lit("integer")
        elif t[c] == "boolean":
            k_ = F.when(F.col(f"n{i}") == F.col("row_count"), "integer").otherwise("string")
        elif t[c] in ("double", "float") or t[c].startswith("decimal"):
            k_ = F.when(F.col(f"i{i}"), "integer").otherwise("float")
        else:
            k_ = F.lit("datetime" if t[c].startswith("timestamp") or t[c] == "date" else "string")
        return F.when(F.col(f"n{i}") == 0, "unknown").otherwise(k_)

    text = [x for i, c in enumerate(cols) for x in (F.lit(i), F.when(~blank_value(c, t[c]), (
        F.date_format(qc(c), "yyyy-MM-dd HH:mm:ss") if t[c].startswith("timestamp") else qc(c).cast("string"))))]
    cells = df.select(key, qc(order_key).alias("__at"), F.stack(F.lit(len(cols)), *text).alias("position", "value"))
    w = Window.partitionBy("__sheet", "position").orderBy("__at")
    top = cells.where(F.col("value").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    # At most k values for each sheet and column.
    samples = top.groupBy("__sheet").agg(F.collect_list(F.struct("position", "__n", "value")).alias("__v"))
    first = df.select(key, qc(order_key).alias("__at"), F.struct(*[qc(c) for c in cols]).alias("__r"))
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("__sheet").orderBy("__at"))).where(F.col("__n") <= rows)
    first = first.groupBy("__sheet").agg(F.array_sort(F.collect_list(F.struct("__n", "__r"))).alias("__rows"))
    joined = counts.join(samples, "__sheet", "left").join(first, "__sheet")
    empty = F.array().cast(samples.schema["__v"].dataType)
    values = F.array_sort(F.coalesce("__v", empty))

    def samples_of(i: int):
        return F.transform(F.filter(values, lambda v: v["position"] == i), lambda v: v["value"])

    columns = F.array(*[
        F.struct(F.lit(c).alias("name"), kind(i, c).alias("type"), samples_of(i).alias("sample_values"))
        for i, c in enumerate(cols)])
    return joined.select(F.col("__sheet").alias(sheet_key), F.to_json(F.struct(
        columns.alias("columns"), F.transform("__rows", lambda r: r["__r"]).alias("sample_data"),
        "row_count", F.lit(len(cols)).alias("column_count"))).alias("profile"))


def stored_profiles(profiles: DataFrame, sheet_key: str, seq: int) -> DataFrame:
    """P10: the attribute writes that keep each session's target layout: its
    profile, its target rows and its column names, as (session_id, seq, key,
    value).  ``logs.session_attrs`` merges them: a later write overwrites."""
    doc = F.col("profile")
    names = F.to_json(F.transform(F.from_json(doc, "columns array<struct<name: string>>")["columns"], lambda c: c["name"]))
    pairs = F.array(
        F.struct(F.lit("target_profile").alias("key"), doc.alias("value")),
        F.struct(F.lit("target_rows").alias("key"), F.get_json_object(doc, "$.sample_data").alias("value")),
        F.struct(F.lit("target_names").alias("key"), names.alias("value")))
    return profiles.select(qc(sheet_key).alias("session_id"), F.lit(seq).cast("bigint").alias("seq"), F.inline(pairs))


def sheet_context(df: DataFrame, sheet_key: str, order_key: str, k: int = 5) -> DataFrame:
    """P6 for many sheets at once: per sheet, its headers, row count and first
    ``k`` records as JSON.  Top-k per group plans a WindowGroupLimit; counts
    are a partial aggregate, so a hot sheet is not collected."""
    value_cols = [c for c in df.columns if c != sheet_key]
    w = Window.partitionBy(sheet_key).orderBy(order_key)
    top = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    sample = top.groupBy(sheet_key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("__rn"), F.struct(*value_cols).alias("r")))).alias("__s"))
    counts = df.groupBy(sheet_key).agg(F.count(F.lit(1)).alias("rows"))
    j = counts.join(sample, sheet_key)
    return j.select(sheet_key, F.to_json(F.struct(
        F.array(*[F.lit(c) for c in value_cols]).alias("headers"), F.col("rows"),
        F.transform("__s", lambda x: x["r"]).alias("sample"))).alias("context"))


def normalized_name(c) -> object:
    """Name key for matching columns across layouts: lower case, a one-letter
    table prefix such as 'c_' dropped, non-alphanumerics removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "^[a-z]_", ""), "[^a-z0-9]", "")


def schema_compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer join of two profiles (``column_types`` output) on the
    normalised name: matched, type_changed, missing (target only), extra."""
    s = source.select(normalized_name(F.col("name")).alias("key"), F.col("name").alias("source_name"),
                      F.col("type").alias("source_type"), F.col("position").alias("source_position"))
    t = target.select(normalized_name(F.col("name")).alias("key"), F.col("name").alias("target_name"),
                      F.col("type").alias("target_type"), F.col("position").alias("target_position"))
    j = s.join(t, "key", "full_outer")
    status = (F.when(F.col("source_name").isNull(), "missing").when(F.col("target_name").isNull(), "extra")
              .when(F.col("source_type") == F.col("target_type"), "matched").otherwise("type_changed"))
    return j.withColumn("status", status)

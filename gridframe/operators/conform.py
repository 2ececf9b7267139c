"""Headers, conforming to a target layout and splitting stacked tables
(E6, E7, P8, P9; P10 is the session attribute merge in ``logs``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import blank, number_cast, qc
from gridframe.operators.address import index_to_letters
from gridframe.plans.ordinals import ROW
from gridframe.plans.running import carry_last, running_sum
from gridframe.session import cut_lineage
from gridframe.sheet import Sheet
from gridframe.sources.csv import header_names

#: Rows of a sheet that one task scans for the header above them.
SCAN_ROWS = 1 << 16

LOGICAL_TO_SPARK = {"integer": "bigint", "float": "double", "datetime": "timestamp_ntz",
                    "string": "string", "unknown": "string"}


def promote_header(sheet: Sheet) -> Sheet:
    """If any cell of row 0 is non-blank, row 0 becomes the header and
    leaves the data (``_row`` shifts down by one); else letter names.
    Blank header cells are named ``Column<n>`` (1-based position)."""
    first = sheet.df.where(F.col(ROW) == 0).select(*[qc(c).cast("string") for c in sheet.columns]).first()
    cells = list(first) if first is not None else []
    use = any(v is not None and v != "" for v in cells)
    if not use:
        names = [index_to_letters(i) for i in range(sheet.n_cols)]
        return Sheet(sheet.df.toDF(ROW, *names), sheet._n_rows)
    names = header_names([v if v not in (None, "") else f"Column{j + 1}" for j, v in enumerate(cells)])
    body = sheet.df.where(F.col(ROW) > 0).select(
        (F.col(ROW) - 1).alias(ROW), *[qc(c).alias(n) for c, n in zip(sheet.columns, names)])
    n = None if sheet._n_rows is None else sheet._n_rows - 1
    return Sheet(body, n)


def override_header(sheet: Sheet, names: list[str]) -> Sheet:
    """Apply names only when the counts match, else leave the sheet."""
    if len(names) != sheet.n_cols:
        return sheet
    return Sheet(sheet.df.toDF(ROW, *names), sheet._n_rows)


def conform(sheet: Sheet, target: list[tuple[str, str]], mapping: dict[str, str] | None = None
            ) -> tuple[Sheet, DataFrame]:
    """Reshape to ``target`` = [(name, logical type)] in target order.

    Source column per target: explicit ``mapping`` {target: source}, else the
    exact name, else the normalised name.  Values are ``try_cast`` to the
    target type; missing -> null; extra columns dropped.  Returns the sheet
    and one row per target column with its cast-failure count (one aggregate,
    lazily)."""
    mapping = mapping or {}
    norm = lambda s: _plain(re.sub(r"^[a-z]_", "", s.lower()))
    by_norm = {norm(c): c for c in sheet.columns}
    out, fails = [], []
    for name, logical in target:
        t = LOGICAL_TO_SPARK.get(logical, "string")
        src = mapping.get(name) or (name if name in sheet.columns else by_norm.get(norm(name)))
        if src is None:
            out.append(F.lit(None).cast(t).alias(name))
            fails.append(F.lit(0).cast("bigint").alias(name))
            continue
        v = number_cast(qc(src).cast("string"), t) if t != "string" else qc(src).cast("string")
        out.append(v.alias(name))
        fails.append(F.count(F.when(qc(src).isNotNull() & v.isNull(), 1)).alias(name))
    conformed = Sheet(sheet.df.select(ROW, *out), sheet._n_rows)
    failures = sheet.df.agg(*fails)
    return conformed, failures


def _header_key(names):
    return F.array_join(F.transform(names, lambda x: F.coalesce(
        F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.lit(""))), "|")


def split_stacked(sheet: Sheet) -> DataFrame:
    """Blank rows separate tables; the first row of each table is its
    header; tables with equal normalised headers are "similar".

    Table id = distributed running count of blank rows.  A row is a header if
    the row before it is blank (or there is none); headers travel to the rows
    of their table by the bucketed carry scan over ``_row``, so a huge table is
    spread over many tasks and no join has the table id as its key.  Only
    headers, one row for each table, are grouped to find similar ones.
    Output: table_id, similar_to (smallest table id with the same header
    key), header (array), _row (0-based within the table), cells."""
    t = dict(sheet.df.dtypes)
    is_blank = F.lit(True)
    for c in sheet.columns:
        is_blank = is_blank & blank(c, t[c])
    df = sheet.df.withColumn("__blank", is_blank.cast("int"))
    df = cut_lineage(running_sum(df, ROW, F.col("__blank"), "table_id", sheet._n_rows))
    names = F.array(*[qc(c).cast("string") for c in sheet.columns])
    df = carry_last(df.withColumn("__all", F.lit(0)), ["__all"], ROW, F.col("__blank"), F.lit(True), "__before", SCAN_ROWS)
    is_head = (F.col("__blank") == 0) & F.coalesce(F.col("__before.v") == 1, F.lit(True))
    df = cut_lineage(df.withColumn("__head", is_head))
    heads = df.where("__head").select("table_id", _header_key(names).alias("__key"))
    first = heads.groupBy("__key").agg(F.min("table_id").alias("similar_to"))
    heads = heads.join(first, "__key").select(F.col("table_id").alias("__tid"), "similar_to")
    # One row for each table: joined to the header rows only, then carried on.
    df = df.join(heads, (df["table_id"] == heads["__tid"]) & df["__head"], "left")
    head = F.struct(names.alias("names"), F.col(ROW).alias("at"), F.col("similar_to").alias("similar"))
    df = carry_last(df, ["__all"], ROW, head, F.col("__head"), "__hdr", SCAN_ROWS)
    out = df.where((F.col("__blank") == 0) & ~F.col("__head"))
    return out.select("table_id", F.col("__hdr.v.similar").alias("similar_to"), F.col("__hdr.v.names").alias("header"),
                      (F.col(ROW) - F.col("__hdr.v.at") - 1).alias(ROW), *[qc(c) for c in sheet.columns])


def union_similar(split: DataFrame, columns: list[str], similar_to: int, target: list[tuple[str, str]]) -> DataFrame:
    """The rows of all tables similar to table ``similar_to``, conformed to
    ``target`` = [(name, logical type)] and united: table_id, _row and the
    target columns.  A target column is matched by normalised name against the
    table's header; a name that the tables lack is null, as is what does not cast.

    Similar tables have equal normalised headers, so one header (one row) decides
    for all of them; nothing else reaches the driver."""
    mine = split.where(F.col("similar_to") == similar_to)
    one = mine.select("header").first()
    header = list(one["header"]) if one is not None else []
    at = {_plain(h): columns[i] for i, h in enumerate(header) if h is not None}
    out = []
    for name, logical in target:
        t = LOGICAL_TO_SPARK.get(logical, "string")
        src = at.get(_plain(name))
        out.append((number_cast(src, t) if src is not None else F.lit(None).cast(t)).alias(name))
    return mine.select("table_id", ROW, *out)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())

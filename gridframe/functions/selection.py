"""Selections as arrays of rectangles (A5 parser, A6 bounds, A7 formatter).

A rectangle is ``struct<r1, c1, r2, c2>`` (0-based, inclusive).  Whole-column
and whole-row parts leave ``r2`` / ``c2`` null ("to the end"), so parsing needs
no row count; ``resolve_rects`` fills them in from the sheet size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.functions.letters import column_index, column_letters

# Grammar of one selection part, tried in this order (fixed, from the spec):
# cell range A1:C3, column range A:C, row range 1:5, single cell A1 (any case),
# single column A, single row 1.
_CELL_RANGE = r"^([A-Z]+)([1-9][0-9]*):([A-Z]+)([1-9][0-9]*)$"
_COL_RANGE = r"^([A-Z]+):([A-Z]+)$"
_ROW_RANGE = r"^([1-9][0-9]*):([1-9][0-9]*)$"
_CELL = r"^([A-Za-z]+)([1-9][0-9]*)$"
_COL = r"^([A-Z]+)$"
_ROW = r"^([1-9][0-9]*)$"

RECT_TYPE = "struct<r1:bigint,c1:bigint,r2:bigint,c2:bigint>"


def _row_num(text: Column) -> Column:
    """1-based row text -> 0-based bigint, null when too long to be a bigint."""
    return F.when(F.length(text) <= 18, text.cast("bigint") - 1)


def _rect(r1, c1, r2, c2) -> Column:
    return F.struct(
        r1.cast("bigint").alias("r1"), c1.cast("bigint").alias("c1"),
        r2.cast("bigint").alias("r2"), c2.cast("bigint").alias("c2"),
    )


def _part_fields(p: Column) -> Column:
    """Stage 1: kind of the part and its raw letter / digit groups."""
    x = lambda pat, i: F.regexp_extract(p, pat, i)
    kind = (F.when(p.rlike(_CELL_RANGE), 1).when(p.rlike(_COL_RANGE), 2).when(p.rlike(_ROW_RANGE), 3)
            .when(p.rlike(_CELL), 4).when(p.rlike(_COL), 5).when(p.rlike(_ROW), 6).otherwise(0))
    l1 = (F.when(kind == 1, x(_CELL_RANGE, 1)).when(kind == 2, x(_COL_RANGE, 1))
          .when(kind == 4, x(_CELL, 1)).when(kind == 5, x(_COL, 1)))
    d1 = (F.when(kind == 1, x(_CELL_RANGE, 2)).when(kind == 3, x(_ROW_RANGE, 1))
          .when(kind == 4, x(_CELL, 2)).when(kind == 6, x(_ROW, 1)))
    l2 = F.when(kind == 1, x(_CELL_RANGE, 3)).when(kind == 2, x(_COL_RANGE, 2))
    d2 = F.when(kind == 1, x(_CELL_RANGE, 4)).when(kind == 3, x(_ROW_RANGE, 2))
    return F.struct(kind.alias("k"), l1.alias("l1"), d1.alias("d1"), l2.alias("l2"), d2.alias("d2"))


def _part_numbers(f: Column) -> Column:
    """Stage 2: each letter group and row number computed once."""
    c1 = F.when(f.l1.isNotNull(), column_index(f.l1))
    c2 = F.when(f.l2.isNotNull(), column_index(f.l2))
    return F.struct(f.k.alias("k"), c1.alias("c1"), _row_num(f.d1).alias("r1"),
                    c2.alias("c2"), _row_num(f.d2).alias("r2"))


def _part_rect(n: Column) -> Column:
    """Stage 3: the rectangle (null when the part is invalid)."""
    k, c1, r1, c2, r2 = n.k, n.c1, n.r1, n.c2, n.r2
    ok1 = (c1 >= 0) & r1.isNotNull()
    return (
        F.when((k == 1) & ok1 & (c2 >= 0) & r2.isNotNull(),
               _rect(F.least(r1, r2), F.least(c1, c2), F.greatest(r1, r2), F.greatest(c1, c2)))
        .when((k == 2) & (c1 >= 0) & (c2 >= 0), _rect(F.lit(0), F.least(c1, c2), F.lit(None), F.greatest(c1, c2)))
        .when((k == 3) & r1.isNotNull() & r2.isNotNull(),
              _rect(F.least(r1, r2), F.lit(0), F.greatest(r1, r2), F.lit(None)))
        .when((k == 4) & ok1, _rect(r1, c1, r1, c1))
        .when((k == 5) & (c1 >= 0), _rect(F.lit(0), c1, F.lit(None), c1))
        .when((k == 6) & r1.isNotNull(), _rect(r1, F.lit(0), r1, F.lit(None)))
    )


def parse_selection(text: str | Column) -> Column:
    """Comma list of parts -> array of rectangles; null if any part is blank or
    invalid (the whole selection is rejected, as in the spec).  Blank text ->
    empty array.  Three ``transform`` stages keep every regex and letter fold
    evaluated once per part."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(t, ","), lambda s: F.trim(s))
    rects = F.transform(F.transform(F.transform(parts, _part_fields), _part_numbers), _part_rect)
    return (
        F.when(t.isNull(), F.lit(None))
        .when(F.trim(t) == "", F.array().cast(f"array<{RECT_TYPE}>"))
        .when(F.exists(rects, lambda r: r.isNull()), F.lit(None))
        .otherwise(rects)
    )


def resolve_rects(rects: Column, n_rows: Column, n_cols: Column) -> Column:
    """Fill open ends (null r2/c2) with the last row/column of the sheet."""
    return F.transform(
        rects,
        lambda r: _rect(r.r1, r.c1, F.coalesce(r.r2, n_rows - 1), F.coalesce(r.c2, n_cols - 1)),
    )


def selection_in_bounds(rects: Column, n_rows: Column, n_cols: Column) -> Column:
    """False if any rectangle leaves the sheet (null for an invalid selection)."""
    res = resolve_rects(rects, n_rows, n_cols)
    return ~F.exists(res, lambda r: (r.r1 < 0) | (r.c1 < 0) | (r.r2 >= n_rows) | (r.c2 >= n_cols))


def format_selection(rects: Column, n_rows: Column, n_cols: Column) -> Column:
    """Rectangles -> text.  Whole columns first ('A', 'A:C'), then whole rows
    ('1', '1:3'), else 'A1' or 'A1:C3'; joined by ', '; '-' when empty.  The
    two letter strings of each rectangle are built once, in a staging
    ``transform``."""
    res = resolve_rects(rects, n_rows, n_cols)
    staged = F.transform(res, lambda r: F.struct(
        r.r1.alias("r1"), r.c1.alias("c1"), r.r2.alias("r2"), r.c2.alias("c2"),
        column_letters(r.c1).alias("a"), column_letters(r.c2).alias("b")))

    def one(r: Column) -> Column:
        start = F.concat(r.a, (r.r1 + 1).cast("string"))
        end = F.concat(r.b, (r.r2 + 1).cast("string"))
        single = (r.r1 == r.r2) & (r.c1 == r.c2)
        plain = F.when(single, start).otherwise(F.concat(start, F.lit(":"), end))
        sized = (n_rows > 0) & (n_cols > 0)
        full_col = sized & (r.r1 == 0) & (r.r2 == n_rows - 1)
        full_row = sized & (r.c1 == 0) & (r.c2 == n_cols - 1)
        col_txt = F.when(r.c1 == r.c2, r.a).otherwise(F.concat(r.a, F.lit(":"), r.b))
        row_txt = F.when(r.r1 == r.r2, (r.r1 + 1).cast("string")).otherwise(
            F.concat((r.r1 + 1).cast("string"), F.lit(":"), (r.r2 + 1).cast("string")))
        return F.when(full_col, col_txt).when(full_row, row_txt).otherwise(plain)

    return F.when(F.size(res) == 0, F.lit("-")).otherwise(F.array_join(F.transform(staged, one), ", "))

"""Cleaning (C1-C6): blank rows and columns, rows by example, ISO dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridframe.functions.text import qc

from gridframe.functions.text import blank, iso_to_date_text, value_shape
from gridframe.plans.ordinals import ROW, reindexed
from gridframe.sheet import Sheet


def _dtypes(sheet: Sheet) -> dict[str, str]:
    return dict(sheet.df.dtypes)


def drop_blank_rows(sheet: Sheet) -> Sheet:
    """Drop rows whose cells are all null, NaN or whitespace; reindex."""
    t = _dtypes(sheet)
    keep = None
    for c in sheet.columns:
        nb = ~blank(c, t[c])
        keep = nb if keep is None else keep | nb
    kept = sheet.df.where(keep if keep is not None else F.lit(False))
    return Sheet(*reindexed(kept))


def drop_blank_cols(sheet: Sheet) -> Sheet:
    """Drop columns with no non-blank cell (one aggregate); a sheet with
    no rows keeps every column."""
    t = _dtypes(sheet)
    aggs = [F.count(F.when(~blank(c, t[c]), F.lit(1))).alias(f"n{i}") for i, c in enumerate(sheet.columns)]
    row = sheet.df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    if row["rows"] == 0:
        return sheet
    keep = [c for i, c in enumerate(sheet.columns) if row[f"n{i}"] > 0]
    return Sheet(sheet.df.select(ROW, *[qc(c) for c in keep]), row["rows"])


def shape_of(example: str) -> str:
    """Driver twin of ``value_shape`` for literal examples."""
    import re

    s = re.sub(r"[0-9]+", "9", example)
    return re.sub(r"[^\W\d_]+(?:\s+[^\W\d_]+)*", "A", s)


def keep_rows_by_example(sheet: Sheet, examples: list[str]) -> Sheet:
    """C4: keep a row if, for every example, some cell has the example's shape."""
    shapes = F.array(*[value_shape(c) for c in sheet.columns])
    cond = F.lit(True)
    for s in sorted({shape_of(e) for e in examples}):
        cond = cond & F.coalesce(F.array_contains(shapes, F.lit(s)), F.lit(False))
    return Sheet(*reindexed(sheet.df.where(cond)))


def iso_to_date(sheet: Sheet) -> Sheet:
    """ISO date-time text -> its date part; timestamp columns -> date."""
    t = _dtypes(sheet)
    out = []
    for c in sheet.columns:
        if t[c] == "string":
            out.append(iso_to_date_text(c).alias(c))
        elif t[c].startswith("timestamp"):
            out.append(F.to_date(qc(c)).alias(c))
        else:
            out.append(qc(c))
    return Sheet(sheet.df.select(ROW, *out), sheet._n_rows)

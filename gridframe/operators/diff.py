"""Modified-cell diff (D1) between two versions of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import qc

from gridframe.plans.ordinals import ROW
from gridframe.sheet import Sheet

_NUM = ("tinyint", "smallint", "int", "bigint", "float", "double")


_INT = ("tinyint", "smallint", "int", "bigint", "boolean")


def _kind(t: str) -> str:
    if t in _NUM or t.startswith("decimal") or t == "boolean":
        return "num"
    if t.startswith("timestamp") or t == "date":
        return "time"
    if t == "string":
        return "text"
    return "other"


def _numbers_differ(a: Column, ta: str, b: Column, tb: str) -> Column:
    """Whether two numbers differ in value.  Integers are compared as integers
    and decimals as decimals; an integer and a floating value are equal only
    if they are so as floating values *and* as exact integers."""
    a, b = (x.cast("int") if t == "boolean" else x for x, t in ((a, ta), (b, tb)))
    fa, fb = ta in ("double", "float"), tb in ("double", "float")
    if fa == fb:
        return a != b
    near = a.cast("double") != b.cast("double")
    whole, real = (b, a) if fa else (a, b)
    if (tb if fa else ta) in _INT:
        return F.when(near, F.lit(True)).otherwise(whole.cast("decimal(38,0)") != real.try_cast("decimal(38,0)"))
    return near


def _missing(c: Column, t: str) -> Column:
    return c.isNull() | F.isnan(c) if t in ("double", "float") else c.isNull()


def _unequal(a: Column, ta: str, b: Column, tb: str) -> Column:
    """Null-aware "modified" flag: both missing -> equal; one missing ->
    modified; numbers compare by exact value across types; text vs number is
    always modified (decided from the two types, never a mixed compare)."""
    ma, mb = _missing(a, ta), _missing(b, tb)
    ka, kb = _kind(ta), _kind(tb)
    if ka == kb == "num":
        ne = _numbers_differ(a, ta, b, tb)
    elif ka == kb and ka in ("text", "time"):
        ne = a != b
    elif ka == kb:
        ne = a.cast("string") != b.cast("string")
    else:
        ne = F.lit(True)
    return F.when(ma & mb, F.lit(False)).when(ma | mb, F.lit(True)).otherwise(ne)


def modified_cells(old: Sheet, new: Sheet) -> DataFrame:
    """(row, col) cells of ``new`` that differ from ``old``.

    * columns absent before: every row of them;
    * common columns (by name): rows present in both, compared null-aware;
    * only changed cells are exploded, never every cell."""
    to, tn = dict(old.df.dtypes), dict(new.df.dtypes)
    new_cols = new.columns
    common = [c for c in new_cols if c in to]
    added = [new_cols.index(c) for c in new_cols if c not in to]
    parts = []
    if common:
        o = old.df.select(ROW, *[qc(c).alias(f"o{i}") for i, c in enumerate(common)])
        n = new.df.select(ROW, *[qc(c).alias(f"n{i}") for i, c in enumerate(common)])
        j = o.join(n, ROW, "inner")
        flags = [F.when(_unequal(F.col(f"o{i}"), to[c], F.col(f"n{i}"), tn[c]), F.lit(new_cols.index(c)).cast("bigint"))
                 for i, c in enumerate(common)]
        hits = F.filter(F.array(*flags), lambda x: x.isNotNull())
        parts.append(j.select(F.col(ROW).alias("row"), F.explode(hits).alias("col")))
    if added:
        parts.append(new.df.select(F.col(ROW).alias("row"),
                                   F.explode(F.array(*[F.lit(i).cast("bigint") for i in added])).alias("col")))
    if not parts:
        spark = new.df.sparkSession
        return spark.createDataFrame([], "row bigint, col bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

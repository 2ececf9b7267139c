"""Positional edits (E1-E14): one distributed pass per batch.

A batch is a list of structural edits (dicts ``{type: row|col, action:
create|remove, index, amount, seq}``, small, folded on the driver by the
piece table) plus an optional DataFrame of cell edits ``(seq, row, col,
new_value)`` that stays distributed.  Edits apply in ``seq`` order: a cell
edit addresses the sheet as it is after the structural edits before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import number_cast, qc

from gridframe.plans.ordinals import ROW
from gridframe.plans.pieces import EditError, PieceTable, compile_edits, map_by_segments, size_before, stable_place
from gridframe.plans.running import carry_last
from gridframe.session import cut_lineage
from gridframe.sheet import Sheet

__all__ = [
    "EditError", "BatchResult", "apply_batch", "update_cells", "insert_rows", "remove_rows",
    "insert_cols", "remove_cols", "drop_cols_by_letters", "derived_sum", "blank_template",
    "error_column", "append_row",
]

_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


@dataclass
class BatchResult:
    sheet: Sheet
    touched: DataFrame | None  # (seq, row, col) per effective cell edit


def _resolve_types(pt: PieceTable, types: dict[str, str], applied: DataFrame) -> dict[int, str]:
    """Type per column key: a source column keeps its type when every value
    that is applied to it reads as that type, else it widens to string; a column
    that has no edit keeps its type.  One aggregate decides."""
    src = {k: types[c] for k, c in enumerate(pt.source_columns)}
    flags = []
    for k, t in src.items():
        mine = F.col("__ck") == k
        bad = mine & F.col("new_value").isNotNull() & number_cast("new_value", t).isNull()
        flags += [F.max(mine.cast("int")).alias(f"e{k}"), F.max(bad.cast("int")).alias(f"b{k}")]
    row = applied.agg(*flags).first() if flags else None
    resolved = {}
    for k, t in src.items():
        plain = t in _NUMERIC or t.startswith(("timestamp", "date", "boolean", "decimal"))
        resolved[k] = t if not row[f"e{k}"] or (plain and not row[f"b{k}"]) else "string"
    for k in pt.col_names:
        resolved.setdefault(k, "string")  # inserted columns start empty: text
    return resolved


def _norm(c: Column, t: str) -> Column:
    """Canonical text of a value in type ``t`` (NaN is missing)."""
    if t == "string":
        return c.cast("string")
    v = number_cast(c.cast("string"), t)
    if t in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    return v.cast("string")


def _by_key(keys: list[int], value) -> Column:
    """``value(k)`` of the row's column key."""
    expr = F.lit(None).cast("string")
    for k in keys:
        expr = F.when(F.col("__ck") == k, value(k)).otherwise(expr)
    return expr


def _effective_edits(ids: DataFrame, pt: PieceTable, types: dict[str, str], cells: DataFrame
                     ) -> tuple[DataFrame, dict[int, str]]:
    """Cell edits that address a cell, with the value that each leaves
    (``__ev``) and whether that changes the cell; and the columns' types."""
    n_cols = len(pt.source_columns)
    c = cells.select(*[F.col(x).cast("bigint").alias(x) for x in ("seq", "row", "col")],
                     F.col("new_value").cast("string").alias("new_value"))
    n_r, n_c = size_before(F.col("seq"), pt, n_cols)
    # Out-of-range cells are skipped, as in the original.
    c = c.where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < n_r) & (F.col("col") < n_c))
    c = c.withColumn("__id", stable_place(F.col("row"), F.col("seq"), pt.row_edits))
    c = c.withColumn("__ck", stable_place(F.col("col"), F.col("seq"), pt.col_edits))
    # sheet RIGHT JOIN edits: the edit side may be broadcast (AQE, runtime
    # size) so a small batch never shuffles the whole sheet.
    base = ids.select("__id", *[qc(x).alias(f"__s{k}") for k, x in enumerate(pt.source_columns)])
    orig = _by_key(list(range(n_cols)), lambda k: _norm(F.col(f"__s{k}"), types[pt.source_columns[k]]))
    c = base.join(c, "__id", "right").select("seq", "row", "col", "new_value", "__id", "__ck", orig.alias("__orig"))
    c = cut_lineage(c)  # located once, read several times

    # '' on a missing cell leaves it missing: the last earlier edit that is not
    # '' tells whether the cell has a value, else the original does.
    is_value = F.col("new_value").isNull() | (F.col("new_value") != "")
    c = carry_last(c, ["__id", "__ck"], "seq", F.col("new_value"), is_value, "__anc")
    present = F.when(F.col("__anc").isNotNull(), F.col("__anc.v").isNotNull()).otherwise(F.col("__orig").isNotNull())
    c = cut_lineage(c.withColumn("__applied", is_value | present).drop("__anc"))
    resolved = _resolve_types(pt, types, c.where("__applied"))
    new = _by_key(sorted(pt.col_names), lambda k: _norm(F.col("new_value"), resolved[k]))
    ev = F.when(F.col("new_value") == "", F.when(F.col("__applied"), F.lit(""))).otherwise(new)
    c = carry_last(c.withColumn("__ev", ev), ["__id", "__ck"], "seq", F.col("__ev"), F.lit(True), "__prev")
    prev = F.when(F.col("__prev").isNotNull(), F.col("__prev.v")).otherwise(F.col("__orig"))
    c = c.withColumn("__changed", ~F.col("__ev").eqNullSafe(prev))
    return cut_lineage(c.select("seq", "row", "col", "__id", "__ck", "__ev", "__changed")), resolved


def apply_batch(sheet: Sheet, structural: list[dict] | None = None,
                cells: DataFrame | None = None) -> BatchResult:
    """Apply an ordered mixed batch in one pass; invalid structural edits
    reject the whole batch (raised before any plan is built)."""
    structural = sorted(structural or [], key=lambda e: e.get("seq", 0))
    n = sheet.n_rows
    pt = compile_edits(n, sheet.columns, structural)
    spark = sheet.df.sparkSession
    types = dict(sheet.df.dtypes)
    src_cols = pt.source_columns

    # Stable-id table: source rows (id = old _row) and inserted blank rows.
    ids = sheet.df.withColumnRenamed(ROW, "__id")
    if pt.next_id > n:
        blanks = spark.range(n, pt.next_id).withColumnRenamed("id", "__id")
        blanks = blanks.select("__id", *[F.lit(None).cast(types[c]).alias(c) for c in src_cols])
        ids = ids.unionByName(blanks)

    touched = None
    resolved = {k: types[c] for k, c in enumerate(src_cols)}
    edited_keys: list[int] = []
    if cells is not None:
        c, resolved = _effective_edits(ids, pt, types, cells)
        edited_keys = sorted(pt.col_names)
        touched = c.where("__changed").select("seq", "row", "col")
        # Last writer per cell, then one row per stable id (pivot of cells).
        last = c.groupBy("__id", "__ck").agg(F.max_by(F.struct(F.col("__ev").alias("v")), "seq").alias("__last"))
        per_row = last.groupBy("__id").agg(*[
            F.first(F.when(F.col("__ck") == k, F.col("__last")), ignorenulls=True).alias(f"__e{k}")
            for k in edited_keys])
        ids = ids.join(per_row, "__id", "left")

    # Columns in final order: overlay edited cells, cast to resolved types.
    out_cols = []
    for k in pt.col_keys:
        name = pt.col_names[k]
        t = resolved.get(k, "string")
        if k < len(src_cols):
            base_v = qc(src_cols[k])
            base_v = base_v if types[src_cols[k]] == t else _norm(base_v, types[src_cols[k]]).cast(t)
        else:
            base_v = F.lit(None).cast(t)
        if k in edited_keys:
            e = F.col(f"__e{k}")
            v = F.when(e.isNotNull(), e.getField("v").try_cast(t) if t != "string" else e.getField("v")).otherwise(base_v)
        else:
            v = base_v
        out_cols.append(v.alias(name))

    final = pt.positioned()
    identity = final == [(0, 0, n)] or (n == 0 and not final)
    if identity:
        out = ids.select(F.col("__id").alias(ROW), *out_cols)
    else:
        segs = [(id0, ln, p0) for (p0, id0, ln) in final]
        mapped = map_by_segments(ids, F.col("__id"), segs, ROW)
        out = mapped.select(ROW, *out_cols)
    return BatchResult(Sheet(out, pt.n_rows), touched)


# -- single-edit wrappers -------------------------------------------------------
def update_cells(sheet: Sheet, cells: DataFrame) -> BatchResult:
    """Cell edits only (last writer wins per cell)."""
    return apply_batch(sheet, [], cells)


def insert_rows(sheet: Sheet, index: int, amount: int = 1) -> Sheet:
    """Blank rows at ``index`` (beyond the end appends)."""
    return apply_batch(sheet, [{"type": "row", "action": "create", "index": index, "amount": amount}]).sheet


def remove_rows(sheet: Sheet, index: int, amount: int = 1) -> Sheet:
    """Remove ``[index, index+amount)``; out of range raises."""
    return apply_batch(sheet, [{"type": "row", "action": "remove", "index": index, "amount": amount}]).sheet


def insert_cols(sheet: Sheet, index: int, amount: int = 1) -> Sheet:
    """``amount`` empty columns at ``index`` (each at the same index)."""
    return apply_batch(sheet, [{"type": "col", "action": "create", "index": index, "amount": amount}]).sheet


def remove_cols(sheet: Sheet, index: int, amount: int = 1) -> Sheet:
    """Remove columns ``[index, index+amount)`` (clipped)."""
    return apply_batch(sheet, [{"type": "col", "action": "remove", "index": index, "amount": amount}]).sheet


def drop_cols_by_letters(sheet: Sheet, letters: list[str]) -> Sheet:
    """Resolve every letter first, then drop those positions at once; letters
    past the last column are refused."""
    from gridframe.operators.address import letters_to_index

    idx = {letters_to_index(s) for s in letters}
    if -1 in idx or max(idx, default=-1) >= sheet.n_cols:
        raise EditError(f"bad column letters {letters}")
    keep = [c for i, c in enumerate(sheet.columns) if i not in idx]
    return Sheet(sheet.df.select(ROW, *[qc(c) for c in keep]), sheet._n_rows)


def _operand(sheet: Sheet, ref: str) -> Column:
    from gridframe.operators.address import letters_to_index

    if ref in sheet.columns:
        return qc(ref)
    i = letters_to_index(ref)
    if 0 <= i < sheet.n_cols:
        return qc(sheet.columns[i])
    raise EditError(f"unknown column {ref!r}")


def derived_sum(sheet: Sheet, a: str, b: str, name: str) -> Sheet:
    """E5: new column = a + b (null-propagating); operands by letter or name."""
    return Sheet(sheet.df.withColumn(name, _operand(sheet, a) + _operand(sheet, b)), sheet._n_rows)


def blank_template(sheet: Sheet) -> Sheet:
    """Same shape and types, every cell null."""
    types = dict(sheet.df.dtypes)
    return Sheet(sheet.df.select(ROW, *[F.lit(None).cast(types[c]).alias(c) for c in sheet.columns]), sheet._n_rows)


def error_column(sheet: Sheet, message: str) -> Sheet:
    """Constant ``ERROR`` column carrying a failure message."""
    return Sheet(sheet.df.withColumn("ERROR", F.lit(f"Failed to process command: {message}")), sheet._n_rows)


def append_row(sheet: Sheet, values: dict | None = None) -> Sheet:
    """One row at ``_row = n`` (null, or the given values by column name)."""
    spark = sheet.df.sparkSession
    types = dict(sheet.df.dtypes)
    values = values or {}
    one = spark.range(1).select(F.lit(sheet.n_rows).cast("bigint").alias(ROW), *[
        F.lit(values.get(c)).cast(types[c]).alias(c) for c in sheet.columns])
    return Sheet(sheet.df.unionByName(one), sheet.n_rows + 1)

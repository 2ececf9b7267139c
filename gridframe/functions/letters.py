"""Column letters and cell ids as native column expressions (A2, A3, A4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that any BIGINT column index needs at most.
MAX_LETTERS = 14
# 26^13 < 2^63: longer letter strings would overflow a BIGINT.
_MAX_PARSE_LETTERS = 13


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def column_letters(index: str | Column, max_letters: int = MAX_LETTERS) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA (bijective base 26); null for null/negative.

    Letter j (from the right) exists when n >= 26 + ... + 26^j and equals
    ((n - (26 + ... + 26^j)) div 26^j) mod 26: each letter reads n once, so
    the expression stays linear in ``max_letters``."""
    n = _c(index).cast("bigint")
    chars = []
    for j in range(max_letters):
        lo = sum(26**i for i in range(1, j + 1))
        digit = F.pmod(F.call_function("div", n - F.lit(lo), F.lit(26**j)), F.lit(26))
        chars.append(F.when(n >= lo, F.char(F.lit(65) + digit)).otherwise(F.lit("")))
    return F.when(n >= 0, F.concat(*reversed(chars)))


def letters_sql(expr: str, max_letters: int = 3) -> str:
    """DuckDB text for ``column_letters`` (oracle only), ``max_letters`` digits."""
    parts = []
    for k in range(max_letters):
        lo = sum(26**i for i in range(1, k + 1))  # indexes below lo have < k+1 letters
        digit = f"(({expr} - {lo}) // {26**k}) % 26"
        parts.append(f"CASE WHEN {expr} >= {lo} THEN chr(65 + CAST({digit} AS INTEGER)) ELSE '' END")
    return "(" + " || ".join(reversed(parts)) + ")"


def column_index(letters: str | Column) -> Column:
    """Letters -> 0-based column index, case-insensitive; -1 on bad input."""
    s = _c(letters)
    folded = F.aggregate(
        F.split(F.upper(s), ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: acc * 26 + F.ascii(ch) - 64,
    )
    ok = s.rlike("^[A-Za-z]+$") & (F.length(s) <= _MAX_PARSE_LETTERS)
    return F.when(s.isNull(), F.lit(-1).cast("bigint")).when(ok, folded - 1).otherwise(F.lit(-1).cast("bigint"))


_CELL_RE = r"^([A-Za-z]+)([1-9][0-9]*)$"


def parse_cell_id(cell: str | Column) -> Column:
    """'B3' -> struct(row=2, col=1) (rows 1-based in text); null if malformed."""
    s = F.trim(_c(cell))
    letters = F.regexp_extract(s, _CELL_RE, 1)
    digits = F.regexp_extract(s, _CELL_RE, 2)
    row = F.when(F.length(digits) <= 18, digits.cast("bigint") - 1)
    col = column_index(letters)
    ok = s.rlike(_CELL_RE) & row.isNotNull() & (col >= 0)
    return F.when(ok, F.struct(row.alias("row"), col.alias("col")))


def cell_id(row: str | Column, col: str | Column) -> Column:
    """(row, col) 0-based -> 'A1' text."""
    return F.concat(column_letters(col), (_c(row) + 1).cast("string"))

"""Small text rules used by cleaning and log operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qc(name: str) -> Column:
    """Column by exact name (dots and other specials quoted)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _c(x: str | Column) -> Column:
    return qc(x) if isinstance(x, str) else x


def blank(c: str | Column, dtype: str = "string") -> Column:
    """True when a cell is missing: null, NaN (floating columns), or
    whitespace-only text (string columns)."""
    x = _c(c)
    if dtype in ("double", "float"):
        return x.isNull() | F.isnan(x)
    if dtype == "string":
        return x.isNull() | (F.regexp_replace(x, r"(?U)\s", "") == "")
    return x.isNull()


def strip(c: str | Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# A number as text, of any size (fixed pattern): integers, and decimals with
# an optional exponent or one of the names of non-finite values.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*([e][+-]?[0-9]+)?|\.[0-9]+([e][+-]?[0-9]+)?|inf(inity)?|nan)\s*$"


def number_cast(c: str | Column, dtype: str) -> Column:
    """``try_cast`` of text to ``dtype``; for numeric types only of what reads
    as a number, so that a suffix as in '2d' stays text."""
    x = _c(c)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.when(x.rlike(INTEGER), F.trim(x)).try_cast(dtype)
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return F.when(x.rlike(NUMBER), F.trim(x)).try_cast(dtype)
    return x.try_cast(dtype)


def value_shape(c: str | Column) -> Column:
    """C4 shape of a value: digit runs -> '9', letter runs (words joined by
    blanks count as one run) -> 'A'; other characters stay."""
    x = _c(c).cast("string")
    digits = F.regexp_replace(x, r"[0-9]+", "9")
    return F.regexp_replace(digits, r"(?U)\p{L}+(?:\s+\p{L}+)*", "A")


def shape_sql(expr: str) -> str:
    """DuckDB text for ``value_shape`` (oracle only; ASCII letters)."""
    return (
        f"regexp_replace(regexp_replace(CAST({expr} AS VARCHAR), '[0-9]+', '9', 'g'), "
        f"'[A-Za-z]+(\\s+[A-Za-z]+)*', 'A', 'g')"
    )


# ISO date-time text 'YYYY-MM-DDTHH:MM:SS' (optional fraction); fixed pattern.
ISO_DATETIME = r"^(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}:\d{2}(\.\d+)?$"


def iso_to_date_text(c: str | Column) -> Column:
    """ISO date-time text -> its date part; other text unchanged."""
    x = _c(c)
    return F.regexp_replace(x, ISO_DATETIME, "$1")


# First fenced block, optional 'python' tag (fixed pattern of the spec).
FENCE = r"```(?:python)?\s*([\s\S]*?)\s*```"


def code_block(c: str | Column) -> Column:
    """First fenced code block (stripped); without a fence, the trimmed text."""
    x = _c(c)
    return F.when(x.rlike(FENCE), strip(F.regexp_extract(x, FENCE, 1))).otherwise(strip(x))

"""Command tags (A9 extraction, A10 rewriting) as native regex expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the spec (must equal the original's for equal text).
TAG = r"(?i)#([A-Z0-9:]+)"
_REF = r"[A-Z]+[0-9]*:[A-Z]+[0-9]*|[A-Z]+:[A-Z]+|[0-9]+:[0-9]+"
RANGE_LIST = r"(?U)#((?:" + _REF + r")(?:\s*,\s*(?:" + _REF + r"))*)"
SINGLE_RULES = [
    (r"#([A-Z]+)([0-9]+)", "cell $1$2"),
    (r"#([A-Z]+[0-9]+):#([A-Z]+[0-9]+)", "range from $1 to $2"),
    (r"(?U)#([A-Z]+)(?!\d|:)", "column $1"),
    (r"#([0-9]+)(?!:)", "row $1"),
    (r"#([A-Z]+):#([A-Z]+)", "columns from $1 to $2"),
    (r"#([0-9]+):#([0-9]+)", "rows from $1 to $2"),
]

# Marker characters delimiting a matched range list while it is rewritten.
_OPEN, _CLOSE = "\u0001", "\u0002"


def extract_tags(text: str | Column) -> Column:
    """Every ``#ref`` (any case), joined by ', '."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.regexp_extract_all(t, F.lit(TAG), 1), ", ")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _rewrite_list(chunk: Column) -> Column:
    """'<list>\u0002rest' -> 'cells in range from X to Y, ...' + rest."""
    head = F.substring_index(chunk, _CLOSE, 1)
    tail = F.substring(chunk, F.length(head) + 2, 1 << 30)
    refs = F.transform(
        F.split(head, ","),
        lambda r: F.concat(
            F.lit("range from "), _strip(F.split_part(_strip(r), F.lit(":"), F.lit(1))),
            F.lit(" to "), _strip(F.split_part(_strip(r), F.lit(":"), F.lit(2))),
        ),
    )
    return F.concat(F.lit("cells in "), F.array_join(refs, ", "), tail)


def rewrite_tags(text: str | Column) -> Column:
    """A10: rewrite ``#`` references into words, keeping the original's quirks
    (rule order makes '#A1:#B2' -> 'cell A1:cell B2')."""
    t = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(t, RANGE_LIST, _OPEN + "$1" + _CLOSE)
    chunks = F.split(marked, _OPEN)
    first = F.element_at(chunks, 1)
    rest = F.transform(F.slice(chunks, 2, 1 << 30), _rewrite_list)
    out = F.concat(first, F.array_join(rest, ""))
    for pat, rep in SINGLE_RULES:
        out = F.regexp_replace(out, pat, rep)
    return out

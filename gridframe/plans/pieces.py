"""Piece table for ordered edit batches.

Structural edits (row/column insert and remove) fold on the driver into
*segments*: runs of consecutive stable row ids laid out in position order.
Source rows keep their old ``_row`` as stable id; inserted blank rows get
fresh ids after the last source row.  Columns fold the same way into a list
of stable column keys.  Work on the driver is per edit, never per row.

A cell edit addresses the sheet as laid out after the structural edits before
it.  Its place is mapped back to the stable row id and column key by undoing
those edits, latest first (``stable_place``).  Runs of edits are composed into
single maps beforehand (``undo_tree``): the executors get one map for each
aligned run, in all S log S segments for S edits, and a cell edit searches one
map for each bit of the number of edits before it.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW_COLUMN = "New Column"


class EditError(ValueError):
    """An invalid structural edit: the whole batch is rejected."""


@dataclass
class PieceTable:
    n_source_rows: int
    source_columns: list[str]
    n_rows: int = 0
    next_id: int = 0
    col_keys: list[int] = field(default_factory=list)
    col_names: dict[int, str] = field(default_factory=dict)
    # What cell edits need: row and column edits as (seq, insert?, index,
    # amount, first id) and the sheet's size after each structural edit.
    row_edits: list[tuple[int, bool, int, int, int]] = field(default_factory=list)
    col_edits: list[tuple[int, bool, int, int, int]] = field(default_factory=list)
    sizes: list[tuple[int, int, int]] = field(default_factory=list)  # (seq, rows, columns)

    @classmethod
    def start(cls, n_rows: int, columns: list[str]) -> "PieceTable":
        pt = cls(n_rows, list(columns), n_rows, n_rows)
        pt._ids = np.array([0] if n_rows else [], np.int64)
        pt._lengths = np.array([n_rows] if n_rows else [], np.int64)
        pt.col_keys = list(range(len(columns)))
        pt.col_names = dict(enumerate(columns))
        return pt

    # -- state ----------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [self.col_names[k] for k in self.col_keys]

    def positioned(self) -> list[tuple[int, int, int]]:
        """Segments as (position, first id, length), neighbours that continue
        one another as one."""
        ids, lengths = self._ids, self._lengths
        if not len(ids):
            return []
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1] + lengths[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(lengths, first)
        starts = np.cumsum(total) - total
        return list(zip(starts.tolist(), ids[first].tolist(), total.tolist()))

    def _split(self, pos: int) -> int:
        """Split so a segment starts at ``pos``; return that segment's index."""
        ends = np.cumsum(self._lengths)
        i = int(np.searchsorted(ends, pos, side="right"))
        if i == len(ends):
            return i
        cut = pos - int(ends[i] - self._lengths[i])
        if cut == 0:
            return i
        self._ids = np.insert(self._ids, i + 1, self._ids[i] + cut)
        self._lengths = np.insert(self._lengths, i + 1, self._lengths[i] - cut)
        self._lengths[i] = cut
        return i + 1

    # -- edits ----------------------------------------------------------
    def insert_rows(self, index, amount=1, seq=0) -> None:
        if index is None or index < 0 or amount is None or amount < 0:
            raise EditError(f"row insert needs index >= 0 and amount >= 0, got {index}, {amount}")
        index = min(index, self.n_rows)
        if amount:
            i = self._split(index)
            self._ids = np.insert(self._ids, i, self.next_id)
            self._lengths = np.insert(self._lengths, i, amount)
            self.row_edits.append((seq, True, index, amount, self.next_id))
        self.next_id += amount
        self.n_rows += amount

    def remove_rows(self, index, amount=1, seq=0) -> None:
        if index is None or index < 0 or amount is None or amount < 0 or index + amount > self.n_rows:
            raise EditError(f"row remove [{index}, {index}+{amount}) outside 0..{self.n_rows}")
        if amount:
            i = self._split(index)
            gone = slice(i, self._split(index + amount))
            self._ids, self._lengths = np.delete(self._ids, gone), np.delete(self._lengths, gone)
            self.row_edits.append((seq, False, index, amount, 0))
        self.n_rows -= amount

    def new_column_name(self) -> str:
        """Smallest i >= 1 with 'New Column i' unused."""
        used = set(self.columns)
        i = 1
        while f"{NEW_COLUMN} {i}" in used:
            i += 1
        return f"{NEW_COLUMN} {i}"

    def insert_cols(self, index, amount=1, seq=0) -> None:
        if index is None or amount is None or amount < 0 or not 0 <= index <= len(self.col_keys):
            raise EditError(f"column insert at {index} outside 0..{len(self.col_keys)}")
        for _ in range(amount):  # each at the same index, so the last one comes first
            key = len(self.col_names)
            self.col_names[key] = self.new_column_name()
            self.col_keys.insert(index, key)
            self.col_edits.append((seq, True, index, 1, key))

    def remove_cols(self, index, amount=1, seq=0) -> None:
        if index is None or index < 0 or amount is None or amount < 0:
            raise EditError(f"column remove needs index >= 0, got {index}")
        gone = len(self.col_keys[index:index + amount])  # clipped, as a slice
        del self.col_keys[index:index + amount]
        if gone:
            self.col_edits.append((seq, False, index, gone, 0))

    def apply(self, edit: dict) -> None:
        kind, action = edit.get("type"), edit.get("action")
        index, amount, seq = edit.get("index"), edit.get("amount", 1), edit.get("seq", 0)
        if kind == "row" and action == "create":
            self.insert_rows(index, amount, seq)
        elif kind == "row" and action == "remove":
            self.remove_rows(index, amount, seq)
        elif kind == "col" and action == "create":
            self.insert_cols(index, amount, seq)
        elif kind == "col" and action == "remove":
            self.remove_cols(index, amount, seq)
        else:
            raise EditError(f"unknown edit {edit!r}")
        self.sizes.append((seq, self.n_rows, len(self.col_keys)))


def compile_edits(n_rows: int, columns: list[str], edits: list[dict]) -> PieceTable:
    """Fold structural edits in order; any invalid edit rejects the batch."""
    pt = PieceTable.start(n_rows, columns)
    for e in edits:
        pt.apply(e)
    return pt


# -- places of cell edits, on executors --------------------------------------
# Undoing one structural edit is a map of positions in a few segments
# ``(first position, shift, found)``: a position of the segment moves by the
# shift, and with ``found`` that is its stable id and no earlier edit counts.
Segments = list[tuple[int, int, bool]]


def _undo_map(edit: tuple[int, bool, int, int, int]) -> Segments:
    _, grown, i, n, first_id = edit
    moved = [(i, first_id - i, True), (i + n, -n, False)] if grown else [(i, n, False)]
    return ([(0, 0, False)] if i else []) + moved


def _then(later: Segments, earlier: Segments) -> Segments:
    """The map that undoes ``later`` and after it ``earlier``."""
    starts = [s for s, _, _ in earlier]
    out: Segments = []

    def add(start: int, shift: int, found: bool) -> None:
        if not out or out[-1][1:] != (shift, found):
            out.append((start, shift, found))

    for k, (start, shift, found) in enumerate(later):
        if found:
            add(start, shift, True)
            continue
        end = later[k + 1][0] + shift if k + 1 < len(later) else math.inf
        j = bisect_right(starts, start + shift) - 1
        at = start + shift
        while True:
            add(at - shift, shift + earlier[j][1], earlier[j][2])
            j += 1
            if j == len(earlier) or earlier[j][0] >= end:
                break
            at = earlier[j][0]
    return out


def undo_tree(edits: list[tuple[int, bool, int, int, int]]) -> list[list[Segments]]:
    """Level k holds the undo maps of the aligned runs of 2^k edits.  Any first
    j edits are one run for each bit of j, so few maps undo them all."""
    levels = [[_undo_map(e) for e in edits]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_then(below[i + 1], below[i]) for i in range(0, len(below) - 1, 2)])
    return levels


def _constant(values: list, kind: str = "bigint") -> Column:
    """A constant array as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _last_not_above(values: Column, lo: Column, hi: Column, x: Column, halvings: Column, finish) -> Column:
    """``finish(i)`` of the last place i in ``[lo, hi]`` whose value is not above
    ``x``; the value at ``lo`` is not.  ``halvings`` halvings reach one place."""
    def halve(r: Column, _: Column) -> Column:
        mid = F.shiftright(r["lo"] + r["hi"] + 1, 1)
        return F.when(F.get(values, mid) <= x, F.struct(mid.alias("lo"), r["hi"].alias("hi"))).otherwise(
            F.struct(r["lo"].alias("lo"), (mid - 1).alias("hi")))

    start = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), halvings), start, halve, lambda r: finish(r["lo"]))


def _edits_before(seq: Column, seqs: list[int]) -> Column:
    """How many of the sorted ``seqs`` are below ``seq``."""
    padded = [-(1 << 63), *seqs]
    return _last_not_above(
        _constant(padded), F.lit(0), F.lit(len(seqs)), seq.cast("bigint") - 1, F.lit(len(padded).bit_length()), lambda i: i)


def stable_place(place: Column, seq: Column, edits: list[tuple[int, bool, int, int, int]]) -> Column:
    """The stable id at ``place`` of the sheet as it was before the edit ``seq``:
    the edits before it are undone, latest first, by one composed map for each
    bit of their number.  A map is searched by halving, so a cell edit takes
    about the square of the logarithm of the edit list."""
    if not edits:
        return place.cast("bigint")
    tree = undo_tree(edits)
    flat = [seg for level in tree for run in level for seg in run]
    first_run = np.cumsum([0] + [len(level) for level in tree]).tolist()
    ends = np.cumsum([0] + [len(run) for level in tree for run in level]).tolist()
    starts, shifts = _constant([s for s, _, _ in flat]), _constant([d for _, d, _ in flat])
    founds, run_at, level_at = _constant([f for _, _, f in flat], "boolean"), _constant(ends, "int"), _constant(first_run, "int")

    def undo(at: Column, level: Column) -> Column:
        # Bit ``level`` of n: the run of 2^level edits that ends where the lower bits begin.
        bits = F.call_function("shiftright", at["n"], level)
        run = F.get(level_at, level) + bits - 1
        moved = _last_not_above(
            starts, F.get(run_at, run), F.get(run_at, run + 1) - 1, at["p"], level + 2,  # 2^level edits: 2^(level + 1) + 1 segments
            lambda i: F.struct(at["n"].alias("n"), (at["p"] + F.get(shifts, i)).alias("p"), F.get(founds, i).alias("done")))
        return F.when(at["done"] | (bits.bitwiseAND(F.lit(1)) == 0), at).otherwise(moved)

    start = F.struct(_edits_before(seq, [e[0] for e in edits]).alias("n"), place.cast("bigint").alias("p"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(tree) - 1)), start, undo, lambda at: at["p"])


def size_before(seq: Column, pt: PieceTable, n_cols: int) -> tuple[Column, Column]:
    """Rows and columns of the sheet before the edit ``seq``."""
    if not pt.sizes:
        return F.lit(pt.n_source_rows).cast("bigint"), F.lit(n_cols).cast("bigint")
    n = _edits_before(seq, [s for s, _, _ in pt.sizes])
    rows = _constant([pt.n_source_rows, *[r for _, r, _ in pt.sizes]])
    cols = _constant([n_cols, *[c for _, _, c in pt.sizes]])
    return F.get(rows, n), F.get(cols, n)


# -- applying segment maps on executors -----------------------------------
_CASE_LIMIT = 64


def map_by_segments(df: DataFrame, key: Column, segments: list[tuple[int, int, int]], out: str) -> DataFrame:
    """Add ``out = to_start + (key - from_start)`` for the segment
    ``(from_start, length, to_start)`` containing ``key``; rows in no segment
    are dropped.

    Few segments: one CASE expression (no join, stays in codegen).  Many:
    segments are cut into buckets of the key space and broadcast-joined on the
    bucket with a range residual; the segment table has a few rows for each
    structural edit, so its size is bounded by the edit list."""
    segments = [s for s in segments if s[1] > 0]
    if len(segments) <= _CASE_LIMIT:
        expr = F.lit(None).cast("bigint")
        for f0, n, t0 in segments:
            expr = F.when((key >= F.lit(f0)) & (key < F.lit(f0 + n)), F.lit(t0) + (key - F.lit(f0))).otherwise(expr)
        return df.withColumn(out, expr).where(F.col(out).isNotNull())
    covered = sum(n for _, n, _ in segments)
    # Bucket rows ~ covered / width + segments: keep them near 5x segments.
    width = max(1, math.ceil(covered / (4 * len(segments))))
    seg_df = df.sparkSession.createDataFrame(segments, "__f0 BIGINT, __n BIGINT, __t0 BIGINT", verifySchema=False)
    first_b = F.floor(F.col("__f0") / F.lit(width)).cast("bigint")
    last_b = F.floor((F.col("__f0") + F.col("__n") - 1) / F.lit(width)).cast("bigint")
    seg_df = seg_df.withColumn("__sb", F.explode(F.sequence(first_b, last_b)))
    keyed = df.withColumn("__key", key).withColumn("__kb", F.floor(F.col("__key") / F.lit(width)).cast("bigint"))
    cond = (keyed["__kb"] == seg_df["__sb"]) & (keyed["__key"] >= seg_df["__f0"]) & (
        keyed["__key"] < seg_df["__f0"] + seg_df["__n"])
    joined = keyed.join(F.broadcast(seg_df), cond)
    return joined.withColumn(out, F.col("__t0") + (F.col("__key") - F.col("__f0"))).drop(
        "__key", "__kb", "__sb", "__f0", "__n", "__t0")

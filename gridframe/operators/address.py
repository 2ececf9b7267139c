"""Positional reads over a sheet (A8 range read, A11 listing, A12 search)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.functions.text import qc

from gridframe.functions.letters import column_letters
from gridframe.functions import selection as sel
from gridframe.plans.ordinals import ROW
from gridframe.session import scratch_path
from gridframe.sheet import Sheet


def letters_to_index(s: str) -> int:
    if not re.fullmatch(r"[A-Za-z]+", s or ""):
        return -1
    v = 0
    for ch in s.upper():
        v = v * 26 + ord(ch) - 64
    return v - 1


def index_to_letters(i: int) -> str:
    out = ""
    i += 1
    while i > 0:
        i, d = divmod(i - 1, 26)
        out = chr(65 + d) + out
    return out


def parse_selection_text(spark: SparkSession, text: str) -> list[Row]:
    """A literal selection as rectangles (r1, c1, r2, c2; null ends are open):
    ``parse_selection`` evaluated on one row, because a positional read decides
    its columns from it."""
    rects = spark.range(1).select(sel.parse_selection(F.lit(text)).alias("r")).first()["r"]
    if not rects:
        raise ValueError(f"invalid selection: {text!r}")
    return rects


def read_range(sheet: Sheet, selection: str) -> DataFrame:
    """Rows in any rectangle, columns in any rectangle (sheet order);
    with several rectangles, cells outside all of them are nulled.  A selection
    that leaves the sheet raises (A6).

    Row bounds become a ``_row`` range filter, which reaches the scan when the
    sheet is stored sorted by ``_row``; columns are a positional projection."""
    rects = parse_selection_text(sheet.df.sparkSession, selection)
    cols = sheet.columns
    last_col = len(cols) - 1
    spans = [(r.r1, r.r2, r.c1, last_col if r.c2 is None else r.c2) for r in rects]
    last_row = max([r1 if r2 is None else r2 for r1, r2, _, _ in spans if (r1, r2) != (0, None)], default=-1)
    if max(max(c1, c2) for _, _, c1, c2 in spans) > last_col or (last_row >= 0 and last_row >= sheet.n_rows):
        raise ValueError(f"selection {selection!r} leaves the sheet")
    wanted = sorted({c for _, _, c1, c2 in spans for c in range(c1, c2 + 1)})

    def in_rows(r1, r2):
        cond = F.col(ROW) >= r1
        return cond if r2 is None else cond & (F.col(ROW) <= r2)

    row_filter = None
    for r1, r2, _, _ in spans:
        cond = in_rows(r1, r2)
        row_filter = cond if row_filter is None else row_filter | cond
    out = sheet.df.where(row_filter)
    if len(spans) == 1:
        return out.select(ROW, *[qc(cols[c]) for c in wanted])
    projected = []
    for c in wanted:
        cond = None
        for r1, r2, c1, c2 in spans:
            if c1 <= c <= c2:
                k = in_rows(r1, r2)
                cond = k if cond is None else cond | k
        projected.append(F.when(cond, qc(cols[c])).alias(cols[c]))
    return out.select(ROW, *projected)


#: Sheet rows that one bucket of the join of rectangles holds.
RECT_ROWS = 256


def parsed_selections(sheet: Sheet, selections: DataFrame) -> DataFrame:
    """``selections`` (id, selection) with ``rects``, open ends filled, and
    ``error``: null, or why the selection can't be read (A5, A6)."""
    size = F.lit(sheet.n_rows).cast("bigint"), F.lit(sheet.n_cols).cast("bigint")
    parsed = selections.select("id", "selection", sel.parse_selection("selection").alias("__r"))
    error = F.when(F.col("__r").isNull(), "invalid").when(~sel.selection_in_bounds(F.col("__r"), *size), "leaves the sheet")
    return parsed.select("id", "selection", sel.resolve_rects(F.col("__r"), *size).alias("rects"), error.alias("error"))


def read_ranges(sheet: Sheet, selections: DataFrame) -> DataFrame:
    """A8 for a table of selections (id, selection): (id, part, _row, col, cells),
    for each rectangle (``part``, from 0) one row for each sheet row in it, its
    cells as texts from column ``col`` on.  Selections that ``parsed_selections``
    marks with an error give none.

    Rectangles and sheet rows meet in buckets of ``RECT_ROWS`` rows, so a row is
    compared with the rectangles of its bucket only and the plan has the same
    size for any number of selections."""
    types = dict(sheet.df.dtypes)
    texts = [F.date_format(qc(c), "yyyy-MM-dd HH:mm:ss") if types[c].startswith("timestamp") else qc(c).cast("string")
             for c in sheet.columns]
    rects = parsed_selections(sheet, selections).where("error is null").select("id", F.posexplode("rects").alias("part", "r"))
    bucket = lambda c: F.floor(c / RECT_ROWS).cast("bigint")
    spread = rects.select("id", "part", "r.*", F.explode(F.sequence(bucket(F.col("r.r1")), bucket(F.col("r.r2")))).alias("__b"))
    rows = sheet.df.select(ROW, F.array(*texts).alias("__cells"), bucket(F.col(ROW)).alias("__b"))
    met = rows.join(spread, "__b").where((F.col(ROW) >= F.col("r1")) & (F.col(ROW) <= F.col("r2")))
    return met.select("id", F.col("part").cast("int").alias("part"), ROW, F.col("c1").alias("col"),
                      F.slice("__cells", (F.col("c1") + 1).cast("int"), (F.col("c2") - F.col("c1") + 1).cast("int")).alias("cells"))


def grid_page(sheet: Sheet, start: int, stop: int) -> DataFrame:
    """One page of the grid view (rows ``start`` .. ``stop``-1), datetimes
    as 'yyyy-MM-dd HH:mm:ss' ('' when missing); never collects the sheet."""
    types = dict(sheet.df.dtypes)
    out = []
    for c in sheet.columns:
        if types[c].startswith("timestamp") or types[c] == "date":
            out.append(F.coalesce(F.date_format(qc(c), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c))
        else:
            out.append(qc(c))
    return sheet.df.where((F.col(ROW) >= start) & (F.col(ROW) < stop)).select(ROW, *out)


def _preview(v, dtype: str):
    """Preview of a cell: first 15 chars + '...' when longer; '' when falsy
    (missing, empty text, zero, NaN or false)."""
    s = v.cast("string")
    falsy = v.isNull() | (s == "")
    if dtype == "boolean":
        falsy = falsy | ~v
    elif dtype in ("double", "float"):
        falsy = falsy | F.isnan(v) | (v == 0)
    elif dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal"):
        falsy = falsy | (v == 0)
    return F.when(falsy, F.lit("")).otherwise(
        F.concat(F.substring(s, 1, 15), F.when(F.length(s) > 15, F.lit("...")).otherwise(F.lit(""))))


def cell_listing(sheet: Sheet, columns: list[str] | None = None) -> DataFrame:
    """One suggestion per column, row and cell: kind (0 column, 1 row,
    2 cell), col, row, text, description; ``columns`` keeps the suggestions of
    these columns only.  Cells come from one ``stack``
    (each row of the sheet fans out to its cells inside the scan's task)."""
    spark = sheet.df.sparkSession
    names = columns or sheet.columns
    pos = {c: i for i, c in enumerate(sheet.columns)}
    col_rows = [(0, pos[c], -1, index_to_letters(pos[c]), f"Column {index_to_letters(pos[c])}")
                for c in names]
    col_df = spark.createDataFrame(col_rows, "kind int, col bigint, row bigint, text string, description string")
    row_df = sheet.df.select(
        F.lit(1).alias("kind"), F.lit(-1).cast("bigint").alias("col"), F.col(ROW).alias("row"),
        (F.col(ROW) + 1).cast("string").alias("text"),
        F.concat(F.lit("Row "), (F.col(ROW) + 1).cast("string")).alias("description"),
    )
    types = dict(sheet.df.dtypes)
    pairs = [x for c in names for x in (F.lit(pos[c]).cast("bigint"), _preview(qc(c), types[c]))]
    cells = sheet.df.select(ROW, F.stack(F.lit(len(names)), *pairs).alias("col", "preview")) if names else (
        sheet.df.select(ROW, F.lit(0).cast("bigint").alias("col"), F.lit("").alias("preview")).limit(0))
    text = F.concat(column_letters("col"), (F.col(ROW) + 1).cast("string"))
    prev = F.col("preview")
    cell_df = cells.select(
        F.lit(2).alias("kind"), F.col("col"), F.col(ROW).alias("row"), text.alias("text"),
        F.when(prev == "", F.concat(F.lit("Cell "), text))
        .otherwise(F.concat(F.lit("Cell "), text, F.lit(": "), prev)).alias("description"),
    )
    return col_df.unionByName(row_df).unionByName(cell_df)


def cell_search(sheet: Sheet, term: str, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive contains on text or description; first ``k`` in
    listing order (columns, rows, cells column-major).  The limit is the
    feature; it plans a TakeOrderedAndProject (top-k per task, then merge)."""
    t = term.lower()
    lst = cell_listing(sheet, columns)
    hit = F.lower("text").contains(t) | F.lower("description").contains(t)
    return lst.where(hit).orderBy("kind", "col", "row").limit(k)


#: Longest grams of the search index; a shorter term is looked up as it is.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


#: Sheet rows whose entries, of one column, make a block of the search index.
BLOCK_ROWS = 4096
#: Entries whose grams one task counts.
ENTRIES_PER_PART = 50_000


class SearchIndex:
    """A12 for many terms: the listing of a sheet and, for each gram of its
    texts and each block of the listing, the number of entries that hold it,
    both stored.  Blocks are in listing order; one has the entries of a kind, a
    column and ``BLOCK_ROWS`` sheet rows.

    A term of at most ``GRAM`` characters is a gram itself, so counts tell which
    blocks its first entries are in.  A longer one is looked up by the rarest of
    its grams.  The entries of the blocks found are verified, so a term of either
    kind brings blocks and not entries, and a task counts a bounded part."""

    def __init__(self, sheet: Sheet, columns: list[str] | None = None, path: str | None = None) -> None:
        self.spark = sheet.df.sparkSession
        self.path = path or scratch_path(self.spark, "search")
        block = F.floor(F.col("row") / BLOCK_ROWS).cast("bigint").alias("block")
        lowered = [F.lower("text").alias("lt"), F.lower("description").alias("ld")]
        cell_listing(sheet, columns).select("*", block, *lowered).write.parquet(f"{self.path}/listing")
        both = [_grams(F.col(c), n) for c in ("lt", "ld") for n in range(1, GRAM + 1)]
        names = sheet.columns if columns is None else columns
        parts = 1 + sheet.n_rows * (len(names) + 1) // ENTRIES_PER_PART
        # Blocks lie whole in a part, so their counts need no other shuffle.
        entries = self.listing().select("kind", "col", "block", "lt", "ld").repartition(parts, "kind", "col", "block")
        posts = entries.select("kind", "col", "block", F.explode(F.array_distinct(F.concat(*both))).alias("gram"))
        counts = posts.groupBy("gram", "kind", "col", "block").agg(F.count(F.lit(1)).alias("held"))
        counts.write.parquet(f"{self.path}/postings")
        self.postings().groupBy("gram").agg(F.sum("held").alias("n")).write.parquet(f"{self.path}/grams")

    def listing(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/listing")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def search(self, terms: DataFrame, k: int = 10) -> DataFrame:
        """(term, rank, kind, col, row, text, description): for each distinct term
        its first ``k`` suggestions in listing order, as ``cell_search`` gives
        them.  The limit is the feature."""
        wanted = terms.select("term", F.lower("term").alias("lower")).where("term <> ''").distinct()
        size = F.least(F.length("lower"), F.lit(GRAM))
        places = F.sequence(F.lit(1), F.length("lower") - size + 1)
        grams = wanted.select("term", "lower", F.explode(F.array_distinct(
            F.transform(places, lambda i: F.substring(F.col("lower"), i, size)))).alias("gram"))
        # A gram that no entry holds rules its term out.
        counted = grams.join(self.spark.read.parquet(f"{self.path}/grams"), "gram", "left")
        rarest = counted.groupBy("term", "lower").agg(
            F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
        found = self.postings().join(rarest.where("n > 0").select("term", "lower", "gram"), "gram")
        # Every block found holds an entry of a short term, so its first k entries are in its first k blocks.
        order = Window.partitionBy("term").orderBy("kind", "col", "block")
        exact = F.length("lower") <= GRAM
        first = found.where(exact).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
        before = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = first.withColumn("before", before).where(F.col("before") < k)
        blocks = first.select("term", "lower", "kind", "col", "block").unionByName(
            found.where(~exact).select("term", "lower", "kind", "col", "block"))
        hits = self.listing().join(blocks, ["kind", "col", "block"]).where(F.contains("lt", "lower") | F.contains("ld", "lower"))
        listed = Window.partitionBy("term").orderBy("kind", "col", "row")
        ranked = hits.withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= k)
        return ranked.select("term", "rank", "kind", "col", "row", "text", "description")

"""CSV sheets (S1 source, S4 sink) with spreadsheet-style header and null rules.

Spark's own CSV header handling differs (``a0,a1`` for duplicates, ``_c2``
for blanks, one null token, dates inferred), so files are read as text
fields and three small passes follow: header, null tokens, types (one
aggregate of ``try_cast`` successes per column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions.text import INTEGER, number_cast, qc
from gridframe.plans.ordinals import ROW, numbered
from gridframe.plans.running import carry_last, running_sum
from gridframe.session import cut_lineage
from gridframe.sheet import Sheet

# Cell texts read as missing (the spreadsheet library's defaults).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


ROWS_PER_PART = 1 << 18


def header_names(cells: list[str | None]) -> list[str]:
    """Blank header -> 'Unnamed: <pos>'; duplicates -> 'a', 'a.1', 'a.2'."""
    names = [c if c not in (None, "") else f"Unnamed: {i}" for i, c in enumerate(cells)]
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k + 1}"
            while cand in seen:
                k += 1
                cand = f"{n}.{k + 1}"
            seen[n] = k + 1
            seen[cand] = 0
            out.append(cand)
        else:
            seen[n] = 0
            out.append(n)
    return out


class RaggedRows(ValueError):
    """A line has more cells than the header."""


#: Quotes are doubled inside quoted cells; a backslash is a plain character.
QUOTING = {"quote": '"', "escape": '"'}

# Where a place in a line is: at a cell's first character, later in a plain
# cell, inside quotes, or behind a quote that closes them or is half of two.
_FRESH, _PLAIN, _QUOTED, _MAYBE_CLOSED = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(__f, __b, __m, value) of all lines; their order is (__f, __b, __m)."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"), "value")


def _ends_quoted(value: Column, start: int) -> Column:
    """Whether a line that starts in state ``start`` ends inside quotes.  Its
    parts between quote characters are folded; quotes inside a plain cell are text."""
    def text(state: Column, part: Column) -> Column:
        outside = F.when(F.endswith(part, F.lit(",")), _FRESH).otherwise(_PLAIN)
        return F.when((part == "") | (state == _QUOTED), state).otherwise(outside)

    def quote(state: Column) -> Column:
        return (F.when(state == _FRESH, _QUOTED).when(state == _QUOTED, _MAYBE_CLOSED)
                .when(state == _MAYBE_CLOSED, _QUOTED).otherwise(state))

    parts = F.split(value, '"', -1)
    rest = F.slice(parts, 2, F.size(parts))
    return F.aggregate(rest, text(F.lit(start), F.get(parts, F.lit(0))), lambda s, part: text(quote(s), part)) == _QUOTED


def files_with_open_quotes(spark: SparkSession, path: str) -> list[str]:
    """Files with a line that ends inside quotes, so that a cell holds a line break."""
    lines = _lines(spark, path).where(F.contains("value", F.lit('"')) & _ends_quoted(F.col("value"), _FRESH))
    return [r["__f"] for r in lines.select("__f").distinct().collect()]


class OpenQuotes(ValueError):
    """A file ends inside quotes."""


def joined_lines(lines: DataFrame) -> DataFrame:
    """(__f, __b, __m, value): the lines of each record as one text.

    A line changes the quote state from both possible starts.  Where the two
    agree it fixes the state, otherwise it keeps or flips it; the last line that
    fixed it and the number of flips since give every line's start.  Both come
    from bucketed scans, so a file's lines stay spread over tasks.  Only lines
    of records with line breaks are grouped."""
    quoted = F.contains("value", F.lit('"'))
    rows, n = numbered(lines, [F.col("__f"), F.col("__b"), F.col("__m")])
    first = rows.groupBy("__f").agg(F.min(ROW).alias("__first"))
    rows = rows.join(F.broadcast(first), "__f")  # a row a file
    opens = F.when(quoted, _ends_quoted(F.col("value"), _FRESH)).otherwise(False)
    stays = F.when(F.col(ROW) == F.col("__first"), opens).when(quoted, _ends_quoted(F.col("value"), _QUOTED)).otherwise(True)
    rows = cut_lineage(rows.select(ROW, "__f", "value", "__first", opens.alias("__opens"), stays.alias("__stays")))
    fixes = F.col("__opens") == F.col("__stays")
    rows = running_sum(rows, ROW, (F.col("__opens") & ~F.col("__stays")).cast("int"), "__flips", n, inclusive=False)
    rows = carry_last(rows, [], ROW, F.struct(F.col("__opens").alias("open"), F.col("__flips").alias("flips")), fixes, "__fix")
    flipped = (F.col("__flips") - F.col("__fix.v.flips")) % 2 == 1
    inside = F.when(F.col(ROW) == F.col("__first"), False).otherwise(F.col("__fix.v.open") != flipped)
    rows = rows.withColumn("__inside", inside).withColumn("__after", F.when(F.col("__inside"), F.col("__stays")).otherwise(F.col("__opens")))
    rows = cut_lineage(running_sum(rows.drop("__flips", "__fix"), ROW, (~F.col("__inside")).cast("int"), "__record", n))
    ends = rows.groupBy("__f").agg(F.max_by("__after", ROW).alias("open")).where("open").select("__f").take(1)
    if ends:
        raise OpenQuotes(f"{ends[0]['__f']} ends inside quotes")
    whole = rows.where(~F.col("__inside") & ~F.col("__after")).select("__f", F.col(ROW).alias("__m"), "value")
    pieces = rows.where(F.col("__inside") | F.col("__after")).groupBy("__f", "__record").agg(
        F.min(ROW).alias("__m"), F.array_sort(F.collect_list(F.struct(ROW, "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    both = whole.unionByName(pieces.select("__f", "__m", text.alias("value")))
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return both.select("__f", F.lit(0).cast("bigint").alias("__b"), "__m", value.alias("value")).where(F.trim("value") != "")


def read_csv_sheet(spark: SparkSession, path: str, multiline: bool | None = None) -> Sheet:
    """One CSV file (or a directory written by ``write_csv_sheet``) as a
    sheet.  Line order is (file path, block start, position in block), so large
    files are split over tasks and keep their order.  Files with line breaks
    inside quotes, which a pass over the lines finds, are read as lines that are
    put together again (``joined_lines``), also split over tasks; ``multiline``
    says without that pass that all files hold some, or none.

    Quotes are doubled in quoted cells and backslashes are plain.  A line with
    fewer cells than the header is filled with missing cells; one with more
    raises ``RaggedRows``: no cell is ever dropped.  A file that ends inside
    quotes raises ``OpenQuotes``."""
    whole = files_with_open_quotes(spark, path) if multiline is None else []
    options = {"header": False, "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line", **QUOTING}
    joined = cut_lineage(joined_lines(_lines(spark, path).where(F.lit(bool(multiline)) | F.col("__f").isin(whole)))) \
        if multiline or whole else None
    first = spark.read.options(**options).option("multiLine", bool(multiline or whole))
    fields = first.option("inferSchema", False).csv(path).columns
    # One field more than the first line has, and the text of lines of another width.
    schema = ", ".join(f"{c} string" for c in [*fields, "__more", "__line"])
    bare = F.regexp_replace("__line", r'"(?:[^"]++|"")*+"', "")
    wide = F.col("__more").isNotNull() | (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(fields))
    flag = F.coalesce(wide, F.lit(False)).alias("__wide")
    file = F.col("_metadata.file_path")
    split = spark.read.options(**options).schema(schema).csv(path).where(~F.lit(bool(multiline)) & ~file.isin(whole))
    cells = split.select(*fields, flag, file.alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
                         F.monotonically_increasing_id().alias("__m"))
    if joined is not None:
        made = joined.select("__f", "__b", "__m", F.from_csv(
            "value", schema, {**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}, "multiLine": "true"}).alias("r"))
        cells = cells.unionByName(made.select("__f", "__b", "__m", "r.*").select(*fields, flag, "__f", "__b", "__m"))
    rows, n = numbered(cells, [F.col("__f"), F.col("__b"), F.col("__m")])
    bad = rows.agg(F.count_if("__wide").alias("n"), F.min(F.when(F.col("__wide"), F.col(ROW))).alias("first")).first()
    if bad["n"]:
        raise RaggedRows(f"{bad['n']} lines have more than {len(fields)} cells, the first is line {bad['first'] + 1}")
    head = rows.where(F.col(ROW) == 0).first()
    names = header_names([head[c] if head is not None else None for c in fields])
    body = rows.where(F.col(ROW) > 0).select(
        (F.col(ROW) - 1).alias(ROW),
        *[F.when(~qc(c).isin(NULL_TOKENS), qc(c)).alias(n) for c, n in zip(fields, names)])
    return infer_types(Sheet(body, max(n - 1, 0)))


def infer_types(sheet: Sheet) -> Sheet:
    """Type pass: integer if every value is an integer (beyond 64 bits a
    decimal, beyond 38 digits text), else float if every value is a number,
    else boolean if every value is a truth token, else text.  Dates stay text.
    One aggregate decides all columns."""
    aggs = []
    for i, c in enumerate(sheet.columns):
        x = qc(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count(number_cast(x, "bigint")).alias(f"i{i}"),
                 F.count_if(x.rlike(INTEGER)).alias(f"w{i}"),
                 F.count(F.when(x.rlike(INTEGER), number_cast(x, "decimal(38,0)"))).alias(f"e{i}"),
                 F.count(number_cast(x, "double")).alias(f"d{i}"),
                 F.count(F.when(x.isin(TRUE_TOKENS + FALSE_TOKENS), 1)).alias(f"b{i}")]
    if not aggs:
        return sheet
    r = sheet.df.agg(*aggs).first()
    out = []
    for i, c in enumerate(sheet.columns):
        n = r[f"n{i}"]
        if n and r[f"i{i}"] == n:
            out.append(number_cast(qc(c), "bigint").alias(c))
        elif n and r[f"w{i}"] == n:  # integers only, some too large for 64 bits
            out.append(number_cast(qc(c), "decimal(38,0)").alias(c) if r[f"e{i}"] == n else qc(c))
        elif n and r[f"d{i}"] == n:
            out.append(number_cast(qc(c), "double").alias(c))
        elif n and r[f"b{i}"] == n:
            out.append(qc(c).isin(TRUE_TOKENS).alias(c))
        else:
            out.append(qc(c))
    return Sheet(sheet.df.select(ROW, *out), sheet._n_rows)


def write_csv_sheet(sheet: Sheet, path: str, partitions: int | None = None) -> str:
    """Header + rows in order, no index.  The header travels as row -1,
    rows are range-partitioned by ``_row`` and sorted within partitions, so
    part files concatenated in name order are the sheet; the header is in
    the first part only."""
    spark = sheet.df.sparkSession
    t = dict(sheet.df.dtypes)
    cols = [F.date_format(qc(c), "yyyy-MM-dd HH:mm:ss").alias(c) if t[c].startswith("timestamp") else
            qc(c).cast("string").alias(c) for c in sheet.columns]
    body = sheet.df.select(ROW, *cols)
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias(ROW), *[F.lit(c).alias(c) for c in sheet.columns])
    both = head.unionByName(body)
    # One part for each ROWS_PER_PART rows, whatever the session's settings.
    n = partitions or 1 + sheet.n_rows // ROWS_PER_PART
    (both.repartitionByRange(n, ROW).sortWithinPartitions(ROW).drop(ROW)
     .write.mode("overwrite").options(**QUOTING).option("header", False).option("emptyValue", "")
     # Line breaks and spaces at the edges of a cell belong to it.
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path

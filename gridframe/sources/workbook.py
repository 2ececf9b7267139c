"""Workbook folder source (S2): thousands of ``.xlsx`` files as one job.

Files are read through Spark's ``binaryFile`` source, so any shared storage
will do, and parsed in tasks with the standard library (``zipfile``, ``expat``
and ``xml.etree``): the rows of all sheets stream out of the compressed parts, so
a task holds one compressed file, its shared texts and a batch of rows."""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions.text import number_cast
from gridframe.plans.ordinals import ROW
from gridframe.sources.csv import header_names

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in number formats that denote dates (ids 14-22, 45-47).
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
_EPOCH = _dt.datetime(1899, 12, 30)
_M = f"{{{_NS['m']}}}"


@lru_cache(1 << 16)
def _col_index(letters: str) -> int:
    v = 0
    for ch in letters:
        v = v * 26 + ord(ch) - 64
    return v - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    st = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in st.findall("m:numFmts/m:numFmt", _NS)}
    out = set()
    xfs = st.find("m:cellXfs", _NS)
    for i, xf in enumerate(xfs.findall("m:xf", _NS) if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        code = re.sub(r'"[^"]*"|\[[^]]*\]', "", custom.get(fid, "")).lower()
        if fid in _DATE_FORMAT_IDS or (fid in custom and re.search(r"[dy]|m{1,2}[^a-z]*[ds]", code)):
            out.add(i)
    return out


def _elements(z: zipfile.ZipFile, path: str, tag: str) -> Iterator[ET.Element]:
    """The elements ``tag`` of a part as they are read; each is dropped after use."""
    with z.open(path) as part:
        parents: list[ET.Element] = []
        for event, e in ET.iterparse(part, events=("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == tag:
                yield e
                if parents:
                    parents[-1].remove(e)


def _sheets(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], _dt.datetime]:
    """(name, part) of all sheets in order, and the day that serial dates count from."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target", "").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in book.findall("m:sheets/m:sheet", _NS):
        target = rels[sheet.get(f"{{{_NS['r']}}}id")]
        out.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    props = book.find("m:workbookPr", _NS)
    late = props is not None and props.get("date1904") in ("1", "true")
    return out, _dt.datetime(1904, 1, 1) if late else _EPOCH


@lru_cache(1 << 14)
def _date_text(serial: str, epoch: _dt.datetime) -> str:
    at = epoch + _dt.timedelta(milliseconds=round(float(serial) * 86_400_000))
    return at.strftime("%Y-%m-%d %H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "")


_LETTERS = re.compile(r"[A-Z]+")
_ROW_TAG, _C, _V, _T = (f"{_NS['m']}}}{tag}" for tag in ("row", "c", "v", "t"))
#: Bytes of a sheet that are parsed at once.
_CHUNK = 1 << 16


def _sheet_rows(z: zipfile.ZipFile, path: str, shared: list[str], dates: set[int],
                epoch: _dt.datetime) -> Iterator[tuple[int | None, list, list]]:
    """(row, cells, kinds) of each row of a sheet as it is read; ``row`` is null
    where the file does not number it.  A cell's kind is s for text, n number,
    b boolean, d date, e error; an empty cell has none."""
    done: list[tuple[int | None, list, list]] = []
    cells: list = []
    kinds: list = []
    depth = row_depth = 0  # of the element that is open, and of the row it is in
    row: int | None = None
    cell: dict | None = None
    value: str | None = None
    texts: list[str] = []
    heard: list[str] | None = None  # what the open v or t has said so far

    def start(tag: str, attributes: dict) -> None:
        nonlocal depth, row_depth, row, cells, kinds, cell, value, texts, heard
        depth += 1
        heard = None
        if tag == _C:
            if row_depth and depth == row_depth + 1:
                cell, value, texts = attributes, None, []
        elif cell is not None:
            if tag == _T or tag == _V and value is None and depth == row_depth + 2:
                heard = []
        elif tag == _ROW_TAG and not row_depth:
            row_depth, cells, kinds = depth, [], []
            row = int(attributes["r"]) - 1 if "r" in attributes else None

    def end(tag: str) -> None:
        nonlocal depth, row_depth, cell, value, heard
        if cell is not None:
            if depth == row_depth + 1:
                ended()
                cell = None
            elif heard is not None:
                if tag == _T:
                    texts.append("".join(heard))
                else:
                    value = "".join(heard)
                heard = None
        elif depth == row_depth:
            done.append((row, cells, kinds))
            row_depth = 0
        depth -= 1

    def said(text: str) -> None:
        if heard is not None:
            heard.append(text)

    def ended() -> None:
        ref, t = cell.get("r"), cell.get("t", "n")
        if t == "inlineStr":
            kind, text = "s", "".join(texts)
        elif not value:
            kind = text = None
        elif t == "s":
            kind, text = "s", shared[int(value)]
        elif t == "b":
            kind, text = "b", "TRUE" if value == "1" else "FALSE"
        elif t == "n" and int(cell.get("s", "0")) in dates:
            kind, text = "d", _date_text(value, epoch)
        else:
            kind, text = {"str": "s", "e": "e", "d": "d"}.get(t, "n"), value
        if ref and (gap := _col_index(_LETTERS.match(ref).group(0)) - len(cells)) > 0:
            cells.extend([None] * gap)
            kinds.extend([None] * gap)
        cells.append(text)
        kinds.append(kind)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    with z.open(path) as part:
        more = True
        while more:
            more = part.read(_CHUNK)
            try:
                parser.Parse(more, not more)
            except expat.ExpatError as e:
                yield from done
                raise ET.ParseError(str(e)) from None
            except Exception:
                yield from done
                raise
            yield from done
            done.clear()


def workbook_rows(file) -> Iterator[tuple[int, str, int, list, list]]:
    """(sheet number, sheet name, row, cells, kinds) of all sheets of a path or
    file object, as they are read.  Rows count from 0; those missing in the file
    are empty lists.  Only the shared texts are held."""
    with zipfile.ZipFile(file) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in _elements(z, "xl/sharedStrings.xml", f"{_M}si")]
        dates = _date_styles(z)
        sheets, epoch = _sheets(z)
        for number, (name, part) in enumerate(sheets):
            at = 0
            for own, cells, kinds in _sheet_rows(z, part, shared, dates, epoch):
                own = at if own is None else own
                for gap in range(at, own):
                    yield number, name, gap, [], []
                yield number, name, own, cells, kinds
                at = own + 1


def read_first_sheet(path) -> list[tuple[int, list[str | None]]]:
    """(row, cells) of the first sheet of a path or file object."""
    return [(row, cells) for number, _, row, cells, _ in workbook_rows(path) if number == 0]


SCHEMA = ("path string, sheet_no int, sheet string, _row bigint, cells array<string>, kinds array<string>, "
          "head array<string>, error string")
_TEXTS = pa.list_(pa.string())
_TYPES = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("_row", pa.int64()),
                    ("cells", _TEXTS), ("kinds", _TEXTS), ("head", _TEXTS), ("error", pa.string())])
#: Sheet rows that a task returns at once.
_BATCH = 2000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            path = path.as_py()
            try:
                rows, head, of = workbook_rows(io.BytesIO(content.as_py())), None, None
                while part := list(islice(rows, _BATCH)):
                    out = []
                    for number, name, row, cells, kinds in part:
                        if number != of:
                            of, head = number, cells
                        out.append((path, number, name, row, cells, kinds, head, None))
                    yield batch_of(out)
            except Exception as e:  # one bad file is a marked row, not the end of the job
                yield batch_of([(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")])


def parse_workbooks(files: DataFrame) -> DataFrame:
    """S2 over workbooks in a table (path, content): one row for each row of
    each sheet, blank rows kept, with its cells as texts, their kinds and the
    cells of the sheet's first row (``head``).  A file that cannot be parsed gives
    one row with ``error`` after the rows before it."""
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """``parse_workbooks`` of every workbook below ``path`` (a folder, file or
    glob of any file system Spark reads)."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def workbook_table(rows: DataFrame, sheet: str | int = 0) -> DataFrame:
    """The sheets named ``sheet`` (or of that number) of all workbooks as one
    typed table: (path, _row, columns).  Row 0 of a sheet is its header, named by
    the CSV rules; columns are matched by name, a workbook without one has it
    empty, and blank rows go.  A column whose cells are all whole numbers is
    bigint, all numbers double, all booleans boolean, all dates timestamp, else
    text; error cells are missing."""
    own = rows.where("error is null").where(F.col("sheet" if isinstance(sheet, str) else "sheet_no") == sheet)
    heads = own.where(f"{ROW} = 0").select("head").distinct()
    named = {tuple(h): header_names(list(h)) for h in (r["head"] for r in heads.collect())}
    columns = list(dict.fromkeys(n for names in named.values() for n in names))
    if not columns:
        return own.select("path", ROW).limit(0)
    names = rows.sparkSession.createDataFrame([(list(h), n) for h, n in named.items()], "head array<string>, names array<string>")
    # Each row has its sheet's head, so that rows need not travel to meet it.
    body = own.where(f"{ROW} > 0").where(F.exists("cells", lambda c: c.isNotNull())).join(F.broadcast(names), "head")

    def cell(name: str, field: str) -> Column:
        return F.get(field, F.array_position("names", name).cast("int") - 1)

    cells = body.select("path", (F.col(ROW) - 1).alias(ROW), *[
        F.struct(cell(n, "kinds").alias("k"), F.when(cell(n, "kinds") != "e", cell(n, "cells")).alias("v")).alias(f"c{i}")
        for i, n in enumerate(columns)])
    tests = {"n": lambda c: c["k"] == "n", "w": lambda c: (c["k"] == "n") & number_cast(c["v"], "bigint").isNotNull(),
             "b": lambda c: c["k"] == "b", "d": lambda c: c["k"] == "d"}
    counts = cells.agg(*[F.count(f"c{i}.v").alias(f"all{i}") for i in range(len(columns))],
                       *[F.count_if((F.col(f"c{i}.v").isNotNull()) & t(F.col(f"c{i}"))).alias(f"{k}{i}")
                         for k, t in tests.items() for i in range(len(columns))]).first()
    kinds = {"w": "bigint", "n": "double", "b": "boolean", "d": "timestamp_ntz"}
    out = []
    for i, n in enumerate(columns):
        kind = next((t for k, t in kinds.items() if counts[f"all{i}"] and counts[f"{k}{i}"] == counts[f"all{i}"]), "string")
        v = F.col(f"c{i}.v")
        out.append((number_cast(v, kind) if kind in ("bigint", "double") else v.cast(kind)).alias(n))
    return cells.select("path", ROW, *out)

import json
import os
import tempfile
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from gridframe.sources import csv as csvsrc
from gridframe.sources import records
from gridframe.sources.workbook import read_first_sheet, read_workbooks, workbook_table


def _tmp():
    return tempfile.mkdtemp(prefix="gridframe-test-", dir="/tmp")


def test_csv_header_and_null_rules(spark):
    d = _tmp()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("a,a,,when\n1,x,NA,2023-01-01\n\n,,,\n2,\"q,r\",None,2023-01-02\n3,\"multi\nline\",null,\n")
    s = csvsrc.read_csv_sheet(spark, p, multiline=True)
    assert s.columns == ["a", "a.1", "Unnamed: 2", "when"]
    rows = [tuple(r) for r in s.df.orderBy("_row").collect()]
    assert rows == [(0, 1, "x", None, "2023-01-01"), (1, None, None, None, None),
                    (2, 2, "q,r", None, "2023-01-02"), (3, 3, "multi\nline", None, None)]
    assert dict(s.df.dtypes)["a"] == "bigint" and dict(s.df.dtypes)["when"] == "string"


def test_csv_roundtrip(spark, sheet_of):
    s = sheet_of([(1, "x", 2.5), (2, None, 3.0), (3, "z", None)], "k long, s string, d double")
    path = csvsrc.write_csv_sheet(s, os.path.join(_tmp(), "out"), partitions=3)
    back = csvsrc.read_csv_sheet(spark, path)
    assert back.columns == ["k", "s", "d"]
    assert [tuple(r) for r in back.df.orderBy("_row").collect()] == [(0, 1, "x", 2.5), (1, 2, None, 3.0), (2, 3, "z", None)]


def test_json_records(spark):
    recs = [json.dumps({"a": 1, "b": "x", "extra": 5}), json.dumps({"b": "y"}), json.dumps({})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(recs)], "_row long, record string")
    s = records.from_records(df, ["b", "a"])
    assert s.columns == ["b", "a"]
    assert [tuple(r) for r in s.df.orderBy("_row").collect()] == [(0, "x", "1"), (1, "y", None), (2, None, None)]
    empty = records.from_records(spark.createDataFrame([], "_row long, record string"), ["h1", "h2"])
    assert empty.columns == ["h1", "h2"] and empty.df.count() == 0


def test_records_sink_datetimes(spark, sheet_of):
    s = sheet_of([("2024-01-02 03:04:05", 1.0), (None, float("nan"))], "t string, d double")
    s2 = type(s)(s.df.withColumn("t", F.col("t").cast("timestamp_ntz")))
    out = [json.loads(r.record) for r in records.to_records(s2).orderBy("_row").collect()]
    assert out == [{"t": "2024-01-02 03:04:05", "d": 1.0}, {"t": "", "d": None}]


def test_records_view_carries_headers_and_metadata(spark, sheet_of, tmp_path):
    s = sheet_of([("a\n\"b\"\r", 1, 2.5, None), (None, 2**40, float("nan"), None), ("\u2028c\\", None, 1.0, None)],
                 "z string, a long, `d.x` double, gone string")
    path = records.write_view(s, str(tmp_path / "v"), "f1", 'my "file".xlsx')
    got, head = records.read_view(spark, path)
    names = ["z", "a", "d.x", "gone"]
    assert head == {"file_id": "f1", "original_filename": 'my "file".xlsx', "headers": names,
                    "metadata": {"filename": 'my "file".xlsx', "columns": names, "rows": 3}}
    assert got.columns == names and dict(got.df.dtypes)["a"] == "bigint" and dict(got.df.dtypes)["d.x"] == "double"
    assert [tuple(r)[1:] for r in got.df.orderBy("_row").collect()] == [
        ("a\n\"b\"\r", 1, 2.5, None), (None, 2**40, None, None), ("\u2028c\\", None, 1.0, None)]


def test_records_view_empty_partial_and_foreign(spark, sheet_of, tmp_path, monkeypatch):
    empty = sheet_of([], "a long, b string")
    got, head = records.read_view(spark, records.write_view(empty, str(tmp_path / "e"), "f", "n"))
    assert got.columns == ["a", "b"] and got.df.count() == 0 and head["metadata"]["rows"] == 0
    monkeypatch.setattr(records, "ROWS_PER_PART", 100)
    many = sheet_of([(i,) for i in range(1000)], "a long")
    path = records.write_view(many, str(tmp_path / "m"), "f", "n")
    parts = sorted((tmp_path / "m").glob("part*"))
    assert len(parts) == 11
    text = "".join(p.read_text() for p in parts).splitlines()  # the files in name order are the view
    assert [json.loads(x) for x in text[1:]] == [{"a": i} for i in range(1000)]
    assert [r.a for r in records.read_view(spark, path)[0].df.orderBy("_row").collect()] == list(range(1000))
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "x.txt").write_text("\n".join(text[:-3]))
    with pytest.raises(ValueError, match="997 records"):
        records.read_view(spark, str(tmp_path / "short"))
    (tmp_path / "bare.txt").write_text('{"a": 1}\n')
    with pytest.raises(ValueError, match="head"):
        records.read_view(spark, str(tmp_path / "bare.txt"))
    # Headers pick and order columns; keys that no record has are null.
    (tmp_path / "own.txt").write_text('{"headers": ["b", "c"]}\n{"a": 1, "b": 2}\n{"b": 3}\n')
    got = records.read_view(spark, str(tmp_path / "own.txt"))[0]
    assert got.columns == ["b", "c"] and [(r.b, r.c) for r in got.df.orderBy("_row").collect()] == [(2, None), (3, None)]


def _write_xlsx(path):
    ct = ('<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
    wb = ('<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
          'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
          '<sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Second" sheetId="2" r:id="rId2"/></sheets></workbook>')
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="ws" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Type="ws" Target="worksheets/sheet2.xml"/></Relationships>')
    ss = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
          '<si><t>name</t></si><si><t>when</t></si><si><t>alice</t></si></sst>')
    styles = ('<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs count="2">'
              '<xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    s1 = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
          '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
          '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45292</v></c></row>'
          '<row r="4"><c r="A4"><v>7</v></c></row></sheetData></worksheet>')
    s2 = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
          '<row r="1"><c r="A1"><v>99</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", ss)
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", s1)
        z.writestr("xl/worksheets/sheet2.xml", s2)


def test_workbook_folder(spark):
    d = _tmp()
    for i in range(3):
        _write_xlsx(os.path.join(d, f"book{i}.xlsx"))
    rows = read_first_sheet(os.path.join(d, "book0.xlsx"))
    assert rows == [(0, ["name", "when"]), (1, ["alice", "2024-01-01 00:00:00"]), (2, []), (3, ["7"])]
    with open(os.path.join(d, "broken.xlsx"), "w") as f:
        f.write("no workbook")
    df = read_workbooks(spark, d)
    assert df.where("error is null and sheet_no = 0").count() == 12
    assert [tuple(r) for r in df.where("sheet = 'Second'").select("_row", "cells", "kinds").distinct().collect()] == [(0, ["99"], ["n"])]
    typed = workbook_table(df)
    assert typed.dtypes == [("path", "string"), ("_row", "bigint"), ("name", "string"), ("when", "timestamp_ntz")]
    assert sorted({(r["_row"], r["name"], str(r["when"])) for r in typed.collect()}) == [
        (0, "alice", "2024-01-01 00:00:00"), (2, "7", "None")]
    assert df.where(F.col("_row") == 1).select(F.element_at("cells", 1)).distinct().collect()[0][0] == "alice"
    assert [r.path.rsplit("/", 1)[1] for r in df.where("error is not null").collect()] == ["broken.xlsx"]


def _csv(text):
    p = os.path.join(_tmp(), "t.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_drops_no_cell(spark):
    for text in ("a,b\n1,2\n3,4,LOST\n", "a,b\n1,2\n3,4,,LOST\n", 'a,b\n1,"2,3"\n3,"x,y",z\n'):
        with pytest.raises(csvsrc.RaggedRows):
            csvsrc.read_csv_sheet(spark, _csv(text))
    short = csvsrc.read_csv_sheet(spark, _csv('a,b,c\n1\n"2,5",x\n'))
    assert [tuple(r) for r in short.df.orderBy("_row").collect()] == [(0, "1", None, None), (1, "2,5", "x", None)]


def test_csv_changes_no_value(spark):
    s = csvsrc.read_csv_sheet(spark, _csv(
        "suffix,big,huge,num,mixed,i\n1d,12345678901234567890,1" + "0" * 40 + ",1e3,1,7\n"
        "2f,12345678901234567891,2,-.5,x,-8\n"))
    types = dict(s.df.dtypes)
    assert [types[c] for c in s.columns] == ["string", "decimal(38,0)", "string", "double", "string", "bigint"]
    rows = s.df.orderBy("_row").collect()
    assert [r.suffix for r in rows] == ["1d", "2f"]
    assert [int(r.big) for r in rows] == [12345678901234567890, 12345678901234567891]
    assert [r.num for r in rows] == [1000.0, -0.5] and [r.i for r in rows] == [7, -8]


def test_records_infer_keys_and_types(spark):
    recs = [{}, {"a": 1, "q.x": "1"}, {"b`": 2.5, "a": 2}, {"n": None, "m": True, "o": {"k": [1]}},
            {"b`": 3, "m": "x", "l": 12345678901234567890, "z": False}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "_row long, record string")
    s = records.from_records(df, None)
    assert s.df.dtypes[1:] == [("a", "bigint"), ("q.x", "string"), ("b`", "double"), ("n", "string"), ("m", "string"),
                               ("o", "string"), ("l", "decimal(38,0)"), ("z", "boolean")]
    rows = [r.asDict() for r in s.df.orderBy("_row").collect()]
    assert [r["a"] for r in rows] == [None, 1, 2, None, None] and [r["b`"] for r in rows] == [None, None, 2.5, None, 3.0]
    assert rows[3]["m"] == "true" and rows[3]["o"] == '{"k":[1]}' and int(rows[4]["l"]) == 12345678901234567890
    assert records.from_records(df.where("_row = 0"), None).columns == []


def test_csv_line_breaks_by_default(spark, sheet_of):
    p = _csv("a,a,,when\n1,x,NA,2023-01-01\n\n,,,\n2,\"q,r\",None,2023-01-02\n3,\"multi\nline\",null,\n")
    s = csvsrc.read_csv_sheet(spark, p)
    assert [tuple(r) for r in s.df.orderBy("_row").collect()] == [
        (0, 1, "x", None, "2023-01-01"), (1, None, None, None, None),
        (2, 2, "q,r", None, "2023-01-02"), (3, 3, "multi\nline", None, None)]
    assert csvsrc.read_csv_sheet(spark, _csv('"a\nb",c\n1,2\n')).columns == ["a\nb", "c"]
    texts = ["plain"] * 12 + ["x", "two\nlines", "a,b\n\nc", "plain", "z", '"\n', "one, two", "\n", "end"]
    rows = [(i, t) for i, t in enumerate(texts)]
    path = csvsrc.write_csv_sheet(sheet_of(rows, "k long, s string"), os.path.join(_tmp(), "out dir"), partitions=4)
    assert 0 < len(csvsrc.files_with_open_quotes(spark, path)) < 4
    back = csvsrc.read_csv_sheet(spark, path)
    assert [tuple(r)[1:] for r in back.df.orderBy("_row").collect()] == rows and back.n_rows == len(rows)


def test_csv_open_quotes_are_found(spark):
    closed = ['a,b', '"a",b', 'a,"b, c",""', '"say ""so""",x', '"",""', '""', '"a","b"', '"a\\"', 'a"b"c,d"', '5" pipe,x']
    opened = ['a,"b', '"a"",b', 'x,"a""', '5" pipe,"open', '"', 'a"b"c,"d', '"""']
    for line in closed + opened:
        found = csvsrc.files_with_open_quotes(spark, _csv(line + "\n"))
        assert bool(found) == (line in opened), line


@pytest.mark.parametrize("seed", [1, 2])
def test_csv_reads_and_writes_as_pandas_does(spark, sheet_of, seed, monkeypatch):
    import random

    import pandas as pd

    from gridframe.plans import running

    monkeypatch.setattr(running, "_MIN_WIDTH", 3)  # states are carried over many buckets
    r = random.Random(seed)
    bits = ['"', "\\", "\n", ",", "x", " y", "é", '""', "\r\n", "'", '"\n"', '",\n"', "C:\\dir\\"]
    rows = [(i, "t" + "".join(r.choice(bits) for _ in range(r.randint(0, 6))) + "t", r.choice(["p", 'q"', None])) for i in range(120)]
    p = os.path.join(_tmp(), "t.csv")
    pd.DataFrame(rows, columns=["k", "a", "b"]).to_csv(p, index=False)
    want = [tuple(None if pd.isna(v) else v for v in x) for x in pd.read_csv(p).itertuples(index=False)]
    got = [tuple(x)[1:] for x in csvsrc.read_csv_sheet(spark, p).df.orderBy("_row").collect()]
    assert got == want == rows
    out = csvsrc.write_csv_sheet(sheet_of(rows, "k long, a string, b string"), os.path.join(_tmp(), "o"), partitions=3)
    parts = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
    frames = [pd.read_csv(os.path.join(out, f), header=0 if i == 0 else None, names=["k", "a", "b"]) for i, f in enumerate(parts)]
    back = [tuple(None if pd.isna(v) else v for v in x) for x in pd.concat(frames).itertuples(index=False)]
    assert back == rows
    again = csvsrc.read_csv_sheet(spark, out)
    assert [tuple(x)[1:] for x in again.df.orderBy("_row").collect()] == rows


def test_csv_that_ends_inside_quotes_raises(spark):
    with pytest.raises(csvsrc.OpenQuotes):
        csvsrc.read_csv_sheet(spark, _csv('a,b\n1,"never closed\n2,x\n'))


def test_workbook_rows_stream_and_hold_no_tree(tmp_path):
    import tracemalloc

    from gridframe.sources.workbook import workbook_rows

    p = str(tmp_path / "big.xlsx")
    _write_xlsx(p)
    rows = "".join(f'<row r="{i + 1}"><c r="C{i + 1}"><v>{i}</v></c></row>' for i in range(40_000))
    with zipfile.ZipFile(p, "a") as z:
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    tracemalloc.start()
    n = sum(1 for r in workbook_rows(p) if r[0] == 0 and r[3] == [None, None, str(r[2])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and peak < 4_000_000


def test_workbook_rows_travel_with_their_head(spark):
    """Typing a folder reads its rows once and shuffles none of them."""
    d = _tmp()
    for i in range(2):
        _write_xlsx(os.path.join(d, f"book{i}.xlsx"))
    df = read_workbooks(spark, d)
    heads = {tuple(r) for r in df.select("sheet", "_row", F.concat_ws(",", "head")).collect()}
    assert heads == {*[("First", i, "name,when") for i in range(4)], ("Second", 0, "99")}
    plan = workbook_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1 and "rightHint=(strategy=broadcast)" in plan


def test_workbook_cells_of_every_kind(tmp_path):
    from gridframe.sources.workbook import workbook_rows

    p = str(tmp_path / "kinds.xlsx")
    _write_xlsx(p)
    rows = ('<row r="2"><c t="inlineStr"><is><r><t>a &amp; b</t></r><r><t xml:space="preserve"> cé</t></r></is></c>'
            '<c r="D2" t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>x<!-- no -->y</v></c></row>'
            '<row><c/><c s="1"><v>45292.5</v></c><c><v></v></c><c t="s"><v>2</v></c></row><row r="5"/>')
    with zipfile.ZipFile(p, "a") as z:
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    got = [r[2:] for r in workbook_rows(p) if r[0] == 0]
    assert got == [
        (0, [], []), (1, ["a & b cé", None, None, "TRUE", "#N/A", "xy"], ["s", None, None, "b", "e", "s"]),
        (2, [None, "2024-01-01 12:00:00", None, "alice"], [None, "d", None, "s"]), (3, [], []), (4, [], [])]
    with zipfile.ZipFile(p, "a") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><row/><row></c>')
    with pytest.raises(ET.ParseError):
        list(workbook_rows(p))


def test_books_are_built_from_whole_columns(spark, tmp_path):
    """Orders with nulls make the same cells as ever, without a frame's rows."""
    from gridframe import fixtures as fx
    from gridframe.sources.workbook import parse_workbooks

    rows = [(1, 7, "O", 10.5, "2024-01-01", "1-URGENT"), (2, None, None, None, "2024-01-03", "a < b & c"), (None, 9, "F", 1e22, "2024-01-02", None)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string")
    df.withColumn("o_orderdate", F.col("d").cast("timestamp_ntz")).drop("d").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r._row: r.cells for r in parse_workbooks(fx.order_books(spark, str(tmp_path))).where("sheet_no = 0").collect()}
    assert got[0] == fx.ORDERS_COLS and sorted(map(repr, got.values())) == sorted(map(repr, [
        fx.ORDERS_COLS, ["nan", "9.0", "F", "1e+22", "2024-01-02 00:00:00", "None"],
        ["1.0", "7.0", "O", "10.5", "2024-01-01 00:00:00", "1-URGENT"], ["2.0", "nan", "None", "nan", "2024-01-03 00:00:00", "a < b & c"]]))

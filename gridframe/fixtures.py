"""Derived fixtures (FIXTURES.md) built from the driver's tables, each with
its DuckDB twin used by the correctness oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.sheet import Sheet

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_ORDER_SQL = "o_totalprice DESC, o_orderkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """Orders ordered by (o_totalprice desc, o_orderkey): the key is not the
    contiguous id, so a mix-up of key and ordinal would show."""
    df = table(spark, sf_dir, "orders").select(*ORDERS_COLS)
    return Sheet.from_df(df, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


ORDERS_SHEET_SQL = (
    f"SELECT row_number() OVER (ORDER BY {ORDERS_ORDER_SQL}) - 1 AS _row, "
    + ", ".join(ORDERS_COLS) + " FROM orders"
)


def customer_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """Customer ordered by (c_acctbal desc, c_custkey)."""
    df = table(spark, sf_dir, "customer")
    return Sheet.from_df(df, [F.col("c_acctbal").desc(), F.col("c_custkey")])


CUSTOMER_SHEET_SQL = (
    "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS _row, "
    "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
)


def holey_customer_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with holes: c_name null if key % 5 = 0; c_mktsegment '  ' if
    key % 7 = 0; every cell null if key % 11 = 0; plus an all-null column."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    gone = (k % 11) == 0
    cols = []
    for name in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]:
        v = F.col(name)
        if name == "c_name":
            v = F.when(k % 5 != 0, v)
        if name == "c_mktsegment":
            v = F.when(k % 7 == 0, F.lit("  ")).otherwise(v)
        cols.append(F.when(~gone, v).alias(name))
    cols.append(F.lit(None).cast("string").alias("blank_col"))
    return c.select(*cols, F.col("c_custkey").alias("__key"))


HOLEY_CUSTOMER_SQL = """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS c_custkey,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_mktsegment END AS c_mktsegment,
  CAST(NULL AS VARCHAR) AS blank_col
FROM customer
"""


def holey_customer(spark: SparkSession, sf_dir: str) -> Sheet:
    """Holey customer as a sheet, ordered by the original key."""
    s = Sheet.from_df(holey_customer_df(spark, sf_dir), [F.col("__key")])
    return Sheet(s.df.drop("__key"))


# -- edit batches -------------------------------------------------------------
def cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell edits from events: seq = event_id, row = user_id, col = event_id
    % 8 (some out of range), new value = event_type, '' for errors."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("row"),
        (F.col("event_id") % 8).cast("int").alias("col"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("new_value"),
    )


CELL_EDITS_SQL = (
    "SELECT event_id AS seq, user_id AS row, CAST(event_id % 8 AS INTEGER) AS col, "
    "CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS new_value FROM events"
)

# Fixed structural batch interleaved with the cell edits by seq.
STRUCTURAL_BATCH = [
    {"seq": 500, "type": "row", "action": "create", "index": 5, "amount": 3},
    {"seq": 1200, "type": "col", "action": "create", "index": 2, "amount": 2},
    {"seq": 1800, "type": "row", "action": "remove", "index": 0, "amount": 2},
    {"seq": 2500, "type": "col", "action": "remove", "index": 0, "amount": 1},
    {"seq": 3100, "type": "row", "action": "create", "index": 100, "amount": 1},
    {"seq": 3900, "type": "row", "action": "remove", "index": 50, "amount": 10},
    {"seq": 4400, "type": "col", "action": "create", "index": 7, "amount": 1},
    {"seq": 5200, "type": "row", "action": "create", "index": 1000000, "amount": 2},
    {"seq": 6000, "type": "col", "action": "remove", "index": 3, "amount": 2},
    {"seq": 6800, "type": "row", "action": "remove", "index": 20, "amount": 1},
    {"seq": 7500, "type": "row", "action": "create", "index": 0, "amount": 1},
    {"seq": 8300, "type": "col", "action": "create", "index": 0, "amount": 1},
]


BIG = 1 << 60


def changed_customer(spark: SparkSession, sf_dir: str) -> Sheet:
    """Next version of the customer sheet: c_nationkey dropped, flag added,
    c_name changed if key % 13 = 0, c_acctbal nulled if key % 17 = 0,
    c_custkey turned into a double (equal by value), last 10 rows dropped."""
    s = customer_sheet(spark, sf_dir)
    k = F.col("c_custkey")
    df = s.df.where(F.col("_row") < s.n_rows - 10).select(
        "_row", k.cast("double").alias("c_custkey"),
        F.when(k % 13 == 0, F.concat(F.col("c_name"), F.lit("*"))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 17 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment", (k % 2).cast("int").alias("flag"),
        (F.lit(BIG) + k + (k % 19 == 0).cast("int")).alias("big"))
    return Sheet(df)


def big_customer_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """The customer sheet with integers that no floating value can tell apart."""
    s = customer_sheet(spark, sf_dir)
    return Sheet(s.df.withColumn("big", F.lit(BIG) + F.col("c_custkey")), s.n_rows)


CHANGED_CUSTOMER_SQL = f"""
SELECT _row, CAST(c_custkey AS DOUBLE) AS c_custkey,
  CASE WHEN c_custkey % 13 = 0 THEN c_name || '*' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment,
  CAST(c_custkey % 2 AS INTEGER) AS flag, {BIG} + c_custkey + CAST(c_custkey % 19 = 0 AS INTEGER) AS big
FROM ({CUSTOMER_SHEET_SQL}) s WHERE _row < (SELECT count(*) FROM customer) - 10"""


def typed_part(spark: SparkSession, sf_dir: str) -> Sheet:
    """Part plus typed columns: bool, bool with nulls, integer-valued double,
    all-null, timestamp, string; ordered by (p_retailprice desc, p_partkey)."""
    p = table(spark, sf_dir, "part")
    df = p.select(
        "*", (F.col("p_size") % 2 == 0).alias("is_even"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 2 == 0).alias("maybe_even"),
        F.col("p_size").cast("double").alias("size_d"),
        F.lit(None).cast("double").alias("nothing"),
        F.timestamp_add("MINUTE", F.col("p_partkey"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("seen"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"))
    return Sheet.from_df(df, [F.col("p_retailprice").desc(), F.col("p_partkey")])


TYPED_PART_SQL = """
SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS _row, *,
  p_size % 2 = 0 AS is_even, CASE WHEN p_size % 3 <> 0 THEN p_size % 2 = 0 END AS maybe_even,
  CAST(p_size AS DOUBLE) AS size_d, CAST(NULL AS DOUBLE) AS nothing,
  TIMESTAMP '2020-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS seen, 'P' || CAST(p_partkey AS VARCHAR) AS code
FROM part"""
TYPED_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "is_even",
                   "maybe_even", "size_d", "nothing", "seen", "code"]


CUSTOMER_TEXT = ["c_custkey", "c_name", "c_nationkey"]


def customer_text(spark: SparkSession, sf_dir: str) -> Sheet:
    """Customer as a raw text sheet: header row, then rows as text (c0, c1, c2)."""
    n = table(spark, sf_dir, "customer")
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("k"),
                                 *[F.lit(c).alias(f"c{i}") for i, c in enumerate(CUSTOMER_TEXT)])
    body = n.select(F.col("c_custkey").cast("bigint").alias("k"),
                    *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(CUSTOMER_TEXT)])
    s = Sheet.from_df(head.unionByName(body), [F.col("k")])
    return Sheet(s.df.drop("k"))


# Stacked tables: a third of all orders lie in one table, the others in tables by
# customer; the headers vary in case and order, and blank rows lie between.
STACK_TABLES = 60
STACK_HEADERS = [["o_orderkey", "o_orderstatus", "o_totalprice"], ["O_ORDERKEY", "o orderstatus", "O-TotalPrice"],
                 ["o_totalprice", "o_orderkey", "o_orderstatus"]]
STACK_PART_SQL = f"CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % {STACK_TABLES - 1} END"


def text_stack(spark: SparkSession, sf_dir: str) -> Sheet:
    """Orders as stacked tables in one text sheet: for each table a header, its
    rows and a blank row."""
    o = table(spark, sf_dir, "orders")
    part = F.expr(STACK_PART_SQL).cast("bigint")
    cols = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string")]
    third = part % 3 == 2
    cells = [F.when(third, cols[[2, 0, 1][i]]).otherwise(c).alias(f"c{i}") for i, c in enumerate(cols)]
    body = o.select(part.alias("part"), F.col("o_orderkey").cast("bigint").alias("k"), *cells)
    tables = spark.range(STACK_TABLES)
    names = F.get(F.array(*[F.array(*[F.lit(x) for x in h]) for h in STACK_HEADERS]), (F.col("id") % 3).cast("int"))
    heads = tables.select(F.col("id").alias("part"), F.lit(-1).cast("bigint").alias("k"),
                          *[names[i].alias(f"c{i}") for i in range(3)])
    gaps = tables.select(F.col("id").alias("part"), F.lit((1 << 63) - 1).alias("k"),
                         *[F.lit(None).cast("string").alias(f"c{i}") for i in range(3)])
    s = Sheet.from_df(heads.unionByName(body).unionByName(gaps), [F.col("part"), F.col("k")])
    return Sheet(s.df.drop("part", "k"))


def _text_stack_sql() -> str:
    heads = ", ".join("[" + ", ".join(f"'{x}'" for x in h) + "]" for h in STACK_HEADERS)
    return f"""
SELECT row_number() OVER (ORDER BY part, k) - 1 AS _row, c0, c1, c2 FROM (
  SELECT i AS part, -1 AS k, [{heads}][i % 3 + 1][1] AS c0, [{heads}][i % 3 + 1][2] AS c1, [{heads}][i % 3 + 1][3] AS c2
    FROM range({STACK_TABLES}) r(i)
  UNION ALL SELECT i, 9223372036854775807, NULL, NULL, NULL FROM range({STACK_TABLES}) r(i)
  UNION ALL SELECT p, o_orderkey, CASE WHEN p % 3 = 2 THEN t ELSE ok END, CASE WHEN p % 3 = 2 THEN ok ELSE o_orderstatus END,
    CASE WHEN p % 3 = 2 THEN o_orderstatus ELSE t END
    FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS ok, CAST(o_totalprice AS VARCHAR) AS t,
          {STACK_PART_SQL} AS p FROM orders))"""


TEXT_STACK_SQL = _text_stack_sql()


# Orders and customers as stacked tables whose columns are renamed, reordered or
# left out; every third order is in table 0, the last tables hold customers.
VARIED_TABLES, CUSTOMER_TABLES = 40, 4
VARIED_PART_SQL = f"CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % {VARIED_TABLES - 1} END"
#: By table number modulo 4: places of key, status, price and priority, and the headers.
VARIED_LAYOUTS = [
    ([0, 1, 2, 3], ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    ([0, 1, 2, 3], ["Order No", "State", "Amount", "Urgency"]),
    ([2, 3, 0, 1], ["Total", "Priority", "OrderKey", "St"]),
    ([1, 0, 2, None], ["status", "order_key", "price", None]),
]
VARIED_CUSTOMER = ["custkey", "name", "acctbal", "mktsegment"]


def varied_stack(spark: SparkSession, sf_dir: str) -> Sheet:
    """One text sheet: for each table a header, its rows and a blank row."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    part = F.expr(VARIED_PART_SQL).cast("bigint")
    cells = [F.col(n).cast("string") for n in VARIED_LAYOUTS[0][1]]
    none = F.lit(None).cast("string")

    def by_layout(i: int):
        of = [none if places[i] is None else cells[places[i]] for places, _ in VARIED_LAYOUTS]
        return F.when(part % 4 == 0, of[0]).when(part % 4 == 1, of[1]).when(part % 4 == 2, of[2]).otherwise(of[3])

    orders = o.select(part.alias("part"), F.col("o_orderkey").cast("bigint").alias("k"), *[by_layout(i).alias(f"c{i}") for i in range(4)])
    customers = c.select((VARIED_TABLES + F.col("c_custkey") % CUSTOMER_TABLES).cast("bigint").alias("part"),
                         F.col("c_custkey").cast("bigint").alias("k"),
                         *[F.col("c_" + n).cast("string").alias(f"c{i}") for i, n in enumerate(VARIED_CUSTOMER)])
    tables = spark.range(VARIED_TABLES + CUSTOMER_TABLES).withColumnRenamed("id", "part")
    headers = F.array(*[F.array(*[F.lit(x).cast("string") for x in h]) for _, h in VARIED_LAYOUTS])
    names = F.when(F.col("part") < VARIED_TABLES, F.get(headers, (F.col("part") % 4).cast("int"))).otherwise(
        F.array(*[F.lit(x) for x in VARIED_CUSTOMER]))
    heads = tables.select("part", F.lit(-1).cast("bigint").alias("k"), *[names[i].alias(f"c{i}") for i in range(4)])
    gaps = tables.select("part", F.lit((1 << 63) - 1).alias("k"), *[none.alias(f"c{i}") for i in range(4)])
    s = Sheet.from_df(heads.unionByName(orders).unionByName(customers).unionByName(gaps), [F.col("part"), F.col("k")])
    return Sheet(s.df.drop("part", "k"))


# -- file listing from documents -------------------------------------------------
_CLASSES = ["upload", "download", "json", "script", "temp"]
_EXTS = [".csv", ".XLSX", ".xls", ".txt", ""]


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, length, modified, class derived from documents."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    cls = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.floor(i / 5) % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (i % 5 + 1).cast("int"))
    name = (F.when((cls == "script") & (i % 2 == 0), F.concat(F.lit("script_"), i.cast("string"), F.lit(".py")))
            .when(i % 50 == 7, F.lit(".gitkeep")).when(i % 50 == 17, F.lit("manifest.json"))
            .otherwise(F.concat(F.lit("f"), i.cast("string"), ext)))
    modified = F.timestamp_add("MINUTE", -i, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return d.select(F.concat(cls, F.lit("/"), name).alias("path"), (F.col("n_chars") * 4096).alias("length"),
                    modified.alias("modified"), cls.alias("class"))


FILE_LISTING_SQL = """
SELECT cls || '/' || CASE WHEN cls = 'script' AND doc_id % 2 = 0 THEN 'script_' || doc_id || '.py'
    WHEN doc_id % 50 = 7 THEN '.gitkeep' WHEN doc_id % 50 = 17 THEN 'manifest.json'
    ELSE 'f' || doc_id || ext END AS path,
  n_chars * 4096 AS length, TIMESTAMP '2025-01-01 00:00:00' - doc_id * INTERVAL 1 MINUTE AS modified, cls AS class
FROM (SELECT *, ['upload', 'download', 'json', 'script', 'temp'][CAST((doc_id // 5) % 5 + 1 AS INTEGER)] AS cls,
  ['.csv', '.XLSX', '.xls', '.txt', ''][CAST(doc_id % 5 + 1 AS INTEGER)] AS ext FROM documents)"""


#: Orders in one workbook.
BOOK_ROWS = 500


def order_books(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): the orders sheet as workbooks of two sheets, written in tasks."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"

    def text(v) -> str:
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def sheet(rows: list[str]) -> str:
        return f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{r}</row>" for r in rows)}</sheetData></worksheet>'

    def book(orders: pd.DataFrame) -> pd.DataFrame:
        orders = orders.sort_values("_row")
        names = list(ORDERS_COLS)
        days = (orders["o_orderdate"] - pd.Timestamp(1899, 12, 30)) / pd.Timedelta(days=1)
        # Whole columns at once: a frame's rows, one by one, take most of the time.
        cells = [[f'<c s="1"><v>{float(day)!r}</v></c>' for day in days.tolist()] if c == "o_orderdate" else
                 [f"<c><v>{v}</v></c>" for v in orders[c].tolist()] if c in ("o_orderkey", "o_custkey", "o_totalprice") else
                 [text(v) for v in orders[c].tolist()] for c in names]
        rows = ["".join(map(text, names)), *map("".join, zip(*cells, strict=True))]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="orders" sheetId="1" '
                       'r:id="a"/><sheet name="size" sheetId="2" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="a" '
                       'Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/s1.xml", sheet(rows))
            z.writestr("xl/worksheets/s2.xml", sheet([text("rows"), f"<c><v>{len(orders)}</v></c>"]))
        return pd.DataFrame({"path": [f"book-{orders['_row'].iloc[0] // BOOK_ROWS}.xlsx"], "content": [out.getvalue()]})

    rows = orders_sheet(spark, sf).df
    return rows.groupBy(F.floor(F.col("_row") / BOOK_ROWS)).applyInPandas(book, "path string, content binary")

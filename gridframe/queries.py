"""Driver queries: one Spark callable and one DuckDB oracle per operator.

Every query reads the driver's tables (or data Spark derives from them) in
full, so its work grows with the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe import fixtures as fx
from gridframe.functions import letters as L
from gridframe.operators import address
from gridframe.operators.meta import sheet_meta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# -- A1 row ordinals ----------------------------------------------------------
@query("row_ordinal", fx.ORDERS_SHEET_SQL)
def row_ordinal(spark, sf):
    return fx.orders_sheet(spark, sf).df


# -- A5/A8 range reads ---------------------------------------------------------
@query("range_read", f"SELECT _row, o_custkey, o_orderstatus, o_totalprice FROM ({fx.ORDERS_SHEET_SQL}) s "
       "WHERE _row BETWEEN 1 AND 499")
def range_read(spark, sf):
    return address.read_range(fx.orders_sheet(spark, sf), "B2:D500")


@query("range_list", f"""
SELECT _row,
  CASE WHEN _row = 0 OR _row = 6 THEN o_orderkey END AS o_orderkey,
  CASE WHEN _row BETWEEN 1 AND 3 OR _row = 6 THEN o_custkey END AS o_custkey,
  CASE WHEN _row BETWEEN 1 AND 3 OR _row = 6 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN _row = 6 THEN o_totalprice END AS o_totalprice,
  CASE WHEN _row = 6 THEN o_orderdate END AS o_orderdate,
  CASE WHEN _row = 6 THEN o_orderpriority END AS o_orderpriority
FROM ({fx.ORDERS_SHEET_SQL}) s WHERE _row = 0 OR _row BETWEEN 1 AND 3 OR _row = 6""")
def range_list(spark, sf):
    return address.read_range(fx.orders_sheet(spark, sf), "A1, B2:C4, 7")


_CELLS = ("[CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), "
          "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority]")


@query("range_batch", f"""
WITH n AS (SELECT count(*) AS n FROM orders),
r AS (SELECT event_id AS id, 0 AS part, event_id * 13 % n AS r1, event_id * 13 % n + user_id % 7 AS r2, event_id % 4 AS c1,
        event_id % 4 + event_id % 3 AS c2, n FROM events, n WHERE event_id % 10 > 0
      UNION ALL SELECT event_id, 0, event_id * 7 % n, event_id * 7 % n + 1, 0, 5, n FROM events, n WHERE event_id % 10 = 0
      UNION ALL SELECT event_id, 1, user_id, user_id, 2, 2, n FROM events, n WHERE event_id % 10 = 0),
ok AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM r WHERE r2 >= n OR c2 > 5))
SELECT id, part, _row, c1 AS col, ({_CELLS})[c1 + 1:c2 + 1] AS cells
FROM ok JOIN ({fx.ORDERS_SHEET_SQL}) s ON _row BETWEEN r1 AND r2""")
def range_batch(spark, sf):
    """A8 for as many selections as events; some leave the sheet."""
    sheet = fx.orders_sheet(spark, sf)
    k, n = F.col("event_id"), sheet.n_rows
    letter = lambda c: F.chr((c + 65).cast("int"))
    text = lambda c: c.cast("string")
    r1 = k * 13 % n
    block = F.concat(letter(k % 4), text(r1 + 1), F.lit(":"), letter(k % 4 + k % 3), text(r1 + F.col("user_id") % 7 + 1))
    rows = F.concat(text(k * 7 % n + 1), F.lit(":"), text(k * 7 % n + 2), F.lit(", c"), text(F.col("user_id") + 1))
    ev = fx.table(spark, sf, "events").select(k.alias("id"), F.when(k % 10 > 0, block).otherwise(rows).alias("selection"))
    return address.read_ranges(sheet, ev)


# -- S6 grid page / S7 metadata -----------------------------------------------
@query("grid_page", f"""
SELECT _row, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '') AS o_orderdate, o_orderpriority
FROM ({fx.ORDERS_SHEET_SQL}) s WHERE _row >= 100 AND _row < 200""")
def grid_page(spark, sf):
    return address.grid_page(fx.orders_sheet(spark, sf), 100, 200)


@query("sheet_meta", "SELECT CAST(6 AS BIGINT) AS columns, count(*) AS rows FROM orders")
def sheet_meta_q(spark, sf):
    return sheet_meta(fx.orders_sheet(spark, sf))


# -- A2/A3 column letters ------------------------------------------------------
@query("col_letters", f"""
SELECT p_partkey, {L.letters_sql('p_partkey', 4)} AS letters,
  list_reduce(list_transform(str_split({L.letters_sql('p_partkey', 4)}, ''), lambda c: ascii(c) - 64),
              lambda a, b: a * 26 + b) - 1 AS back
FROM part""")
def col_letters(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey")
    letters = L.column_letters("p_partkey")
    return p.select("p_partkey", letters.alias("letters"), L.column_index(letters).alias("back"))


# -- E1-E14 edits ----------------------------------------------------------------
from gridframe.operators import edits as ed  # noqa: E402
from gridframe.oracles import batch_sql  # noqa: E402

_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUST_N = "SELECT count(*) FROM customer"
_ORD_N = "SELECT count(*) FROM orders"


@query("cells_update", batch_sql(fx.CUSTOMER_SHEET_SQL, _CUST_COLS, set(_CUST_COLS), [], fx.CELL_EDITS_SQL, _CUST_N))
def cells_update(spark, sf):
    return ed.update_cells(fx.customer_sheet(spark, sf), fx.cell_edits(spark, sf)).sheet.df


@query("cells_touched", batch_sql(fx.CUSTOMER_SHEET_SQL, _CUST_COLS, set(_CUST_COLS), [], fx.CELL_EDITS_SQL,
                                  _CUST_N, "touched"))
def cells_touched(spark, sf):
    return ed.update_cells(fx.customer_sheet(spark, sf), fx.cell_edits(spark, sf)).touched


_ROWS_INSERT = [{"seq": 1, "type": "row", "action": "create", "index": 10, "amount": 5},
                {"seq": 2, "type": "row", "action": "create", "index": 10**9, "amount": 2}]
_ROWS_REMOVE = [{"seq": 1, "type": "row", "action": "remove", "index": 3, "amount": 100},
                {"seq": 2, "type": "row", "action": "remove", "index": 0, "amount": 1}]


@query("rows_insert", batch_sql(fx.ORDERS_SHEET_SQL, fx.ORDERS_COLS, set(), _ROWS_INSERT, None, _ORD_N))
def rows_insert(spark, sf):
    return ed.apply_batch(fx.orders_sheet(spark, sf), _ROWS_INSERT).sheet.df


@query("rows_remove", batch_sql(fx.ORDERS_SHEET_SQL, fx.ORDERS_COLS, set(), _ROWS_REMOVE, None, _ORD_N))
def rows_remove(spark, sf):
    return ed.apply_batch(fx.orders_sheet(spark, sf), _ROWS_REMOVE).sheet.df


_COLS_INSERT = [{"seq": 1, "type": "col", "action": "create", "index": 1, "amount": 2},
                {"seq": 2, "type": "col", "action": "create", "index": 7, "amount": 1}]
_COLS_REMOVE = [{"seq": 1, "type": "col", "action": "remove", "index": 3, "amount": 10}]


@query("cols_insert", batch_sql(fx.CUSTOMER_SHEET_SQL, _CUST_COLS, set(), _COLS_INSERT, None, _CUST_N))
def cols_insert(spark, sf):
    return ed.apply_batch(fx.customer_sheet(spark, sf), _COLS_INSERT).sheet.df


@query("cols_remove", batch_sql(fx.CUSTOMER_SHEET_SQL, _CUST_COLS, set(), _COLS_REMOVE, None, _CUST_N))
def cols_remove(spark, sf):
    return ed.apply_batch(fx.customer_sheet(spark, sf), _COLS_REMOVE).sheet.df


@query("cols_drop_letters", f"SELECT _row, c_name, c_acctbal FROM ({fx.CUSTOMER_SHEET_SQL}) s")
def cols_drop_letters(spark, sf):
    return ed.drop_cols_by_letters(fx.customer_sheet(spark, sf), ["A", "C", "E"]).df


@query("mixed_batch", batch_sql(fx.ORDERS_SHEET_SQL, fx.ORDERS_COLS, set(fx.ORDERS_COLS), fx.STRUCTURAL_BATCH,
                                fx.CELL_EDITS_SQL, _ORD_N))
def mixed_batch(spark, sf):
    return ed.apply_batch(fx.orders_sheet(spark, sf), fx.STRUCTURAL_BATCH, fx.cell_edits(spark, sf)).sheet.df


@query("mixed_touched", batch_sql(fx.ORDERS_SHEET_SQL, fx.ORDERS_COLS, set(fx.ORDERS_COLS), fx.STRUCTURAL_BATCH,
                                  fx.CELL_EDITS_SQL, _ORD_N, "touched"))
def mixed_touched(spark, sf):
    return ed.apply_batch(fx.orders_sheet(spark, sf), fx.STRUCTURAL_BATCH, fx.cell_edits(spark, sf)).touched


# -- E5-E9 column operators --------------------------------------------------------
@query("derived_sum", """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS _row, *,
  l_quantity + l_extendedprice AS total FROM lineitem""")
def derived_sum(spark, sf):
    from gridframe.sheet import Sheet
    li = fx.table(spark, sf, "lineitem")
    sheet = Sheet.from_df(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    letter = address.index_to_letters(sheet.columns.index("l_quantity"))
    return ed.derived_sum(sheet, letter, "l_extendedprice", "total").df


_NO_ORDERS_SQL = """SELECT _row, CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS BIGINT) AS o_custkey,
  CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate,
  CAST(NULL AS VARCHAR) AS o_orderpriority"""


@query("blank_template", f"{_NO_ORDERS_SQL} FROM ({fx.ORDERS_SHEET_SQL}) s")
def blank_template(spark, sf):
    return ed.blank_template(fx.orders_sheet(spark, sf)).df


@query("error_column", f"""SELECT *, 'Failed to process command: quota exceeded' AS "ERROR" FROM ({fx.ORDERS_SHEET_SQL}) s""")
def error_column(spark, sf):
    return ed.error_column(fx.orders_sheet(spark, sf), "quota exceeded").df


@query("append_row", f"""SELECT * FROM ({fx.ORDERS_SHEET_SQL}) s
  UNION ALL {_NO_ORDERS_SQL} FROM (SELECT count(*) AS _row FROM orders)""")
def append_row(spark, sf):
    return ed.append_row(fx.orders_sheet(spark, sf)).df


# -- C1-C5 cleaning -------------------------------------------------------------------
from gridframe.operators import clean  # noqa: E402
from gridframe.functions.text import shape_sql  # noqa: E402

_HOLEY_BLANK = ("(c_custkey IS NULL AND c_name IS NULL AND c_nationkey IS NULL AND c_acctbal IS NULL "
                "AND (c_mktsegment IS NULL OR trim(c_mktsegment) = '') AND blank_col IS NULL)")


@query("blank_rows", f"""SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, c_custkey, c_name, c_nationkey,
  c_acctbal, c_mktsegment, blank_col FROM ({fx.HOLEY_CUSTOMER_SQL}) h WHERE NOT {_HOLEY_BLANK}""")
def blank_rows(spark, sf):
    return clean.drop_blank_rows(fx.holey_customer(spark, sf)).df


@query("blank_cols", f"""SELECT _row, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM ({fx.HOLEY_CUSTOMER_SQL}) h""")
def blank_cols(spark, sf):
    return clean.drop_blank_cols(fx.holey_customer(spark, sf)).df


_EXAMPLES = ["Customer#000000001", "BUILDING"]
_SHAPES = "list_value(" + ", ".join(shape_sql(c) for c in
                                    ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "blank_col"]) + ")"


@query("rows_by_example", f"""SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, c_custkey, c_name,
  c_nationkey, c_acctbal, c_mktsegment, blank_col FROM ({fx.HOLEY_CUSTOMER_SQL}) h
  WHERE coalesce(list_contains({_SHAPES}, 'A#9'), false) AND coalesce(list_contains({_SHAPES}, 'A'), false)""")
def rows_by_example(spark, sf):
    return clean.keep_rows_by_example(fx.holey_customer(spark, sf), _EXAMPLES).df


@query("iso_to_date", f"""SELECT _row, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_text, o_orderpriority FROM ({fx.ORDERS_SHEET_SQL}) s""")
def iso_to_date(spark, sf):
    from gridframe.sheet import Sheet
    s = fx.orders_sheet(spark, sf)
    df = s.df.select("_row", "o_orderkey", "o_orderdate",
                     F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_text"), "o_orderpriority")
    return clean.iso_to_date(Sheet(df)).df


# -- D1 diff ----------------------------------------------------------------------------
from gridframe.operators import diff  # noqa: E402


@query("modified_cells", f"""
WITH o AS ({fx.CUSTOMER_SHEET_SQL}), n AS ({fx.CHANGED_CUSTOMER_SQL})
SELECT n._row AS row, CAST(0 AS BIGINT) AS col FROM o JOIN n USING (_row) WHERE o.c_custkey IS DISTINCT FROM n.c_custkey
UNION ALL SELECT n._row, 1 FROM o JOIN n USING (_row) WHERE o.c_name IS DISTINCT FROM n.c_name
UNION ALL SELECT n._row, 2 FROM o JOIN n USING (_row) WHERE o.c_acctbal IS DISTINCT FROM n.c_acctbal
UNION ALL SELECT n._row, 3 FROM o JOIN n USING (_row) WHERE o.c_mktsegment IS DISTINCT FROM n.c_mktsegment
UNION ALL SELECT _row, 4 FROM n
UNION ALL SELECT _row, 5 FROM n WHERE c_custkey % 19 = 0""")
def modified_cells(spark, sf):
    return diff.modified_cells(fx.big_customer_sheet(spark, sf), fx.changed_customer(spark, sf))


# -- P1-P7 profiling ---------------------------------------------------------------------
from gridframe.operators import profile as prof  # noqa: E402

_TYPES = {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string",
          "p_size": "integer", "p_retailprice": None, "is_even": "integer", "maybe_even": "string",
          "size_d": "integer", "nothing": "unknown", "seen": "datetime", "code": "string"}


def _types_sql():
    rows = []
    for i, c in enumerate(fx.TYPED_PART_COLS):
        t = _TYPES[c]
        kind = f"'{t}'" if t else f"CASE WHEN bool_and({c} % 1 = 0) THEN 'integer' ELSE 'float' END"
        if c == "nothing":
            kind = "'unknown'"
        rows.append(f"SELECT {i} AS position, '{c}' AS name, {kind} AS type, count({c}) AS non_null FROM t")
    return f"WITH t AS ({fx.TYPED_PART_SQL}) " + " UNION ALL ".join(rows)


@query("profile_types", _types_sql())
def profile_types(spark, sf):
    return prof.column_types_df(fx.typed_part(spark, sf))


def _samples_sql():
    parts = []
    for i, c in enumerate(fx.TYPED_PART_COLS):
        v = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c == "seen" else (
            f"CASE WHEN {c} THEN 'true' ELSE 'false' END" if c in ("is_even", "maybe_even") and False else
            f"CAST({c} AS VARCHAR)")
        parts.append(f"SELECT {i} AS position, _row, {v} AS value FROM t WHERE {c} IS NOT NULL")
    return (f"WITH t AS ({fx.TYPED_PART_SQL}), c AS ({' UNION ALL '.join(parts)}) "
            "SELECT CAST(position AS INTEGER) AS position, rank, value, row FROM (SELECT position, "
            "row_number() OVER (PARTITION BY position ORDER BY _row) AS rank, value, _row AS row FROM c) "
            "WHERE rank <= 3")


@query("profile_samples", _samples_sql())
def profile_samples(spark, sf):
    return prof.sample_values(fx.typed_part(spark, sf))


@query("profile_counts", f"SELECT count(*) AS row_count, {len(fx.TYPED_PART_COLS)} AS column_count FROM part")
def profile_counts(spark, sf):
    return prof.profile_counts(fx.typed_part(spark, sf))


@query("sample_rows", f"SELECT * FROM ({fx.TYPED_PART_SQL}) WHERE _row < 5")
def sample_rows(spark, sf):
    return prof.sample_rows(fx.typed_part(spark, sf))


@query("sheet_context", """
SELECT c_nationkey, to_json({'headers': ['c_custkey', 'c_name', 'c_mktsegment'], 'rows': count(*),
  'sample': list({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment} ORDER BY c_custkey)
            FILTER (WHERE rn <= 5)}) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
GROUP BY c_nationkey""")
def sheet_context(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    return prof.sheet_context(c, "c_nationkey", "c_custkey")


_PROFILE_KEYS = "o_custkey % 40"


def _order_profiles(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.expr(_PROFILE_KEYS).alias("sheet"), "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return prof.profile_documents(o, "sheet", "o_orderkey")


@query("sheet_profiles")
def sheet_profiles(spark, sf):
    """P5 over many sheets; null members of JSON objects are written by DuckDB
    and left out by Spark, so the oracle compares the parsed parts."""
    doc = _order_profiles(spark, sf)
    parsed = F.from_json("profile", "columns array<struct<name: string, type: string, sample_values: array<string>>>, "
                         "sample_data array<struct<o_orderstatus: string, o_orderpriority: string>>, "
                         "row_count bigint, column_count int")
    d = doc.select("sheet", parsed.alias("p"))
    return d.select(
        "sheet", F.col("p.row_count").alias("row_count"), F.col("p.column_count").alias("column_count"),
        F.concat_ws(",", "p.columns.name").alias("names"), F.concat_ws(",", "p.columns.type").alias("types"),
        F.concat_ws(",", F.flatten("p.columns.sample_values")).alias("samples"),
        F.concat_ws(",", F.transform("p.sample_data", lambda r: F.coalesce(r["o_orderpriority"], F.lit("-")))).alias("rows"))


ORACLES["sheet_profiles"] = f"""
WITH o AS (SELECT {_PROFILE_KEYS} AS sheet, o_orderkey, o_orderstatus,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS pr FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY o_orderkey) AS rn,
  CASE WHEN pr IS NOT NULL THEN sum(CASE WHEN pr IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY sheet ORDER BY o_orderkey) END AS pn FROM o)
SELECT sheet, count(*) AS row_count, 2 AS column_count, 'o_orderstatus,o_orderpriority' AS names,
  'string,' || CASE WHEN count(pr) = 0 THEN 'unknown' ELSE 'string' END AS types,
  concat_ws(',', string_agg(o_orderstatus, ',' ORDER BY o_orderkey) FILTER (WHERE rn <= 3),
    string_agg(pr, ',' ORDER BY o_orderkey) FILTER (WHERE pn <= 3)) AS samples,
  string_agg(coalesce(pr, '-'), ',' ORDER BY o_orderkey) FILTER (WHERE rn <= 5) AS rows
FROM r GROUP BY sheet"""


@query("target_profiles", f"""SELECT {_PROFILE_KEYS} AS session_id, 'target_names' AS key,
  '["o_orderstatus","o_orderpriority"]' AS value FROM orders GROUP BY ALL
UNION ALL SELECT {_PROFILE_KEYS}, 'target_rows', CAST(count(*) AS VARCHAR) FROM orders GROUP BY ALL""")
def target_profiles(spark, sf):
    """P10: two stores a session, the later one wins; the rows kept are counted here."""
    new = _order_profiles(spark, sf)
    old = new.withColumn("profile", F.lit('{"columns":[{"name":"x"}],"sample_data":[],"row_count":0}'))
    writes = prof.stored_profiles(old, "sheet", 1).unionByName(prof.stored_profiles(new, "sheet", 2))
    kept = logs.session_attrs(writes, new.select(F.col("sheet").alias("session_id")))
    n = F.get_json_object("value", "$.row_count")
    return kept.where("key <> 'target_rows'").select(
        "session_id", F.when(F.col("key") == "target_profile", "target_rows").otherwise(F.col("key")).alias("key"),
        F.when(F.col("key") == "target_profile", n).otherwise(F.col("value")).alias("value"))


@query("schema_compare", """
WITH s(position, name, type) AS (VALUES (0, 'c_custkey', 'integer'), (1, 'c_name', 'string'),
  (2, 'c_nationkey', 'integer'), (3, 'c_acctbal', 'float'), (4, 'c_mktsegment', 'string')),
t(position, name, type) AS (VALUES (0, 's_suppkey', 'integer'), (1, 's_name', 'string'),
  (2, 's_nationkey', 'integer'), (3, 's_acctbal', 'float')),
sk AS (SELECT regexp_replace(regexp_replace(lower(name), '^[a-z]_', ''), '[^a-z0-9]', '', 'g') AS key, * FROM s),
tk AS (SELECT regexp_replace(regexp_replace(lower(name), '^[a-z]_', ''), '[^a-z0-9]', '', 'g') AS key, * FROM t)
SELECT coalesce(sk.key, tk.key) AS key, sk.name AS source_name, sk.type AS source_type,
  sk.position AS source_position, tk.name AS target_name, tk.type AS target_type, tk.position AS target_position,
  CASE WHEN sk.name IS NULL THEN 'missing' WHEN tk.name IS NULL THEN 'extra'
       WHEN sk.type = tk.type THEN 'matched' ELSE 'type_changed' END AS status
FROM sk FULL OUTER JOIN tk ON sk.key = tk.key""")
def schema_compare(spark, sf):
    from gridframe.sheet import Sheet
    c = Sheet.from_df(fx.table(spark, sf, "customer"), ["c_custkey"])
    s = Sheet.from_df(fx.table(spark, sf, "supplier"), ["s_suppkey"])
    return prof.schema_compare(prof.column_types_df(c), prof.column_types_df(s))


# -- E6/E7, P8, P9 -------------------------------------------------------------------------
from gridframe.operators import conform as cf  # noqa: E402


_TEXT_SHEET_SQL = "row_number() OVER (ORDER BY c_custkey) - 1 AS _row, CAST(c_custkey AS VARCHAR) AS {0}, c_name AS {1}, CAST(c_nationkey AS VARCHAR) AS {2} FROM customer"


@query("header_promote", "SELECT " + _TEXT_SHEET_SQL.format(*fx.CUSTOMER_TEXT))
def header_promote(spark, sf):
    s = cf.promote_header(fx.customer_text(spark, sf))
    return cf.override_header(s, ["too", "few"]).df


@query("header_override", "SELECT " + _TEXT_SHEET_SQL.format('"key.1"', '"the name"', "nation"))
def header_override(spark, sf):
    """E7, accepted: as many names as columns."""
    s = cf.promote_header(fx.customer_text(spark, sf))
    return cf.override_header(s, ["key.1", "the name", "nation"]).df


_CUST_TARGET = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                ("c_acctbal", "float"), ("c_mktsegment", "string")]


def _supplier_sheet(spark, sf):
    from gridframe.sheet import Sheet
    return Sheet.from_df(fx.table(spark, sf, "supplier"), [F.col("s_acctbal").desc(), F.col("s_suppkey")])


@query("conform", """SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS _row,
  CAST(s_suppkey AS BIGINT) AS c_custkey, s_name AS c_name, CAST(s_nationkey AS BIGINT) AS c_nationkey,
  CAST(s_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier""")
def conform_q(spark, sf):
    return cf.conform(_supplier_sheet(spark, sf), _CUST_TARGET, {"c_custkey": "s_suppkey"})[0].df


@query("conform_failures", """SELECT CAST(0 AS BIGINT) AS c_custkey, CAST(0 AS BIGINT) AS c_name,
  CAST(0 AS BIGINT) AS c_nationkey, CAST(0 AS BIGINT) AS c_acctbal, CAST(0 AS BIGINT) AS c_mktsegment
  FROM (SELECT count(*) FROM supplier)""")
def conform_failures(spark, sf):
    return cf.conform(_supplier_sheet(spark, sf), _CUST_TARGET, {"c_custkey": "s_suppkey"})[1]


_CAST_TARGET = [("c_custkey", "integer"), ("c_name", "integer"), ("c_mktsegment", "datetime"), ("c_acctbal", "float"),
                ("c_phone", "string")]


@query("conform_casts", """SELECT CAST(0 AS BIGINT) AS c_custkey, count(c_name) AS c_name, count(c_mktsegment) AS c_mktsegment,
  CAST(0 AS BIGINT) AS c_acctbal, CAST(0 AS BIGINT) AS c_phone FROM customer""")
def conform_casts(spark, sf):
    """P8 with values that do not cast: names as integers, segments as dates."""
    return cf.conform(fx.customer_sheet(spark, sf), _CAST_TARGET)[1]


_STACK_CTE = f"""
WITH s AS ({fx.TEXT_STACK_SQL}),
b AS (SELECT *, CAST(c0 IS NULL AND c1 IS NULL AND c2 IS NULL AS INTEGER) AS blank FROM s),
t AS (SELECT *, sum(blank) OVER (ORDER BY _row) AS table_id FROM b),
d AS (SELECT * FROM t WHERE blank = 0),
h AS (SELECT table_id, arg_min([c0, c1, c2], _row) AS header, min(_row) AS at FROM d GROUP BY table_id),
k AS (SELECT *, array_to_string(list_transform(header,
        lambda x: coalesce(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), '')), '|') AS hk FROM h),
sim AS (SELECT hk, min(table_id) AS similar_to FROM k GROUP BY hk),
o AS (SELECT d.table_id, sim.similar_to, k.header, d._row - k.at - 1 AS _row, d.c0, d.c1, d.c2
  FROM d JOIN k USING (table_id) JOIN sim USING (hk) WHERE d._row > k.at)"""


@query("stacked_split", _STACK_CTE + " SELECT * FROM o")
def stacked_split(spark, sf):
    return cf.split_stacked(fx.text_stack(spark, sf))


@query("stacked_union", _STACK_CTE + """ SELECT table_id, _row, CAST(c0 AS BIGINT) AS o_orderkey,
  CAST(c2 AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_comment FROM o WHERE similar_to = 0""")
def stacked_union(spark, sf):
    """P9, second half: tables with the first table's header, conformed and united."""
    target = [("o_orderkey", "integer"), ("o_totalprice", "float"), ("o_comment", "string")]
    return cf.union_similar(cf.split_stacked(fx.text_stack(spark, sf)), ["c0", "c1", "c2"], 0, target)


from gridframe.operators import match as mt  # noqa: E402
from gridframe.operators import steps  # noqa: E402

_VARIED_TARGET = [("o_orderkey", "integer"), ("o_totalprice", "float"), ("o_orderpriority", "string"), ("o_orderstatus", "string")]
_VARIED_CELLS = ["c0", "c1", "c2", "c3"]


@query("stacked_union_renamed", f"""
SELECT part AS table_id, row_number() OVER (PARTITION BY part ORDER BY o_orderkey) - 1 AS _row,
  CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
  CASE WHEN part % 4 <> 3 THEN o_orderpriority END AS o_orderpriority, o_orderstatus
FROM (SELECT *, {fx.VARIED_PART_SQL} AS part FROM orders)""")
def stacked_union_renamed(spark, sf):
    """P9 with renamed, reordered and missing columns: the tables like the first one united."""
    return mt.unite_matched(cf.split_stacked(fx.varied_stack(spark, sf)), _VARIED_CELLS, 0, _VARIED_TARGET)


def _varied_pairs_sql():
    rows = []
    for layout, (places, header) in enumerate(fx.VARIED_LAYOUTS):
        for at, name in enumerate(fx.VARIED_LAYOUTS[0][1]):
            i = places.index(at) if at in places else None
            rows.append(f"({layout}, '{name}', " + ("NULL, NULL)" if i is None else f"'{header[i]}', {i})"))
    return ", ".join(rows)


@query("stacked_matches", f"""
WITH m(layout, lead_name, name, position) AS (VALUES {_varied_pairs_sql()}),
p AS (SELECT DISTINCT {fx.VARIED_PART_SQL} AS part FROM orders)
SELECT CAST(part AS BIGINT) AS table_id, TRUE AS similar, lead_name, name, CAST(position AS INTEGER) AS position
  FROM p JOIN m ON part % 4 = layout
UNION ALL SELECT DISTINCT {fx.VARIED_TABLES} + c_custkey % {fx.CUSTOMER_TABLES}, FALSE, NULL, NULL, NULL FROM customer""")
def stacked_matches(spark, sf):
    """Which column of each table stands for which column of the first one."""
    m = mt.match_tables(cf.split_stacked(fx.varied_stack(spark, sf)), _VARIED_CELLS, 0)
    some = m.where("similar").select("table_id", "similar", F.inline("pairs"))
    rest = m.where("not similar").select("table_id", "similar", *[
        F.lit(None).cast(t).alias(n) for n, t in (("lead_name", "string"), ("name", "string"), ("position", "int"))])
    return some.select(*rest.columns).unionByName(rest)


@query("schema_compare_matched", """
SELECT * FROM (VALUES ('c_custkey', 's_suppkey', 'renamed'), ('c_name', 's_name', 'matched'),
  ('c_nationkey', 's_nationkey', 'matched'), ('c_acctbal', 's_acctbal', 'matched'), ('c_mktsegment', NULL, 'missing'))
  t(target_name, source_name, status)""")
def schema_compare_matched(spark, sf):
    """P7 by name and content: suppliers against customers."""
    return mt.compare_matched(_supplier_sheet(spark, sf), fx.customer_sheet(spark, sf)).drop("score")


@query("conform_matched", """SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS _row,
  CAST(s_suppkey AS BIGINT) AS c_custkey, s_name AS c_name, CAST(s_nationkey AS BIGINT) AS c_nationkey,
  CAST(s_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier""")
def conform_matched(spark, sf):
    """P8 with the mapping found from names and content."""
    source = _supplier_sheet(spark, sf)
    return cf.conform(source, _CUST_TARGET, mt.column_mapping(source, fx.customer_sheet(spark, sf)))[0].df


@query("dotted_names", """
WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row, c_custkey, c_nationkey, c_name FROM customer),
k AS (SELECT * FROM s WHERE _row % 5 <> 2)
SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, c_custkey AS a, c_nationkey AS "a.1", c_name AS "b`c",
  c_custkey + c_nationkey AS "sum.a" FROM k""")
def dotted_names(spark, sf):
    """Names as a CSV with a repeated header has them, through a read, a blank-row
    drop, a step, a sum, a profile and a split."""
    from gridframe.operators.steps import run_step
    from gridframe.sheet import Sheet
    c = fx.table(spark, sf, "customer")
    s = Sheet.from_df(c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("a.1"), F.col("c_name").alias("b`c")), ["a"])
    holes = Sheet(s.df.select("_row", *[F.when(F.col("_row") % 5 != 2, F.col(q)).alias(n) for q, n in (
        ("a", "a"), ("`a.1`", "a.1"), ("`b``c`", "b`c"))]))
    path = csvsrc.write_csv_sheet(Sheet(holes.df.toDF("_row", "a", "a.2", "b`c")), scratch_path(spark, "dotted"))
    read = csvsrc.read_csv_sheet(spark, path)
    named = Sheet(read.df.toDF("_row", "a", "a.1", "b`c"), read.n_rows)
    kept = run_step(clean.drop_blank_rows(named), lambda d: d.where(F.col("`a.1`").isNotNull() | F.col("a").isNotNull())).sheet
    out = ed.derived_sum(kept, "a", "a.1", "sum.a")
    if prof.profile_document(out).count() != 1 or cf.split_stacked(named).columns[-3:] != ["a", "a.1", "b`c"]:
        raise ValueError("names changed")
    return out.df


# -- H1-H5 history, U1-U3 steps ------------------------------------------------------------
from gridframe.operators import history as hist  # noqa: E402

_ACTIONS = ("CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'commit' END")


@query("history_replay", f"""
WITH RECURSIVE a AS (SELECT user_id AS sheet_id, event_id AS seq, {_ACTIONS} AS action,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT sheet_id, seq, action, n, CASE WHEN action = 'commit' THEN 0 ELSE -1 END AS pos,
        CASE WHEN action = 'commit' THEN 1 ELSE 0 END AS len FROM a WHERE n = 1
  UNION ALL
  SELECT a.sheet_id, a.seq, a.action, a.n,
    CASE WHEN a.action = 'commit' THEN r.pos + 1 WHEN a.action = 'undo' AND r.pos > 0 THEN r.pos - 1
         WHEN a.action = 'redo' AND r.pos < r.len - 1 THEN r.pos + 1 ELSE r.pos END,
    CASE WHEN a.action = 'commit' THEN r.pos + 2 ELSE r.len END
  FROM r JOIN a ON a.sheet_id = r.sheet_id AND a.n = r.n + 1)
SELECT sheet_id, seq, action, CAST(pos AS BIGINT) AS pos, CAST(len AS BIGINT) AS len,
  pos > 0 AS can_undo, pos < len - 1 AS can_redo,
  last_value(CASE WHEN action = 'commit' THEN seq END IGNORE NULLS) OVER
    (PARTITION BY sheet_id, pos ORDER BY seq ROWS UNBOUNDED PRECEDING) AS visible_seq FROM r""")
def history_replay(spark, sf):
    ev = fx.table(spark, sf, "events")
    action = (F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo")
              .otherwise("commit"))
    log = ev.select(F.col("user_id").alias("sheet_id"), F.col("event_id").alias("seq"), action.alias("action"))
    return hist.replay(log)


@query("version_read", batch_sql(fx.CUSTOMER_SHEET_SQL, _CUST_COLS, set(), [
    {"seq": 1, "type": "row", "action": "remove", "index": 3, "amount": 100}], None, _CUST_N))
def version_read(spark, sf):
    v0 = fx.customer_sheet(spark, sf)
    v1 = ed.remove_rows(v0, 3, 100)
    path = hist.write_versions([v0, v1])
    return hist.read_version(spark, path, 1).df


_CHAIN = 12


@query("version_chain", f"""SELECT _row, c_custkey, c_name, c_nationkey,
  c_acctbal + 10 * len(list_filter(range(1, {_CHAIN} - 2), lambda v: (_row + v) % 40 = 0)) AS c_acctbal,
  CASE WHEN _row % 50 < {_CHAIN} - 2 AND _row % 50 > 0 THEN 'v' || (_row % 50) ELSE c_mktsegment END AS c_mktsegment
  FROM ({fx.CUSTOMER_SHEET_SQL}) s WHERE _row < ({_CUST_N}) - 3 * ({_CHAIN} - 3)""")
def version_chain(spark, sf):
    """H4 through a chain of versions, each a few changed rows and three rows
    less, read two undos before the last one."""
    log = hist.VersionLog(spark)
    s = fx.customer_sheet(spark, sf)
    for v in range(_CHAIN):
        log.commit(s)
        r = F.col("_row")
        kept = s.n_rows - 3
        changed = s.df.where(r < kept).withColumns({
            "c_acctbal": F.when((r + v + 1) % 40 == 0, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")),
            "c_mktsegment": F.when(r % 50 == v + 1, F.lit(f"v{v + 1}")).otherwise(F.col("c_mktsegment"))})
        s = type(s)(changed, kept)
    log.undo()
    log.undo()
    return log.current().df


@query("transform_step", f"""SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, o_orderkey, o_totalprice,
  o_totalprice * 2 AS double_price FROM ({fx.ORDERS_SHEET_SQL}) s WHERE o_orderstatus = 'F'""")
def transform_step(spark, sf):
    s = fx.orders_sheet(spark, sf)
    return s.transform(lambda d: d.where(F.col("o_orderstatus") == "F").select(
        "_row", "o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("double_price"))).df


_STEP_UNION = " UNION ALL ".join(
    f"SELECT 2 AS step, b._row AS row, CAST({i} AS BIGINT) AS col, b.c_custkey, b.c_acctbal FROM a JOIN b USING (_row) "
    f"WHERE a.{c} IS DISTINCT FROM b.{c}" for i, c in enumerate(n for n, _ in _CUST_TARGET))


@query("step_commits", f"""
WITH s AS ({fx.CUSTOMER_SHEET_SQL}),
a AS (SELECT * REPLACE (CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM s),
b AS (SELECT * REPLACE (row_number() OVER (ORDER BY _row) - 1 AS _row) FROM a WHERE c_custkey % 4 <> 0)
SELECT 1 AS step, _row AS row, CAST(3 AS BIGINT) AS col, c_custkey, c_acctbal FROM a WHERE c_nationkey % 5 = 0
UNION ALL {_STEP_UNION}""")
def step_commits(spark, sf):
    """U1 whole: the cells that each of two steps touched, with the row as the version
    that the step committed holds it; the first version is reached by an undo."""
    log, sheet = hist.VersionLog(spark), fx.customer_sheet(spark, sf)
    log.commit(sheet)
    raised = F.when(F.col("c_nationkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    one = steps.run_step(sheet, lambda d: d.withColumn("c_acctbal", raised), log)
    two = steps.run_step(one.sheet, lambda d: d.where("c_custkey % 4 <> 0"), log)
    second, first = log.current(), log.undo()
    found = [r.touched.join(v.df, r.touched["row"] == v.df["_row"]).select(
        F.lit(i).alias("step"), "row", "col", "c_custkey", "c_acctbal") for i, r, v in ((1, one, first), (2, two, second))]
    return found[0].unionByName(found[1])


@query("sql_step", f"""SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, o_orderkey, o_totalprice
  FROM ({fx.ORDERS_SHEET_SQL}) s WHERE o_orderpriority = '1-URGENT'""")
def sql_step(spark, sf):
    s = fx.orders_sheet(spark, sf)
    return s.sql("SELECT _row, o_orderkey, o_totalprice FROM sheet WHERE o_orderpriority = '1-URGENT'").df


def _price_band(batches):
    for b in batches:
        b = b[["_row", "o_orderkey", "o_totalprice"]].copy()
        b["price_band"] = (b["o_totalprice"] // 100000).astype("int64")
        yield b


@query("rowblock_step", f"""SELECT _row, o_orderkey, o_totalprice, CAST(floor(o_totalprice / 100000) AS BIGINT)
  AS price_band FROM ({fx.ORDERS_SHEET_SQL}) s""")
def rowblock_step(spark, sf):
    s = fx.orders_sheet(spark, sf)
    return s.map_blocks(_price_band, "_row bigint, o_orderkey bigint, o_totalprice double, price_band bigint").df


# -- L1-L10 logs -------------------------------------------------------------------------------
from gridframe.operators import logs  # noqa: E402


def _prompt_log(spark, sf):
    c = fx.table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))


@query("prompt_append", """SELECT conv_id AS session_id, turn AS seq, replace(text, chr(10), ' ') AS prompt
  FROM conversations WHERE role = 'user'""")
def prompt_append(spark, sf):
    return logs.prompt_append(_prompt_log(spark, sf))


@query("prompt_nth", """SELECT session_id, seq, prompt FROM (SELECT conv_id AS session_id, turn AS seq,
  text AS prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations
  WHERE role = 'user' AND trim(text) <> '') WHERE rn = 2""")
def prompt_nth(spark, sf):
    return logs.prompt_nth(_prompt_log(spark, sf), 1)


# Whole prompts, with real repeats: conversations, and documents with their exact copies.
# Padding of several kinds of white space and line breaks inside are added by id.
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_PAD_SQL = """CASE {k} % 4 WHEN 0 THEN {t} WHEN 1 THEN chr(9) || {t} || chr(10)
  WHEN 2 THEN chr(160) || {t} || chr(13) || chr(10) ELSE ' ' || {t} END"""


def _strip_sql(t):
    return f"trim({t}, {_WS})"


_USER_SQL = f"""SELECT conv_id * 1000 + turn AS seq, {_PAD_SQL.format(k='conv_id', t='text')} AS prompt
  FROM conversations WHERE role = 'user'"""
_SAVES_SQL = f"""{_USER_SQL} UNION ALL SELECT -1 - doc_id, {_PAD_SQL.format(k='doc_id', t='text')} FROM documents
  UNION ALL SELECT -1000000000 - turn, chr(10) || chr(9) FROM conversations WHERE conv_id = 0"""
_LIB_SQL = f"""SELECT conv_id * 1000 + turn AS seq, {_PAD_SQL.format(k='(conv_id + turn)', t='text')} AS prompt
  FROM conversations WHERE role = 'assistant' UNION ALL
  SELECT 10000000000 + doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' /' || (doc_id % 3) END FROM documents"""


def _padded(key, text="text"):
    t = F.col(text)
    nb = F.lit(" ")
    return (F.when(key % 4 == 0, t).when(key % 4 == 1, F.concat(F.lit("\t"), t, F.lit("\n")))
            .when(key % 4 == 2, F.concat(nb, t, F.lit("\r\n"))).otherwise(F.concat(F.lit(" "), t)))


def _saves(spark, sf):
    c, d = fx.table(spark, sf, "conversations"), fx.table(spark, sf, "documents")
    blank = c.where("conv_id = 0").select((-1000000000 - F.col("turn")).alias("seq"), F.lit("\n\t").alias("prompt"))
    return (c.where("role = 'user'")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), _padded(F.col("conv_id")).alias("prompt"))
            .unionByName(d.select((-1 - F.col("doc_id")).alias("seq"), _padded(F.col("doc_id")).alias("prompt")))
            .unionByName(blank))


def _marked_text():
    """Texts of all documents; two thirds carry a mark, so that saves of them are new to the library."""
    rest = F.col("doc_id") % 3
    return F.when(rest == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" /"), rest.cast("string")))


def _library(spark, sf):
    c, d = fx.table(spark, sf, "conversations"), fx.table(spark, sf, "documents")
    key = F.col("conv_id") + F.col("turn")
    return (c.where("role = 'assistant'")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), _padded(key).alias("prompt"))
            .unionByName(d.select((10000000000 + F.col("doc_id")).alias("seq"), _marked_text().alias("prompt"))))


def _pre(spark):
    return spark.createDataFrame([(-4 + i, p) for i, p in enumerate(logs.PREDEFINED_PROMPTS)], "seq bigint, prompt string")


_PRE_SQL = ("SELECT * FROM (VALUES (-4, 'Remove row'), (-3, 'Remove column'), (-2, 'Add row'), "
            "(-1, 'Add column')) t(seq, prompt)")


@query("library_add", f"""
WITH lib AS ({_PRE_SQL} UNION ALL {_LIB_SQL}),
s AS (SELECT seq, replace({_strip_sql('prompt')}, chr(10), ' ') AS prompt FROM ({_SAVES_SQL}))
SELECT min(seq) AS seq, prompt FROM s WHERE prompt <> ''
  AND prompt NOT IN (SELECT {_strip_sql('prompt')} FROM lib) GROUP BY prompt""")
def library_add(spark, sf):
    return logs.library_add(_pre(spark).unionByName(_library(spark, sf)), _saves(spark, sf))


@query("library_delete", f"""
WITH lib AS (SELECT seq, {_strip_sql('prompt')} AS prompt FROM ({_LIB_SQL})),
req AS (SELECT DISTINCT {_strip_sql('prompt')} AS prompt FROM ({_SAVES_SQL}) UNION SELECT 'Add row'),
ok AS (SELECT prompt FROM req WHERE prompt <> '' AND prompt NOT IN ('Remove row', 'Remove column', 'Add row', 'Add column')),
l AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY seq) AS rn FROM lib WHERE prompt <> '')
SELECT seq, prompt FROM l WHERE NOT (rn = 1 AND prompt IN (SELECT prompt FROM ok))""")
def library_delete(spark, sf):
    req = _saves(spark, sf).select("prompt").unionByName(spark.createDataFrame([("Add row",)], "prompt string"))
    return logs.library_delete(_library(spark, sf), req)


@query("library_list", f"""
{_PRE_SQL} UNION ALL SELECT seq, {_strip_sql('prompt')} FROM ({_LIB_SQL})
WHERE {_strip_sql('prompt')} <> ''
  AND {_strip_sql('prompt')} NOT IN ('Remove row', 'Remove column', 'Add row', 'Add column')""")
def library_list(spark, sf):
    return logs.library_list(_library(spark, sf))


@query("session_attrs", """SELECT user_id AS session_id, event_type AS key,
  arg_max(value, event_id) AS value FROM events
  WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) GROUP BY user_id, event_type""")
def session_attrs(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
                                              F.col("event_type").alias("key"), "value")
    sessions = fx.table(spark, sf, "customer").where(F.col("c_custkey") % 10 != 3).select(
        F.col("c_custkey").alias("session_id"))
    return logs.session_attrs(ev, sessions)


_EXTRA_ACCESSES_SQL = ("SELECT * FROM (VALUES (-1, TIMESTAMP '2000-01-01 00:00:00'), (-1, TIMESTAMP '2000-01-01 01:00:00'), "
                       "(-1, TIMESTAMP '2000-01-01 02:00:01')) t(session_id, ts)")


def _accesses(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts")
    extra = spark.createDataFrame([(-1, "2000-01-01 00:00:00"), (-1, "2000-01-01 01:00:00"),
                                   (-1, "2000-01-01 02:00:01")], "session_id bigint, ts string")
    return ev.unionByName(extra.select("session_id", F.col("ts").cast("timestamp_ntz").alias("ts")))


@query("sessionize", f"""
WITH a AS (SELECT user_id AS session_id, ts FROM events UNION ALL {_EXTRA_ACCESSES_SQL}),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
  THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session_id, min(ts) AS session_start, max(ts) AS last_access, count(*) AS accesses
FROM n GROUP BY session_id, k""")
def sessionize(spark, sf):
    return logs.sessionize(_accesses(spark, sf))


@query("session_sweep", f"""
WITH a AS (SELECT user_id AS session_id, ts FROM events UNION ALL {_EXTRA_ACCESSES_SQL}),
l AS (SELECT session_id, max(ts) AS last_access FROM a GROUP BY session_id),
t AS (SELECT max(ts) AS t_at FROM events)
SELECT session_id, last_access, CAST((epoch_us(t_at) - epoch_us(last_access)) // 1000000 AS BIGINT) AS idle_s
FROM l, t WHERE epoch_us(t_at) - epoch_us(last_access) > 3600000000""")
def session_sweep(spark, sf):
    at = fx.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return logs.session_sweep(_accesses(spark, sf), F.lit(at).cast("timestamp_ntz"))


@query("retention", f"""
WITH l AS ({fx.FILE_LISTING_SQL}),
p(class, max_age_h, exempt, name_rule) AS (VALUES ('upload', 24, ['.gitkeep'], NULL),
  ('download', 24, [], NULL), ('json', 72, ['manifest.json'], NULL), ('script', 24, [], '^script_.*\\.py$'),
  ('temp', NULL, ['.gitkeep', 'prompts.txt'], NULL)),
j AS (SELECT l.*, p.max_age_h, p.exempt, p.name_rule, regexp_extract(path, '([^/]*)$', 1) AS name,
  epoch(TIMESTAMP '2025-01-01 18:00:00') - epoch(modified) AS age_s FROM l JOIN p USING (class))
SELECT path, class, CAST(age_s AS BIGINT) AS age_s FROM j
WHERE (max_age_h IS NULL OR age_s > max_age_h * 3600) AND NOT list_contains(exempt, name)
  AND (name_rule IS NULL OR regexp_matches(name, name_rule))""")
def retention(spark, sf):
    return logs.retention(fx.file_listing(spark, sf), F.lit("2025-01-01 18:00:00").cast("timestamp_ntz"))


@query("file_intake", f"""
WITH l AS ({fx.FILE_LISTING_SQL}), e AS (SELECT path, length, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension FROM l)
SELECT path, length, extension,
  extension IN ('xlsx', 'xls', 'csv') AND length <= 16777216 AS accepted,
  CASE WHEN extension NOT IN ('xlsx', 'xls', 'csv') THEN 'unsupported format'
       WHEN length > 16777216 THEN 'too large' END AS reason,
  CASE WHEN extension IN ('xlsx', 'xls', 'csv') AND length <= 16777216 THEN
    CASE WHEN extension IN ('xlsx', 'xls') THEN 'excel' ELSE 'csv' END END AS kind FROM e""")
def file_intake(spark, sf):
    return logs.file_intake(fx.file_listing(spark, sf))


_FENCED = "(turn // 2) % 2 = 0"


def _responses(spark, sf):
    c = fx.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    fenced = F.floor(F.col("turn") / 2) % 2 == 0
    resp = (F.when(fenced & (F.col("conv_id") % 50 == 0), F.lit("```\n```"))
            .when(fenced, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```")))
            .otherwise(F.col("text")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), resp.alias("response"))


@query("code_block", f"""
WITH r AS (SELECT conv_id * 1000 + turn AS id,
  CASE WHEN {_FENCED} AND conv_id % 50 = 0 THEN '```' || chr(10) || '```'
       WHEN {_FENCED} THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END AS response
  FROM conversations WHERE role = 'assistant')
SELECT id, regexp_replace(CASE WHEN regexp_matches(response, '```(?:python)?\\s*([\\s\\S]*?)\\s*```')
  THEN regexp_extract(response, '```(?:python)?\\s*([\\s\\S]*?)\\s*```', 1) ELSE response END,
  '^\\s+|\\s+$', '', 'g') AS code FROM r""")
def code_block_q(spark, sf):
    return logs.code_blocks(_responses(spark, sf))


# -- A4-A7 selections, A9/A10 tags, A11/A12 listing ---------------------------------------------
from gridframe.functions import selection as S  # noqa: E402
from gridframe.functions import tags as T  # noqa: E402


def _sel_parts():
    a, b = F.col("o_custkey") % 30, F.col("o_orderkey") % 7
    x, y = F.col("o_orderkey") % 1000, F.col("o_custkey") % 500
    La, Lb = L.column_letters(a), L.column_letters(b)
    s = lambda v: (v + 1).cast("string")
    kind = F.col("o_orderkey") % 4
    return (F.when(kind == 0, F.concat(La, s(x), F.lit(":"), Lb, s(y)))
            .when(kind == 1, F.concat(La, F.lit(":"), Lb))
            .when(kind == 2, F.concat(s(x), F.lit(":"), s(y)))
            .otherwise(F.concat(F.lower(La), s(x), F.lit(", "), s(y))))


def _fmt_sql(r1, c1, r2, c2):
    Lc1, Lc2 = L.letters_sql(c1), L.letters_sql(c2)
    return (f"CASE WHEN {r1} = 0 AND {r2} = 999 THEN (CASE WHEN {c1} = {c2} THEN {Lc1} ELSE {Lc1} || ':' || {Lc2} END) "
            f"WHEN {c1} = 0 AND {c2} = 25 THEN (CASE WHEN {r1} = {r2} THEN CAST({r1} + 1 AS VARCHAR) "
            f"ELSE CAST({r1} + 1 AS VARCHAR) || ':' || CAST({r2} + 1 AS VARCHAR) END) "
            f"WHEN {r1} = {r2} AND {c1} = {c2} THEN {Lc1} || CAST({r1} + 1 AS VARCHAR) "
            f"ELSE {Lc1} || CAST({r1} + 1 AS VARCHAR) || ':' || {Lc2} || CAST({r2} + 1 AS VARCHAR) END")


@query("selection_roundtrip", f"""
WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_custkey % 30 AS a, o_orderkey % 7 AS b,
  o_orderkey % 1000 AS x, o_custkey % 500 AS y FROM orders),
r AS (SELECT o_orderkey, kind, a, b, x, y,
  CASE kind WHEN 0 THEN least(x, y) WHEN 1 THEN 0 WHEN 2 THEN least(x, y) ELSE x END AS r1,
  CASE kind WHEN 0 THEN least(a, b) WHEN 1 THEN least(a, b) WHEN 2 THEN 0 ELSE a END AS c1,
  CASE kind WHEN 0 THEN greatest(x, y) WHEN 1 THEN NULL WHEN 2 THEN greatest(x, y) ELSE x END AS r2,
  CASE kind WHEN 0 THEN greatest(a, b) WHEN 1 THEN greatest(a, b) WHEN 2 THEN NULL ELSE a END AS c2 FROM v),
f AS (SELECT *, coalesce(r2, 999) AS rr2, coalesce(c2, 25) AS cc2 FROM r)
SELECT o_orderkey,
  CASE kind WHEN 0 THEN {L.letters_sql('a')} || CAST(x + 1 AS VARCHAR) || ':' || {L.letters_sql('b')} || CAST(y + 1 AS VARCHAR)
    WHEN 1 THEN {L.letters_sql('a')} || ':' || {L.letters_sql('b')}
    WHEN 2 THEN CAST(x + 1 AS VARCHAR) || ':' || CAST(y + 1 AS VARCHAR)
    ELSE lower({L.letters_sql('a')}) || CAST(x + 1 AS VARCHAR) || ', ' || CAST(y + 1 AS VARCHAR) END AS sel,
  CASE WHEN kind = 3 THEN 2 ELSE 1 END AS n_rects, r1, c1, r2, c2,
  CASE WHEN kind = 3 THEN {_fmt_sql('r1', 'c1', 'rr2', 'cc2')} || ', ' || {_fmt_sql('y', '0', 'y', '25')}
       ELSE {_fmt_sql('r1', 'c1', 'rr2', 'cc2')} END AS formatted,
  cc2 < 26 AND rr2 < 1000 AS in_bounds
FROM f""")
def selection_roundtrip(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("sel", _sel_parts())
    rects = S.parse_selection(F.col("sel"))
    first = F.element_at(rects, 1)
    n, m = F.lit(1000).cast("bigint"), F.lit(26).cast("bigint")
    return o.select("o_orderkey", "sel", F.size(rects).alias("n_rects"), first.r1.alias("r1"), first.c1.alias("c1"),
                    first.r2.alias("r2"), first.c2.alias("c2"), S.format_selection(rects, n, m).alias("formatted"),
                    S.selection_in_bounds(rects, n, m).alias("in_bounds"))


@query("cell_ids", f"""
WITH v AS (SELECT o_orderkey, o_orderkey % 20000 AS r, o_custkey % 800 AS c, o_orderkey % 4 AS kind FROM orders),
t AS (SELECT *, CASE kind WHEN 0 THEN {L.letters_sql('c')} || CAST(r + 1 AS VARCHAR)
  WHEN 1 THEN ' ' || lower({L.letters_sql('c')}) || CAST(r + 1 AS VARCHAR) || ' '
  WHEN 2 THEN {L.letters_sql('c')} || '0' || CAST(r + 1 AS VARCHAR) ELSE {L.letters_sql('c')} END AS cell FROM v)
SELECT o_orderkey, cell, CASE WHEN kind < 2 THEN r END AS row, CASE WHEN kind < 2 THEN c END AS col FROM t""")
def cell_ids(spark, sf):
    """A4: well-formed and malformed cell ids."""
    r, c, kind = F.col("o_orderkey") % 20000, F.col("o_custkey") % 800, F.col("o_orderkey") % 4
    letters, number = L.column_letters(c), (r + 1).cast("string")
    cell = (F.when(kind == 0, F.concat(letters, number))
            .when(kind == 1, F.concat(F.lit(" "), F.lower(letters), number, F.lit(" ")))
            .when(kind == 2, F.concat(letters, F.lit("0"), number)).otherwise(letters))
    at = L.parse_cell_id(F.col("cell"))
    return fx.table(spark, sf, "orders").select("o_orderkey", cell.alias("cell")).select(
        "o_orderkey", "cell", at["row"].alias("row"), at["col"].alias("col"))


def _commands(spark, sf):
    o = fx.table(spark, sf, "orders")
    a, b = F.col("o_custkey") % 30, F.col("o_orderkey") % 7
    x, y = (F.col("o_orderkey") % 1000 + 1).cast("string"), (F.col("o_custkey") % 500 + 1).cast("string")
    La, Lb = L.column_letters(a), L.column_letters(b)
    cmd = F.concat(F.lit("sum #"), La, x, F.lit(":"), Lb, y, F.lit(", clear #"), Lb, F.lit(" and row #"), x,
                   F.lit(" or #"), La, F.lit(":#"), Lb)
    return o.select("o_orderkey", cmd.alias("command"))


_CMD_SQL = (f"'sum #' || {L.letters_sql('o_custkey % 30')} || CAST(o_orderkey % 1000 + 1 AS VARCHAR) || ':' || "
            f"{L.letters_sql('o_orderkey % 7')} || CAST(o_custkey % 500 + 1 AS VARCHAR) || ', clear #' || "
            f"{L.letters_sql('o_orderkey % 7')} || ' and row #' || CAST(o_orderkey % 1000 + 1 AS VARCHAR) || ' or #' || "
            f"{L.letters_sql('o_custkey % 30')} || ':#' || {L.letters_sql('o_orderkey % 7')}")


@query("tag_extract", f"""SELECT o_orderkey, array_to_string(regexp_extract_all({_CMD_SQL}, '#([A-Za-z0-9:]+)', 1), ', ')
  AS tags FROM orders""")
def tag_extract(spark, sf):
    return _commands(spark, sf).select("o_orderkey", T.extract_tags("command").alias("tags"))


@query("tag_rewrite", f"""SELECT o_orderkey, 'sum cells in range from ' || {L.letters_sql('o_custkey % 30')} ||
  CAST(o_orderkey % 1000 + 1 AS VARCHAR) || ' to ' || {L.letters_sql('o_orderkey % 7')} ||
  CAST(o_custkey % 500 + 1 AS VARCHAR) || ', clear column ' || {L.letters_sql('o_orderkey % 7')} ||
  ' and row row ' || CAST(o_orderkey % 1000 + 1 AS VARCHAR) || ' or ' ||
  CASE WHEN o_custkey % 30 >= 26 THEN 'column ' ELSE '#' END || {L.letters_sql('o_custkey % 30')} ||
  ':column ' || {L.letters_sql('o_orderkey % 7')} AS rewritten FROM orders""")
def tag_rewrite(spark, sf):
    return _commands(spark, sf).select("o_orderkey", T.rewrite_tags("command").alias("rewritten"))


def _preview_sql(v, numeric):
    empty = f"{v} IS NULL OR {v} = 0" if numeric else f"{v} IS NULL OR {v} = ''"
    t = f"CAST({v} AS VARCHAR)"
    return f"CASE WHEN {empty} THEN '' ELSE substr({t}, 1, 15) || CASE WHEN length({t}) > 15 THEN '...' ELSE '' END END"


def _listing_sql():
    types = {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}
    parts = ["SELECT 1 AS kind, CAST(-1 AS BIGINT) AS col, _row AS row, CAST(_row + 1 AS VARCHAR) AS text, "
             "'Row ' || CAST(_row + 1 AS VARCHAR) AS description FROM s"]
    for i, (c, numeric) in enumerate(types.items()):
        at = f"'{chr(65 + i)}' || CAST(_row + 1 AS VARCHAR)"
        p = _preview_sql(c, numeric)
        parts.append(f"SELECT 0, {i}, -1, '{chr(65 + i)}', 'Column {chr(65 + i)}'")
        parts.append(f"SELECT 2, {i}, _row, {at}, 'Cell ' || {at} || CASE WHEN {p} = '' THEN '' ELSE ': ' || {p} END FROM s")
    return f"WITH s AS ({fx.CUSTOMER_SHEET_SQL}) " + " UNION ALL ".join(parts)


_LISTING_SQL = _listing_sql()


@query("cell_listing", _LISTING_SQL)
def cell_listing(spark, sf):
    return address.cell_listing(fx.customer_sheet(spark, sf))


@query("cell_search", f"""SELECT * FROM ({_LISTING_SQL}) WHERE contains(lower(text), 'uildin')
  OR contains(lower(description), 'uildin') ORDER BY kind, col, row LIMIT 10""")
def cell_search(spark, sf):
    return address.cell_search(fx.customer_sheet(spark, sf), "uildin", 10)


_TERMS = """(SELECT DISTINCT CAST(event_id % 1000 AS VARCHAR) AS term FROM events
  UNION SELECT upper(substr(c_mktsegment, 2, 4)) FROM customer UNION SELECT n_name FROM nation)"""


@query("cell_search_batch", f"""SELECT term, rank, kind, col, row, text, description FROM (
  SELECT t.term, l.*, row_number() OVER (PARTITION BY t.term ORDER BY kind, col, row) AS rank
  FROM {_TERMS} t JOIN ({_LISTING_SQL}) l ON contains(lower(l.text), lower(t.term)) OR contains(lower(description), lower(t.term)))
WHERE rank <= 10""")
def cell_search_batch(spark, sf):
    """A12 for a table of terms, short ones too, through the gram index."""
    numbers = fx.table(spark, sf, "events").select((F.col("event_id") % 1000).cast("string").alias("term"))
    words = fx.table(spark, sf, "customer").select(F.upper(F.substring("c_mktsegment", 2, 4)).alias("term"))
    terms = numbers.union(words).union(fx.table(spark, sf, "nation").select("n_name"))
    return address.SearchIndex(fx.customer_sheet(spark, sf)).search(terms, 10)


# -- S1/S3-S5 sources and sinks, T1/T2 streams ----------------------------------------------------
from gridframe.session import scratch_path  # noqa: E402
from gridframe.sources import csv as csvsrc, records  # noqa: E402


@query("csv_roundtrip", f"""SELECT _row, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM ({fx.ORDERS_SHEET_SQL}) s""")
def csv_roundtrip(spark, sf):
    path = csvsrc.write_csv_sheet(fx.orders_sheet(spark, sf), scratch_path(spark, "csv"))
    return csvsrc.read_csv_sheet(spark, path).df


_QUOTED_CELL = """CASE o_orderkey % 6 WHEN 0 THEN 'say ""so"", ' || o_orderpriority WHEN 1 THEN 'C:\\dir\\'
  WHEN 2 THEN 'two' || chr(10) || 'lines, "' || o_orderpriority || '"' WHEN 3 THEN '"' || o_orderkey || '"'
  WHEN 4 THEN '5" pipe' || chr(13) || chr(10) ELSE o_orderpriority END"""


@query("csv_quotes", f"SELECT _row, o_orderkey, {_QUOTED_CELL} AS note, o_totalprice FROM ({fx.ORDERS_SHEET_SQL}) s")
def csv_quotes(spark, sf):
    """S1, S4 with quotes, backslashes and line breaks in cells."""
    from gridframe.sheet import Sheet
    s = fx.orders_sheet(spark, sf)
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    note = (F.when(k % 6 == 0, F.concat(F.lit('say ""so"", '), p)).when(k % 6 == 1, F.lit("C:\\dir\\"))
            .when(k % 6 == 2, F.concat(F.lit('two\nlines, "'), p, F.lit('"'))).when(k % 6 == 3, F.concat(F.lit('"'), k, F.lit('"')))
            .when(k % 6 == 4, F.lit('5" pipe\r\n')).otherwise(p))
    path = csvsrc.write_csv_sheet(Sheet(s.df.select("_row", "o_orderkey", note.alias("note"), "o_totalprice"), s.n_rows), scratch_path(spark, "csv"))
    return csvsrc.read_csv_sheet(spark, path).df


@query("workbook_folder", f"""
WITH o AS ({fx.ORDERS_SHEET_SQL}), b AS (SELECT *, _row // {fx.BOOK_ROWS} AS book FROM o)
SELECT 'book-' || book || '.xlsx' AS path, _row % {fx.BOOK_ROWS} AS _row, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  o_orderdate, o_orderpriority, count(*) OVER (PARTITION BY book) AS rows FROM b""")
def workbook_folder(spark, sf):
    """All sheets of many workbooks; the second sheet tells the rows of the first."""
    from gridframe.session import stored
    from gridframe.sources import workbook
    rows = stored(workbook.parse_workbooks(fx.order_books(spark, sf)), "workbooks")
    size = workbook.workbook_table(rows, "size").drop("_row")
    return workbook.workbook_table(rows, "orders").join(size, "path")


_REC = ("to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, "
        "'o_totalprice': o_totalprice, 'o_orderdate': coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ''), "
        "'o_orderpriority': o_orderpriority})")


@query("json_records_sink", f"SELECT _row, {_REC} AS record FROM ({fx.ORDERS_SHEET_SQL}) s")
def json_records_sink(spark, sf):
    return records.to_records(fx.orders_sheet(spark, sf))


@query("records_view", f"""SELECT _row, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority, 'orders.xlsx' AS filename,
  'o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority' AS headers,
  (SELECT count(*) FROM orders) AS n_rows FROM ({fx.ORDERS_SHEET_SQL}) s""")
def records_view(spark, sf):
    """S5 whole and S3: written with headers and metadata, and read again by them."""
    path = records.write_view(fx.orders_sheet(spark, sf), scratch_path(spark, "records-view"), "f1", "orders.xlsx")
    sheet, head = records.read_view(spark, path)
    meta = head["metadata"]
    return sheet.df.select("*", F.lit(meta["filename"]).alias("filename"), F.lit(" ".join(head["headers"])).alias("headers"),
                           F.lit(meta["rows"]).cast("bigint").alias("n_rows"))


@query("json_records", f"""SELECT _row, o_orderpriority, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CAST(NULL AS VARCHAR) AS o_comment, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
  FROM ({fx.ORDERS_SHEET_SQL}) s""")
def json_records(spark, sf):
    recs = records.to_records(fx.orders_sheet(spark, sf))
    return records.from_records(recs, ["o_orderpriority", "o_totalprice", "o_comment", "o_orderdate"]).df


@query("records_inferred", f"""SELECT _row, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN NULL
  ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 2 = 0 END AS late,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS mixed
  FROM ({fx.ORDERS_SHEET_SQL}) s""")
def records_inferred(spark, sf):
    """S3 without headers: keys that only some records have, and types from all."""
    s = fx.orders_sheet(spark, sf)
    k = F.col("o_orderkey")
    mixed = F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise('"x"')
    body = F.to_json(F.struct("o_orderkey", "o_totalprice", F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
                              F.when(k % 7 == 0, F.col("o_custkey") % 2 == 0).alias("late")))
    record = F.concat(F.expr("left(record, length(record) - 1)"), F.lit(',"mixed":'), F.col("m"), F.lit("}"))
    recs = s.df.select("_row", body.alias("record"), mixed.alias("m")).select("_row", record.alias("record"))
    return records.from_records(recs, None).df


def _edit_source(spark, sf):
    """Events as cell edits, in files that each hold seqs from the whole range."""
    ev = fx.table(spark, sf, "events")
    edits = ev.select(F.lit(0).cast("bigint").alias("sheet_id"), F.col("event_id").alias("seq"),
                      F.col("user_id").alias("row"), (F.col("event_id") % 8).alias("col"),
                      F.col("event_type").alias("value"))
    src = scratch_path(spark, "edits-src")
    edits.repartition(8, "seq").write.parquet(src)
    return src


@query("edit_stream", """SELECT CAST(0 AS BIGINT) AS sheet_id, user_id AS row, event_id % 8 AS col,
  max(event_id) AS seq, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id, event_id % 8""")
def edit_stream(spark, sf):
    from gridframe.streaming.edits import run_edit_stream
    src = _edit_source(spark, sf)
    return run_edit_stream(spark, src, scratch_path(spark, "cells"), scratch_path(spark, "edits-ckpt"), max_files=3)


@query("session_stream", f"""
WITH a AS (SELECT user_id AS session_id, ts FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000
  THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT session_id, min(ts) AS session_start, max(ts) AS last_access, count(*) AS accesses
      FROM n GROUP BY session_id, k)
SELECT * FROM s WHERE epoch_us(last_access) + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events)""")
def session_stream(spark, sf):
    from gridframe.streaming.sessions import run_session_stream
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "ts")
    src = scratch_path(spark, "access-src")
    ev.repartition(8, "session_id").write.parquet(src)  # no file is in time order
    return run_session_stream(spark, src, scratch_path(spark, "sessions-out"), scratch_path(spark, "sessions-ckpt"),
                              delay="0 seconds")

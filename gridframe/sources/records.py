"""JSON records (S3 source, S5 sink / view)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from gridframe.functions.text import qc
from gridframe.plans.ordinals import ROW, numbered
from gridframe.sheet import Sheet


def to_records(sheet: Sheet) -> DataFrame:
    """One JSON object per row, keys in column order; datetimes as
    'yyyy-MM-dd HH:mm:ss' with missing datetimes as '' and other missing
    values as null."""
    t = dict(sheet.df.dtypes)
    cols = []
    for c in sheet.columns:
        if t[c].startswith("timestamp") or t[c] == "date":
            cols.append(F.coalesce(F.date_format(qc(c), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c))
        elif t[c] in ("double", "float"):
            cols.append(F.when(~F.isnan(qc(c)), qc(c)).alias(c))
        else:
            cols.append(qc(c))
    return sheet.df.select(ROW, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


#: Records in one part file.
ROWS_PER_PART = 1 << 18


def view_lines(sheet: Sheet, file_id: str, original_filename: str) -> DataFrame:
    """S5 whole: (_row, line).  Row -1 is the head, a JSON object of file_id,
    original_filename, headers (in order) and metadata (filename, columns,
    rows); each further line is a row's record."""
    headers = F.lit(sheet.columns) if sheet.columns else F.array().cast("array<string>")
    head = sheet.df.agg(F.to_json(F.struct(
        F.lit(file_id).alias("file_id"), F.lit(original_filename).alias("original_filename"), headers.alias("headers"),
        F.struct(F.lit(original_filename).alias("filename"), headers.alias("columns"),
                 F.count(F.lit(1)).alias("rows")).alias("metadata"))).alias("line"))
    records = to_records(sheet).withColumnRenamed("record", "line") if sheet.columns else \
        sheet.df.select(ROW, F.lit("{}").alias("line"))
    return head.select(F.lit(-1).cast("bigint").alias(ROW), "line").unionByName(records)


def write_view(sheet: Sheet, path: str, file_id: str, original_filename: str) -> str:
    """``view_lines`` as a folder of text files: range-partitioned by ``_row``,
    so that the files in name order are the head and the records in order."""
    n = 1 + sheet.n_rows // ROWS_PER_PART
    (view_lines(sheet, file_id, original_filename).repartitionByRange(n, ROW).sortWithinPartitions(ROW)
     .select("line").write.mode("overwrite").text(path))
    return path


def read_view(spark: SparkSession, path: str) -> tuple[Sheet, dict]:
    """A folder of ``write_view``, or any such file, as (sheet, head).  The
    headers of the head select and order the columns, whose types come from all
    records; without headers the records' own keys do.  A folder without a head
    raises ``ValueError``, and so does one whose records are not as many as its
    metadata say, if they say: a part is missing."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"), F.col("value").alias("record")).where(F.trim("value") != "")
    rows, n = numbered(lines, [F.col("__f"), F.col("__b"), F.col("__m")])
    first = rows.where(F.col(ROW) == 0).first()
    head = json.loads(first["record"]) if first is not None else None
    if not isinstance(head, dict) or not {"headers", "metadata"} & set(head):
        raise ValueError(f"{path} does not begin with a head of headers and metadata")
    said = (head.get("metadata") or {}).get("rows")
    if said is not None and said != n - 1:
        raise ValueError(f"{path} has {n - 1} records, its metadata say {said}")
    body = rows.where(F.col(ROW) > 0).select((F.col(ROW) - 1).alias(ROW), "record")
    return Sheet(from_records(body, head.get("headers"), typed=True).df, n - 1), head


def record_columns(records: DataFrame, column: str = "record") -> list[tuple[str, str]]:
    """(key, type) of all keys of all records, in the order in which they
    appear first.  bigint, decimal(38,0) for larger integers, double, boolean
    or string where all values agree (integers among decimals are numbers);
    else the JSON text.  Two aggregates with a row for each key."""
    view = records.select(F.col(ROW).alias("at"), F.col(column).alias("record"))
    keys = view.select("at", F.posexplode(F.json_object_keys("record")).alias("pos", "key"))
    order = keys.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).orderBy("first").collect()
    values = view.sparkSession.sql(
        "SELECT key, schema_of_variant(value) AS kind FROM {view}, LATERAL variant_explode(try_parse_json(record))", view=view)
    integral = F.col("kind").rlike(r"^DECIMAL\(\d+,0\)$")
    kind = F.when(integral, "LARGE").otherwise(F.regexp_extract("kind", "^[A-Z]+", 0))
    kinds = {r["key"]: set(r["kinds"]) - {"VOID"}
             for r in values.groupBy("key").agg(F.collect_set(kind).alias("kinds")).collect()}

    def type_of(seen: set[str]) -> str:
        if seen and seen <= {"BIGINT"}:
            return "bigint"
        if seen and seen <= {"BIGINT", "LARGE"}:
            return "decimal(38,0)"
        if seen and seen <= {"BIGINT", "LARGE", "DECIMAL", "DOUBLE"}:
            return "double"
        return "boolean" if seen == {"BOOLEAN"} else "string"

    return [(r["key"], type_of(kinds.get(r["key"], set()))) for r in order]


def from_records(records: DataFrame, headers: list[str] | None, column: str = "record", typed: bool = False) -> Sheet:
    """S3: JSON object text per row (with ``_row``) -> sheet.  Headers select
    and order the columns, as text or, with ``typed``, by the types of all
    records: a missing key is null, extra keys are dropped.  Without headers all keys of all records become columns, with
    their types (see ``record_columns``)."""
    if headers is None:
        fields = record_columns(records, column)
    else:
        known = dict(record_columns(records, column)) if typed else {}
        fields = [(h, known.get(h, "string")) for h in headers]
    schema = StructType([StructField(h, _parse_datatype(t)) for h, t in fields])
    parsed = records.select(ROW, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("__r"))
    return Sheet(parsed.select(ROW, *[F.col("__r").getField(h).alias(h) for h, _ in fields]))


def _parse_datatype(name: str):
    return {"bigint": LongType(), "decimal(38,0)": DecimalType(38, 0), "double": DoubleType(),
            "boolean": BooleanType()}.get(name, StringType())

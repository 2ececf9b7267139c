"""A stream of cell edits folded into a current-cells table.

The table is split into buckets by (sheet, row): as many as its cells need, a
power of two that the manifest stores.  A micro-batch (``foreachBatch``)
dedupes on (sheet, seq), keeps the last writer per cell with ``max_by`` (a
partial aggregate, so hot cells are cheap) and merges into the buckets that it
touches; the others are not read or written.  Where the table has outgrown its
buckets, the batch writes all of it into more of them.  A cell keeps the value
with the larger seq, so a stale (late) edit never overwrites.

Each bucket has two slots.  A batch writes the slot that the version before it
does not use, and then a manifest that names each bucket's slot and cells;
manifests alternate between two slots as well.  A replayed batch finds the
manifest of the batch before it, so it writes the same slots again and is
harmless, and the table never holds more than two versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["sheet_id", "row", "col"]
CELLS_SCHEMA = "sheet_id bigint, row bigint, col bigint, seq bigint, value string"
MANIFEST_SCHEMA = "batch bigint, bucket int, slot int, cells bigint, buckets int, turn int"
#: Cells that a bucket is meant for, and the least and the most buckets.  The
#: most bounds the manifest, which the driver reads.
CELLS_PER_BUCKET = 250_000
MIN_BUCKETS, MAX_BUCKETS = 64, 1 << 16


def buckets_for(cells: int, now: int | None) -> int:
    """Buckets of a table of about ``cells`` cells that has ``now``.  They grow
    only when a table needs over twice as many, so it is rarely rewritten."""
    want = MIN_BUCKETS
    while want < MAX_BUCKETS and want * CELLS_PER_BUCKET < cells:
        want *= 2
    return want if now is None or want > 2 * now else now


def _manifest(spark: SparkSession, base: str, before: int | None) -> tuple[int | None, dict[int, tuple[int, int]]]:
    """(buckets, bucket -> (slot, cells)) of the latest version (before batch
    ``before``); at most ``MAX_BUCKETS`` entries, buckets without cells have none."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return None, {}
    held = rows.where(F.col("batch") == last).collect()
    return held[0]["buckets"], {r["bucket"]: (r["slot"], r["cells"]) for r in held}


def _stored(spark: SparkSession, base: str, slots: dict[int, int]) -> DataFrame:
    """Cells of the given buckets, with ``slot`` and ``bucket``: a partition
    filter, so only their files are read."""
    table = spark.read.schema(CELLS_SCHEMA + ", slot int, bucket int").parquet(f"{base}/cells")
    parts = F.lit(False)
    for slot in (0, 1):
        own = [b for b, s in slots.items() if s == slot]
        parts = parts | ((F.col("slot") == slot) & F.col("bucket").isin(own)) if own else parts
    return table.where(parts)


def current_cells(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    _, held = _manifest(spark, base, before)
    return _stored(spark, base, {b: s for b, (s, _) in held.items()}).drop("slot", "bucket") if held else None


def _last_writer(edits: DataFrame) -> DataFrame:
    last = edits.groupBy(*KEY).agg(F.max_by(F.struct("seq", "value"), "seq").alias("__w"))
    return last.select(*KEY, "__w.seq", "__w.value")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("sheet_id", "row"), F.lit(n)).cast("int").alias("bucket")


def merge_batch(batch: DataFrame, batch_id: int, base: str) -> None:
    spark = batch.sparkSession
    edits = _last_writer(batch.dropDuplicates(["sheet_id", "seq"])).persist()
    now, old = _manifest(spark, base, batch_id)
    n = buckets_for(sum(c for _, c in old.values()) + edits.count(), now)
    grown = now is not None and n > now
    touched = [r[0] for r in edits.select(_bucket(n)).distinct().collect()]  # at most MAX_BUCKETS
    read = {b: s for b, (s, _) in old.items() if grown or b in set(touched)}
    merged = _last_writer(_stored(spark, base, read).drop("slot", "bucket").unionByName(edits)) if read else edits
    if grown:
        # A multiple of the buckets before: each cell stays or moves to a new one.
        touched = [r[0] for r in merged.select(_bucket(n)).distinct().collect()]
    new = {} if grown else dict(old)
    if touched:
        slots = {b: 1 - old[b][0] if b in old else 0 for b in touched}
        slot_of = spark.createDataFrame(list(slots.items()), "bucket int, slot int")
        out = merged.withColumn("bucket", _bucket(n)).join(F.broadcast(slot_of), "bucket")  # at most MAX_BUCKETS rows
        (out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("slot", "bucket").parquet(f"{base}/cells"))
        cells = _stored(spark, base, slots).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # reads file footers only
        new |= {r["bucket"]: (slots[r["bucket"]], r["n"]) for r in cells.collect()}
    edits.unpersist()
    rows = [(batch_id, b, s, c, n, batch_id % 2) for b, (s, c) in new.items()]
    (spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(f"{base}/manifest"))


def run_edit_stream(spark: SparkSession, source_dir: str, base: str, checkpoint: str,
                    max_files: int | None = None) -> DataFrame:
    """Drain ``source_dir`` (parquet edits: sheet_id, seq, row, col, value)
    with ``availableNow`` and return the latest cells version.  ``max_files``
    bounds a batch; by default one batch takes the whole backlog."""
    reader = spark.readStream.schema("sheet_id bigint, seq bigint, row bigint, col bigint, value string")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    q = (reader.parquet(source_dir).writeStream.foreachBatch(lambda df, bid: merge_batch(df, bid, base))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    cells = current_cells(spark, base)
    return spark.createDataFrame([], CELLS_SCHEMA) if cells is None else cells

"""Accesses stream -> sessions that late accesses still correct.

Each micro-batch is sessionised on its own and written as partial sessions to a
folder of its batch id, which a repeated batch overwrites.  Partial sessions are
intervals: the sessions of all accesses are the unions of those that lie within
the timeout of one another, whatever batch brought them.  So an access that
comes late extends, starts or joins sessions, also closed ones, and the answer
is at any time that of a batch job over the accesses so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators.logs import SESSION_TIMEOUT_S, _micros, sessionize
from gridframe.plans.ordinals import ROW, numbered
from gridframe.plans.running import running_sum
from gridframe.session import cut_lineage

SCHEMA = "session_id bigint, session_start timestamp_ntz, last_access timestamp_ntz, accesses bigint"


def merge_sessions(partial: DataFrame, timeout_s: int = SESSION_TIMEOUT_S) -> DataFrame:
    """Sessions from partial ones (session_id, session_start, last_access, accesses).

    Starts count up and ends (the timeout after the last access) count down, in
    the order of user and time.  As each user's counts cancel out, one running
    sum over all users tells where no interval is open: a session starts there.
    The sums run in buckets of rows, so a user with most of the rows is split."""
    start, end = _micros(F.col("session_start")), _micros(F.col("last_access")) + timeout_s * 1_000_000
    marks = partial.select("*", F.explode(F.array(
        F.struct(start.alias("t"), F.lit(1).alias("step")), F.struct(end.alias("t"), F.lit(-1).alias("step")))).alias("__at"))
    # A start at the instant where another ends comes first: exactly the timeout apart is one session.
    rows, n = numbered(marks, [F.col("session_id"), F.col("__at.t"), F.col("__at.step").desc()])
    rows = running_sum(rows, ROW, F.col("__at.step"), "__open", n)
    rows = cut_lineage(rows.where("__at.step = 1 or __open = 0"))
    first = (F.col("__at.step") == 1) & (F.col("__open") == 1)
    rows = running_sum(rows, ROW, first.cast("int"), "__nth", n).where("__at.step = 1")
    merged = rows.groupBy("session_id", "__nth").agg(
        F.min("session_start").alias("session_start"), F.max("last_access").alias("last_access"), F.sum("accesses").alias("accesses"))
    return merged.drop("__nth")


def stored_sessions(spark: SparkSession, out_dir: str) -> DataFrame:
    """All sessions of the batches below ``out_dir``, open ones too."""
    partial = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(out_dir)
    return merge_sessions(partial)


def closed_sessions(spark: SparkSession, out_dir: str, delay: str) -> DataFrame:
    """The sessions whose timeout passed ``delay`` or more before the latest access."""
    sessions = cut_lineage(stored_sessions(spark, out_dir))
    latest = sessions.agg(F.max("last_access")).first()[0]
    over = F.col("last_access") + F.expr(f"interval {SESSION_TIMEOUT_S} seconds") + F.expr(f"interval {delay}")
    return sessions.where(over <= F.lit(latest).cast("timestamp_ntz"))


def run_session_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                       delay: str, max_files: int | None = None) -> DataFrame:
    """Drain ``source_dir`` (parquet accesses: session_id, ts) and return the
    closed sessions.  ``delay``: how long after its timeout a session counts as
    open still; an access that comes later corrects it nevertheless.  A backlog
    is drained in one batch unless ``max_files`` splits it.  Running again, or
    again after a failure, never returns less.  Accesses without time are left out."""
    reader = spark.readStream.schema("session_id bigint, ts timestamp_ntz")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def keep(batch: DataFrame, batch_id: int) -> None:
        sessionize(batch.where("ts is not null")).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    query = (reader.parquet(source_dir).writeStream.foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return closed_sessions(spark, out_dir, delay)

"""Session, prompt and file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions.text import code_block, strip
from gridframe.session import cut_lineage

# Fixed values of the spec: predefined prompts (never deletable), listed first.
PREDEFINED_PROMPTS = ["Remove row", "Remove column", "Add row", "Add column"]
SESSION_TIMEOUT_S = 3600


def _micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (or timestamp)
    value, free of the session time zone (no DST shifts in gaps)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def prompt_append(log: DataFrame) -> DataFrame:
    """L1: newlines become spaces (a log line per prompt)."""
    return log.withColumn("prompt", F.regexp_replace("prompt", "\n", " "))


def prompt_nth(log: DataFrame, n: int) -> DataFrame:
    """L2: n-th most recent non-blank prompt per session (0 = newest).
    Plans a WindowGroupLimit: only n+1 rows per session and partition shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    ranked = log.where(strip("prompt") != "").withColumn("__rn", F.row_number().over(w))
    return ranked.where(F.col("__rn") == n + 1).drop("__rn")


def _norm_prompt(c: Column) -> Column:
    return F.regexp_replace(strip(c), "\n", " ")


def library_add(library: DataFrame, saves: DataFrame) -> DataFrame:
    """L3: append-if-absent.  Saves are trimmed, blank ones refused; the first
    save of each text (by seq) is appended unless the library has it.
    Returns the appended rows (seq, prompt)."""
    s = saves.select("seq", _norm_prompt(F.col("prompt")).alias("prompt")).where(F.col("prompt") != "")
    first = s.groupBy("prompt").agg(F.min("seq").alias("seq"))  # partial aggregate: hot texts are cheap
    have = library.select(strip("prompt").alias("prompt"))
    return first.join(have, "prompt", "left_anti").select("seq", "prompt")


def library_delete(library: DataFrame, deletes: DataFrame) -> DataFrame:
    """L4: each requested text removes its first occurrence only; the
    predefined prompts and blank requests are refused.  Returns the library
    after deletion."""
    req = (deletes.select(strip("prompt").alias("prompt")).where(F.col("prompt") != "")
           .where(~F.col("prompt").isin(PREDEFINED_PROMPTS)).distinct())
    lib = library.select("seq", strip("prompt").alias("prompt")).where(F.col("prompt") != "")
    firsts = lib.groupBy("prompt").agg(F.min("seq").alias("seq")).join(req, "prompt", "left_semi")
    return lib.join(firsts, ["prompt", "seq"], "left_anti").select("seq", "prompt")


def library_list(library: DataFrame) -> DataFrame:
    """Predefined prompts first (fixed order), then the library's
    non-blank lines in file order without copies of predefined ones."""
    spark = library.sparkSession
    pre = spark.createDataFrame([(i - len(PREDEFINED_PROMPTS), p) for i, p in enumerate(PREDEFINED_PROMPTS)],
                                "seq bigint, prompt string")
    user = (library.select(F.col("seq").cast("bigint"), strip("prompt").alias("prompt"))
            .where(F.col("prompt") != "").where(~F.col("prompt").isin(PREDEFINED_PROMPTS)))
    return pre.unionByName(user)


def session_attrs(attrs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Later writes overwrite per (session, key); writes to unknown
    sessions are refused (``left_semi``).  ``max_by`` over a struct keeps
    null values as written."""
    known = attrs.join(sessions.select("session_id"), "session_id", "left_semi")
    last = known.groupBy("session_id", "key").agg(F.max_by(F.struct("value"), "seq").alias("__v"))
    return last.select("session_id", "key", F.col("__v.value").alias("value"))


def sessionize(accesses: DataFrame, timeout_s: int = SESSION_TIMEOUT_S) -> DataFrame:
    """A session ends once idle time exceeds ``timeout_s`` (strictly);
    accesses exactly ``timeout_s`` apart stay in one session.

    Accesses are range-partitioned by (user, time), so one user with a third of
    all accesses, even on one day, spans many partitions of equal size.  Each
    is scanned on its own; one boundary row for each partition carries the last
    access and the start of its session into the next."""
    a = accesses.select("session_id", "ts", _micros(F.col("ts")).alias("__t"))
    spread = a.repartitionByRange("session_id", "__t").withColumn("__p", F.spark_partition_id())
    spread = cut_lineage(spread)  # range bounds come from sampling; fix them
    within = Window.partitionBy("__p", "session_id").orderBy("__t")
    by_part = Window.orderBy("__p")  # over one row for each partition

    def same(boundary: str) -> Column:
        return F.col(f"{boundary}.session_id").eqNullSafe(F.col("session_id")) & F.col(boundary).isNotNull()

    tails = spread.groupBy("__p").agg(F.max(F.struct("session_id", "__t")).alias("__tail"))
    before = tails.select("__p", "__tail", F.lag("__tail").over(by_part).alias("__before"))
    rows = spread.join(F.broadcast(before), "__p")
    last = F.coalesce(F.lag("__t").over(within), F.when(same("__before"), F.col("__before.__t")))
    rows = rows.withColumn("__last", last)
    # Ties (same instant) keep one session: only a gap > timeout starts one.
    starts = F.col("__last").isNull() | ((F.col("__t") - F.col("__last")) > timeout_s * 1_000_000)
    rows = cut_lineage(rows.withColumn("__s", starts))

    # The latest session start of each partition's last user, up to that partition.
    own = rows.where(same("__tail")).groupBy("__p").agg(
        F.first("__tail").alias("__tail"), F.max(F.when(F.col("__s"), F.col("__t"))).alias("__start"))
    so_far = Window.partitionBy("__tail.session_id").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("__p", F.struct(F.col("__tail.session_id"), F.last("__start", True).over(so_far).alias("__t")).alias("__o"))
    carried = own.select("__p", F.lag("__o").over(by_part).alias("__open"))
    in_part = F.last(F.when(F.col("__s"), F.col("__t")), True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    done = rows.join(F.broadcast(carried), "__p").withColumn(
        "__start", F.coalesce(in_part, F.when(same("__open"), F.col("__open.__t"))))
    g = done.groupBy("session_id", "__start").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("accesses"))
    return g.select("session_id", "session_start", "last_access", "accesses")


def session_sweep(accesses: DataFrame, at: Column, timeout_s: int = SESSION_TIMEOUT_S) -> DataFrame:
    """Sessions expired at instant ``at`` (idle strictly over timeout)."""
    last = accesses.groupBy("session_id").agg(F.max("ts").alias("last_access"))
    idle = _micros(at) - _micros(F.col("last_access"))
    return last.withColumn("idle_s", (idle / 1_000_000).cast("bigint")).where(idle > timeout_s * 1_000_000)


# Fixed retention policy of the spec: class, max age (hours, None = always),
# exempt file names, and a name rule some classes apply.
RETENTION_POLICY = [
    ("upload", 24, [".gitkeep"], None),
    ("download", 24, [], None),
    ("json", 72, ["manifest.json"], None),
    ("script", 24, [], r"^script_.*\.py$"),
    ("temp", None, [".gitkeep", "prompts.txt"], None),
]


def retention(listing: DataFrame, now: Column) -> DataFrame:
    """Files due for deletion at ``now``: age strictly over the class's
    limit (temp files: always), exempt names kept, name rules applied.  The
    policy is a 5-row table, broadcast; deleting is not this job."""
    spark = listing.sparkSession
    pol = spark.createDataFrame(RETENTION_POLICY, "class string, max_age_h int, exempt array<string>, name_rule string")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    j = listing.withColumn("name", name).join(F.broadcast(pol), "class")
    age_s = F.floor((_micros(now) - _micros(F.col("modified"))) / 1_000_000).cast("bigint")
    due = (F.col("max_age_h").isNull() | (age_s > F.col("max_age_h") * 3600))
    due = due & ~F.array_contains("exempt", F.col("name"))
    due = due & (F.col("name_rule").isNull() | F.regexp_like(F.col("name"), F.col("name_rule")))
    return j.where(due).select("path", "class", age_s.alias("age_s"))


def code_blocks(responses: DataFrame) -> DataFrame:
    """First fenced block of each response, else the trimmed text."""
    return responses.select("id", code_block("response").alias("code"))


# Fixed intake rules of the spec: allowed extensions and size limit.
ALLOWED_EXTENSIONS = ["xlsx", "xls", "csv"]
MAX_UPLOAD_BYTES = 16 * 1024 * 1024


def file_intake(listing: DataFrame, check_size: bool = True) -> DataFrame:
    """S8 + S9 over a file listing: accepted or rejected with a reason, and
    the reader kind (excel / csv) of accepted files."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    ok_ext = ext.isin(ALLOWED_EXTENSIONS)
    too_big = F.lit(check_size) & (F.col("length") > MAX_UPLOAD_BYTES)
    reason = F.when(~ok_ext, "unsupported format").when(too_big, "too large")
    kind = F.when(ext.isin("xlsx", "xls"), "excel").when(ext == "csv", "csv")
    return listing.select("path", "length", ext.alias("extension"), reason.isNull().alias("accepted"),
                          reason.alias("reason"), F.when(reason.isNull(), kind).alias("kind"))

"""History replay (H5) and version tables (H4).

H5 replays an action log (commit / undo / redo) per sheet and reports the
cursor, length and flags after each action."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import qc
from gridframe.plans.ordinals import ROW
from gridframe.plans.replay import GROUP, RUN, replayed
from gridframe.plans.running import carry_last
from gridframe.session import cut_lineage, scratch_path
from gridframe.sheet import Sheet


def replay(log: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """H1-H3, H5 over a log ``(sheet_id, seq, action)``: the cursor, length and
    flags after each action, and ``visible_seq``, the commit that is then shown
    (null while a sheet has none).  Other actions than commit, undo and redo
    change nothing.

    The machine runs as composed maps of short runs (``plans.replay``), so one
    sheet's log spans many tasks.  The visible commit is the last one that
    landed on the cursor's position, carried forward by (sheet, position) in
    buckets of seq."""
    ordered = log.select(F.col("sheet_id").cast("bigint").alias("sheet_id"), F.col("seq").cast("bigint").alias("seq"), "action")
    at = replayed(ordered, "sheet_id", "seq", run, group)
    walked = cut_lineage(at.select(
        "sheet_id", "seq", "action", "pos", (F.col("top") + 1).alias("len"),
        (F.col("pos") > 0).alias("can_undo"), (F.col("pos") < F.col("top")).alias("can_redo")))
    is_commit = F.col("action").eqNullSafe("commit")
    shown = carry_last(walked, ["sheet_id", "pos"], "seq", F.col("seq"), is_commit, "__shown")
    visible = F.when(is_commit, F.col("seq")).otherwise(F.col("__shown.v")).alias("visible_seq")
    return shown.select(*[c for c in walked.columns], visible)


def write_versions(sheets: list[Sheet], path: str | None = None) -> str:
    """Store versions, each against the one before it."""
    path = path or scratch_path(sheets[0].df.sparkSession, "versions")
    for v, s in enumerate(sheets):
        write_change(s, path, v, v - 1 if v else None)
    return path


class VersionLog:
    """H1-H4 for one sheet over stored data: versions in a table, actions in a
    log whose rows carry the state after them.

    Undo, redo and commit read the last state row and write one; nothing is
    replayed.  The visible commit of a cursor is the last commit row that landed
    there, one aggregate over the log.  A version is stored as what changed
    against the one before it (``write_change``), or whole where that is
    smaller, where columns differ, or where ``chain`` changes precede it."""

    SCHEMA = "seq bigint, action string, pos bigint, len bigint, visible_seq bigint"

    def __init__(self, spark, path: str | None = None, chain: int = 16) -> None:
        self.spark = spark
        self.path = path or scratch_path(spark, "version-log")
        self.chain = chain

    def _actions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _last(self) -> dict:
        """The last state row."""
        row = self._actions().agg(F.max_by(F.struct("*"), "seq").alias("s")).first()["s"]
        return row.asDict() if row is not None else {"seq": -1, "action": None, "pos": -1, "len": 0, "visible_seq": None}

    def _record(self, action: str, last: dict, pos: int, length: int, visible: int) -> dict:
        row = {"seq": last["seq"] + 1, "action": action, "pos": pos, "len": length, "visible_seq": visible}
        one = self.spark.createDataFrame([tuple(row.values())], self.SCHEMA)
        one.write.mode("append").parquet(f"{self.path}/log")
        return row

    def _shown_at(self, pos: int) -> int:
        commits = self._actions().where((F.col("action") == "commit") & (F.col("pos") == pos))
        return commits.agg(F.max("seq")).first()[0]

    def commit(self, sheet: Sheet) -> None:
        """Store the sheet as a version, then log it: a failed write leaves no action."""
        last = self._last()
        seq = last["seq"] + 1
        write_change(sheet, f"{self.path}/versions", seq, last["visible_seq"], self.chain)
        self._record("commit", last, last["pos"] + 1, last["pos"] + 2, seq)

    def undo(self) -> Sheet | None:
        """The version before, or None if there is none."""
        last = self._last()
        if last["pos"] <= 0:
            return None
        pos = last["pos"] - 1
        return self._visible(self._record("undo", last, pos, last["len"], self._shown_at(pos)))

    def redo(self) -> Sheet | None:
        last = self._last()
        if last["pos"] >= last["len"] - 1:
            return None
        pos = last["pos"] + 1
        return self._visible(self._record("redo", last, pos, last["len"], self._shown_at(pos)))

    def current(self) -> Sheet | None:
        return self._visible(self._last())

    def state(self) -> dict:
        """can_undo, can_redo and the seq of the visible commit."""
        s = self._last()
        return {"can_undo": s["pos"] > 0, "can_redo": s["pos"] < s["len"] - 1, "visible_seq": s["visible_seq"]}

    def _visible(self, last: dict) -> Sheet | None:
        seq = last["visible_seq"]
        return None if seq is None else read_version(self.spark, f"{self.path}/versions", seq)


def write_version(sheet: Sheet, path: str, version: int) -> None:
    """Store one version whole, sorted by ``_row`` so row filters prune row groups."""
    (sheet.df.withColumn("version", F.lit(version)).repartitionByRange(ROW).sortWithinPartitions(ROW)
     .write.mode("append").partitionBy("version").parquet(path))
    _note(sheet.df.sparkSession, path, version, None, 0, sheet.n_rows)


def write_change(sheet: Sheet, path: str, version: int, parent: int | None, chain: int = 16) -> None:
    """Store a version as the rows that differ from its parent's and its row
    count; whole where there is no parent, its columns or types differ, over
    half of the rows changed, or ``chain`` changes precede it already."""
    spark = sheet.df.sparkSession
    notes = _notes(spark, path)
    before = read_version(spark, path, parent) if parent is not None else None
    if before is None or before.df.dtypes != sheet.df.dtypes or notes[parent][1] >= chain:
        return write_version(sheet, path, version)
    sheet = Sheet(cut_lineage(sheet.df), sheet._n_rows)
    old = before.df.select(ROW, F.struct(*[qc(c) for c in sheet.columns]).alias("__old"))
    new = sheet.df.select(ROW, F.struct(*[qc(c) for c in sheet.columns]).alias("__new"))
    # A struct that is null is a row that is not there; one with null cells is.
    changed = new.join(old, ROW, "left").where(~F.col("__new").eqNullSafe(F.col("__old")))
    changed = cut_lineage(changed.select(ROW, "__new.*"))
    if 2 * changed.count() > sheet.n_rows:
        return write_version(sheet, path, version)
    (changed.withColumn("version", F.lit(version)).repartitionByRange(ROW).sortWithinPartitions(ROW)
     .write.mode("append").partitionBy("version").parquet(path))
    _note(spark, path, version, parent, notes[parent][1] + 1, sheet.n_rows)


_NOTE = "version bigint, parent bigint, depth bigint, n_rows bigint"


def _note(spark, path: str, version: int, parent: int | None, depth: int, n_rows: int) -> None:
    spark.createDataFrame([(version, parent, depth, n_rows)], _NOTE).write.mode("append").parquet(f"{path}_chain")


def _notes(spark, path: str) -> dict[int, tuple[int | None, int, int]]:
    """version -> (parent, changes since a whole one, rows): a row a version."""
    try:
        rows = spark.read.schema(_NOTE).parquet(f"{path}_chain").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return {r["version"]: (r["parent"], r["depth"], r["n_rows"]) for r in rows}


def read_version(spark, path: str, version: int) -> Sheet:
    """H4: time travel.  The files of the version and of those it changes, back
    to a whole one, are read by partition; of each row the latest one counts."""
    notes = _notes(spark, path)
    chain = [version]
    while notes[chain[-1]][0] is not None:
        chain.append(notes[chain[-1]][0])
    n_rows = notes[version][2]
    # Versions of a chain share their columns, so the files of the first one tell them.
    parts = [f"{path}/version={v}" for v in chain]
    df = spark.read.option("basePath", path).parquet(*parts)
    if len(chain) == 1:
        return Sheet(df.drop("version"), n_rows)
    cols = [c for c in df.columns if c not in (ROW, "version")]
    rank = F.array_position(F.array(*[F.lit(v) for v in chain]), F.col("version").cast("int"))
    last = df.groupBy(ROW).agg(F.min_by(F.struct(*[qc(c) for c in cols]), rank).alias("__last"))
    return Sheet(last.where(F.col(ROW) < n_rows).select(ROW, "__last.*"), n_rows)

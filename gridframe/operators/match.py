"""Matching of columns between tables (P7-P9) by name and by content.

Each column of each table is sketched in one aggregate: how its values read
(integer, number, date, other text), how long they are, how many of their
characters are digits, and a theta sketch of its distinct values, which is
mergeable and at most ``8 << SKETCH_LOG`` bytes.  A pair of columns scores
between 0 and 1, and the assignment of least cost (greatest total score) pairs
the columns of a table with those of a lead table.  Renamed, reordered and
missing columns are thus found, and tables that lack a common header unite.

Sketches are partial aggregates by table, so a hot table is reduced in all its
tasks; scores and assignments are one row for each table.  Only the sketches
of the lead's columns are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import INTEGER, NUMBER, number_cast, qc
from gridframe.operators.conform import LOGICAL_TO_SPARK
from gridframe.operators.profile import normalized_name
from gridframe.plans.ordinals import ROW
from gridframe.sheet import Sheet

#: Distinct values that a sketch keeps: 2 ^ SKETCH_LOG.
SKETCH_LOG = 10
#: Weights of the closer of name and values, of the other of the two, of kinds, and of shape (sum 1).
CLOSER, OTHER, KINDS, SHAPE = 0.4, 0.1, 0.3, 0.2
#: Least score of a pair (kinds and most of the shape agree), and least mean score of the columns of similar tables.
LEAST_PAIR, LEAST_TABLE = 0.45, 0.55

_DATE = r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?$"
_KINDS = ("integers", "numbers", "dates", "texts")


def column_sketches(df: DataFrame, key: str, header: Column, columns: list[str]) -> DataFrame:
    """One row for each table (value of ``key``): ``cols``, an array with one
    struct for each of ``columns`` that has a name in ``header`` (an array, equal
    for all rows of a table) or a value."""
    aggs = []
    for i, c in enumerate(columns):
        x = qc(c).cast("string")
        x = F.when(F.trim(x) != "", x)
        kind = (F.when(x.rlike(INTEGER), "integers").when(x.rlike(NUMBER), "numbers")
                .when(x.rlike(_DATE), "dates").when(x.isNotNull(), "texts"))
        aggs.append(F.struct(
            F.lit(i).alias("position"), F.count(x).alias("n"), *[F.count_if(kind == k).alias(k) for k in _KINDS],
            F.coalesce(F.sum(F.length(x)), F.lit(0)).alias("length"),
            F.coalesce(F.sum(F.length(F.regexp_replace(x, "[^0-9]", ""))), F.lit(0)).alias("digits"),
            F.theta_sketch_agg(x, SKETCH_LOG).alias("values")).alias(f"s{i}"))
    sketched = df.groupBy(qc(key).alias(key)).agg(F.first(header, ignorenulls=True).alias("__header"), *aggs)
    named = F.array(*[
        F.struct(F.trim(F.get("__header", F.lit(i))).alias("name"), F.col(f"s{i}").alias("s"))
        for i in range(len(columns))])
    named = F.transform(named, lambda c: F.struct(
        c["name"].alias("name"), F.coalesce(normalized_name(c["name"]), F.lit("")).alias("plain"), c["s"].alias("s")))
    return sketched.select(key, F.filter(named, lambda c: (c["plain"] != "") | (c["s"]["n"] > 0)).alias("cols"))


def _share(a: Column, b: Column) -> Column:
    """Smaller over larger of two non-negative numbers; 1 where both are 0."""
    top = F.greatest(a, b)
    return F.coalesce(F.try_divide(F.least(a, b), top), F.lit(1.0))


def pair_score(t: Column, s: Column) -> Column:
    """Likeness of two sketched columns, 0 to 1.  A column without values is
    like another by its name alone."""
    longest = F.greatest(F.length(t["plain"]), F.length(s["plain"]), F.lit(1))
    name = F.when((t["plain"] == "") | (s["plain"] == ""), 0.0).otherwise(
        1 - F.levenshtein(t["plain"], s["plain"]) / longest)
    a, b = t["s"], s["s"]
    of_a, of_b = F.greatest(a["n"], F.lit(1)), F.greatest(b["n"], F.lit(1))
    kinds = 1 - sum((F.abs(a[k] / of_a - b[k] / of_b) for k in _KINDS), F.lit(0.0)) / 2
    distinct_a, distinct_b = F.theta_sketch_estimate(a["values"]), F.theta_sketch_estimate(b["values"])
    both = F.theta_sketch_estimate(F.theta_intersection(a["values"], b["values"]))
    fewer = F.least(distinct_a, distinct_b)
    overlap = F.coalesce(F.least(F.try_divide(both, fewer), F.lit(1.0)), F.lit(0.0))
    shape = (_share(a["length"] / of_a, b["length"] / of_b) + _share(a["digits"] / of_a, b["digits"] / of_b)) / 2
    held = overlap * kinds
    full = CLOSER * F.greatest(name, held) + OTHER * F.least(name, held) + KINDS * kinds + SHAPE * shape
    return F.round(F.when((a["n"] == 0) | (b["n"] == 0), name).otherwise(full), 6)


def best_assignment(score: np.ndarray) -> np.ndarray:
    """For each row the column it is given, or -1, so that the total of the
    scores is greatest and no column is given twice (shortest augmenting paths
    with potentials; a row may also stay alone at score 0)."""
    n, m = score.shape
    cost = np.hstack([-score, np.zeros((n, n))])
    width = m + n
    of_row, of_col = np.zeros(n), np.zeros(width)
    holder = np.full(width, -1)
    for row in range(n):
        least, before = np.full(width, np.inf), np.full(width, -1)
        seen = np.zeros(width, bool)
        at, col = row, -1
        while True:
            gap = cost[at] - of_row[at] - of_col
            closer = ~seen & (gap < least - 1e-12)
            least[closer], before[closer] = gap[closer], col
            step_to = np.where(seen, np.inf, least)
            nxt = int(step_to.argmin())
            step = step_to[nxt]
            of_row[row] += step
            of_row[holder[seen]] += step
            of_col[seen] -= step
            least[~seen] -= step
            seen[nxt], col = True, nxt
            if holder[nxt] < 0:
                break
            at = holder[nxt]
        while col >= 0:
            prior = before[col]
            holder[col] = holder[prior] if prior >= 0 else row
            col = prior
    given = np.full(n, -1)
    given[holder[:m][holder[:m] >= 0]] = np.flatnonzero(holder[:m] >= 0)
    return given


def _assigned(tables: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for scores in tables:
        given = []
        for s in scores:
            width = len(s[0]) if len(s) else 0
            given.append(best_assignment(np.array([list(r) for r in s], float).reshape(len(s), width)).tolist())
        yield pd.Series(given, dtype=object)


def match_columns(sketches: DataFrame, key: str, lead: DataFrame,
                  least_pair: float = LEAST_PAIR, least_table: float = LEAST_TABLE) -> DataFrame:
    """For each table of ``sketches`` its match with the lead's columns (``lead``:
    the one row of the lead's sketches): ``key``, ``pairs`` (for each column of
    the lead its position and name, and position, name and score of the column
    given to it, or nulls), ``likeness`` (total score over the larger number of
    columns) and ``similar`` (whether that reaches ``least_table``).

    Pairs below ``least_pair`` are never given.  A table without columns is
    similar to none; with no lead there are no rows."""
    # The lead is one row; the join adds it to each table's row.
    both = sketches.crossJoin(F.broadcast(lead.select(F.col("cols").alias("__lead")).limit(1)))
    score = F.transform("__lead", lambda t: F.transform("cols", lambda s: pair_score(t, s)))
    score = F.transform(score, lambda r: F.transform(r, lambda x: F.when(x >= least_pair, x).otherwise(0.0)))
    scored = both.withColumn("__score", score)
    # Not deterministic to the optimizer, so that it is never moved into the expressions over arrays below.
    assigned = F.pandas_udf(_assigned, "array<int>").asNondeterministic()
    scored = scored.withColumn("__given", assigned(F.col("__score")))

    def pair(t: Column, i: Column) -> Column:
        j = F.get("__given", i)
        value = F.when(j >= 0, F.get(F.get("__score", i), j))
        s = F.when(value > 0, F.get("cols", j))
        return F.struct(t["s"]["position"].alias("lead_position"), t["name"].alias("lead_name"),
                        s["s"]["position"].alias("position"), s["name"].alias("name"),
                        F.when(value > 0, value).alias("score"))

    paired = scored.select(key, F.transform("__lead", pair).alias("pairs"),
                           F.greatest(F.size("cols"), F.size("__lead")).alias("__most"))
    total = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + F.coalesce(p["score"], F.lit(0.0)))
    likeness = F.when(F.col("__most") > 0, F.round(total / F.col("__most"), 6)).otherwise(0.0)
    return paired.select(key, "pairs", likeness.alias("likeness"), (likeness >= least_table).alias("similar"))


def match_tables(split: DataFrame, columns: list[str], lead_id: int) -> DataFrame:
    """Every table of a split sheet (see ``conform.split_stacked``) against
    table ``lead_id``; see ``match_columns``."""
    sketches = column_sketches(split, "table_id", F.col("header"), columns)
    return match_columns(sketches, "table_id", sketches.where(F.col("table_id") == lead_id))


def unite_matched(split: DataFrame, columns: list[str], lead_id: int, target: list[tuple[str, str]]) -> DataFrame:
    """The rows of all tables similar to table ``lead_id`` by name and
    content, in the layout ``target`` = [(name of a lead's column, logical type)]:
    table_id, _row and the target columns.  A column that a table or the lead
    lacks is null, as is what does not cast.

    The matches, one row a table, meet the rows by table; the plan broadcasts
    them or splits a hot table as the sizes found at run time ask."""
    matches = match_tables(split, columns, lead_id).where("similar").select("table_id", "pairs")
    rows = split.join(matches, "table_id")
    cells = F.array(*[qc(c).cast("string") for c in columns])
    out = []
    for name, logical in target:
        wanted = normalized_name(F.lit(name))
        pair = F.get(F.filter("pairs", lambda p: normalized_name(p["lead_name"]) == wanted), F.lit(0))
        out.append(_typed(F.get(cells, pair["position"]), logical).alias(name))
    return rows.select("table_id", ROW, *out)


def _typed(x: Column, logical: str) -> Column:
    t = LOGICAL_TO_SPARK.get(logical, "string")
    return x if t == "string" else number_cast(x, t)


def _sheet_sketch(sheet: Sheet) -> DataFrame:
    header = F.array(*[F.lit(c) for c in sheet.columns])
    return column_sketches(sheet.df.withColumn("__table", F.lit(0)), "__table", header, sheet.columns)


def compare_matched(source: Sheet, target: Sheet) -> DataFrame:
    """P7 by name and content: one row for each column of either sheet
    (target_name, source_name, score, status): matched (equal normalised
    names), renamed, missing (target only), extra (source only)."""
    found = match_columns(_sheet_sketch(source), "__table", _sheet_sketch(target))
    pairs = found.select(F.inline("pairs"))
    given = pairs.select(
        F.col("lead_name").alias("target_name"), F.col("name").alias("source_name"), "score",
        F.when(F.col("name").isNull(), "missing")
        .when(normalized_name(F.col("name")) == normalized_name(F.col("lead_name")), "matched")
        .otherwise("renamed").alias("status"))
    held = F.transform(F.col("pairs"), lambda p: p["name"])
    extra = found.select(F.explode(F.array_except(F.array(*[F.lit(c) for c in source.columns]), held)).alias("source_name"))
    return given.unionByName(extra.select(
        F.lit(None).cast("string").alias("target_name"), "source_name",
        F.lit(None).cast("double").alias("score"), F.lit("extra").alias("status")))


def column_mapping(source: Sheet, target: Sheet) -> dict[str, str]:
    """{target column: source column} for ``conform.conform``; target columns
    without a counterpart are left out.  One row for each column reaches the driver."""
    rows = compare_matched(source, target).where("target_name is not null and source_name is not null")
    return {r["target_name"]: r["source_name"] for r in rows.collect()}

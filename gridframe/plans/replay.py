"""The undo / redo machine (H5) as composed maps, so that a log splits over tasks.

A state is (pos, top): the cursor and the newest version it may reach, both -1
before the first commit.  A commit makes both pos + 1, undo takes the cursor
down to 0 at least, redo up to ``top`` at most.  What a run of actions does to
any state is a small *map*:

* before its first commit the run only moves the cursor inside [0, top]: a
  clamped shift, ``least(greatest(pos + d, lo), hi)``, whose bounds depend on
  ``top``; they are listed for the tops from 0 up to the widest swing ``a`` of
  the run, beyond which ``lo`` stays and ``hi`` grows with ``top``;
- from the first commit on, the state depends on x, the cursor right after it;
  the outcome is listed for x from 0 up to the depth that undos reach below it,
  beyond which it grows with x.

Maps compose, so the log is cut into short runs of its order, runs are composed
in groups until a sheet has few, entry states come back down, and each run is
finished on its own.  All of it is SQL expressions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.plans.ordinals import ROW, numbered
from gridframe.session import cut_lineage

#: Actions of a run, and runs or groups that one level composes (4 at least).
RUN, GROUP = 256, 256

STATE = "struct<p:bigint,t:bigint>"
MAP = f"struct<d:bigint,pre:array<struct<lo:bigint,hi:bigint>>,post:array<{STATE}>>"

def _state(p: Column, t: Column) -> Column:
    return F.struct(p.cast("bigint").alias("p"), t.cast("bigint").alias("t"))


def _clamped(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def _places(last: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: i.cast("bigint"))


def _is(action: Column, name: str) -> Column:
    return action.eqNullSafe(F.lit(name))


def _step(at: Column, action: Column) -> Column:
    """One action on one state."""
    up = at["p"] + 1
    return (F.when(_is(action, "commit"), _state(up, up))
            .when(_is(action, "undo") & (at["p"] > 0), _state(at["p"] - 1, at["t"]))
            .when(_is(action, "redo") & (at["p"] < at["t"]), _state(up, at["t"])).otherwise(at))


def _move(action: Column) -> Column:
    return F.when(_is(action, "undo"), -1).when(_is(action, "redo"), 1).otherwise(0)


def run_map(actions: Column) -> Column:
    """The map of an array of actions."""
    first = F.array_position(F.transform(actions, lambda a: _is(a, "commit")), True).cast("int")
    before = F.when(first > 0, F.slice(actions, 1, F.greatest(first - 1, F.lit(0)))).otherwise(actions)
    after = F.when(first > 0, F.slice(actions, first + 1, F.size(actions)))

    def swing(w: Column, a: Column) -> Column:
        at = w["w"] + _move(a)
        return F.struct(at.alias("w"), F.least(w["low"], at).alias("low"), F.greatest(w["high"], at).alias("high"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("w", "low", "high")])
    walk = F.aggregate(before, zero, swing)

    def clamp_all(bounds: Column, a: Column) -> Column:
        return F.transform(bounds, lambda b, t: F.struct(
            _clamped(b["lo"] + _move(a), F.lit(0), t).cast("bigint").alias("lo"),
            _clamped(b["hi"] + _move(a), F.lit(0), t).cast("bigint").alias("hi")))

    widest = F.aggregate(before, zero, swing, lambda w: w["high"] - w["low"])
    ends = F.transform(_places(widest), lambda t: F.struct(F.lit(0).cast("bigint").alias("lo"), t.alias("hi")))
    pre = F.aggregate(before, ends, clamp_all)

    def dive(w: Column, a: Column) -> Column:
        commit, redo = _is(a, "commit"), _is(a, "redo") & (w["slack"] > 0)
        at = w["at"] + F.when(commit | redo, 1).when(_is(a, "undo"), -1).otherwise(0)
        slack = F.when(commit, 0).when(redo, w["slack"] - 1).when(_is(a, "undo"), w["slack"] + 1).otherwise(w["slack"])
        return F.struct(at.alias("at"), slack.alias("slack"), F.least(w["low"], at).alias("low"))

    still = F.struct(*[F.lit(0).alias(c) for c in ("at", "slack", "low")])
    depth = F.aggregate(after, still, dive, lambda w: -w["low"])
    post = F.aggregate(after, F.transform(_places(depth), lambda x: _state(x, x)),
                       lambda states, a: F.transform(states, lambda s: _step(s, a)))
    return F.struct(walk["w"].cast("bigint").alias("d"), pre.alias("pre"),
                    F.coalesce(post, F.array().cast(f"array<{STATE}>")).alias("post")).cast(MAP)


def _beyond(x: Column, listed: Column) -> tuple[Column, Column]:
    """The entry for ``x`` and how far ``x`` is beyond the last one."""
    last = (F.size(listed) - 1).cast("bigint")
    return F.get(listed, F.least(x, last).cast("int")), F.greatest(x - last, F.lit(0))


def _enter(m: Column, at: Column) -> Column:
    """The cursor after the part of a run before its first commit."""
    bounds, more = _beyond(F.greatest(at["t"], F.lit(0)), m["pre"])
    return F.when(at["t"] < 0, at["p"]).otherwise(_clamped(at["p"] + m["d"], bounds["lo"], bounds["hi"] + more))


def _from_commit(m: Column, x: Column) -> Column:
    """The state at the end of a run whose first commit put the cursor on ``x``."""
    end, more = _beyond(x, m["post"])
    return _state(end["p"] + more, end["t"] + more)


def apply_map(m: Column, at: Column) -> Column:
    """The state that the map's run leaves behind."""
    p = _enter(m, at)
    return F.when(F.size(m["post"]) == 0, _state(p, at["t"])).otherwise(_from_commit(m, p + 1))


def compose(m: Column, then: Column) -> Column:
    """The map of one run followed by another."""
    swing = F.size(m["pre"]) + F.size(then["pre"]) - 2

    def bounds(t: Column) -> Column:
        own, more = _beyond(t, m["pre"])
        return F.struct(_enter(then, _state(own["lo"], t)).alias("lo"), _enter(then, _state(own["hi"] + more, t)).alias("hi"))

    # Beyond this x the second run reaches no bound that depends on x.
    last = F.get(m["post"], F.size(m["post"]) - 1)
    needed = F.size(then["pre"]) - 1 + F.greatest(F.size(then["post"]) - 1, F.lit(0)) - last["p"]
    depth = F.size(m["post"]) - 1 + F.greatest(needed, F.lit(0))
    plain = F.struct((m["d"] + then["d"]).alias("d"), F.transform(_places(swing), bounds).alias("pre"), then["post"].alias("post"))
    late = F.struct(m["d"].alias("d"), m["pre"].alias("pre"),
                    F.transform(_places(depth), lambda x: apply_map(then, _from_commit(m, x))).alias("post"))
    return F.when(F.size(m["post"]) == 0, plain.cast(MAP)).otherwise(late.cast(MAP))


def _nothing() -> Column:
    return F.from_json(F.lit('{"d": 0, "pre": [{"lo": 0, "hi": 0}], "post": []}'), MAP)


def _entries(maps: DataFrame, keys: list[str], n: int, group: int) -> DataFrame:
    """(keys, run, entry) for ``maps`` (keys, run, map): the state before each
    run.  ``n`` is a bound of a key's runs; above ``group`` they are composed first."""
    whole = n <= group
    up = F.lit(0).cast("bigint") if whole else F.floor(F.col("run") / group).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("run", "map")))
    groups = maps.groupBy(*keys, up.alias("up")).agg(listed.alias("runs"))
    if whole:
        groups = groups.withColumn("entry", _state(F.lit(-1), F.lit(-1)))
    else:
        groups = cut_lineage(groups)
        above = groups.select(*keys, F.col("up").alias("run"),
                              F.aggregate("runs", _nothing(), lambda m, r: compose(m, r["map"])).alias("map"))
        entry = _entries(cut_lineage(above), keys, n // group + 2, group)
        groups = groups.join(entry.withColumnRenamed("run", "up"), [*keys, "up"])

    def pass_on(acc: Column, r: Column) -> Column:
        one = F.struct(r["run"].alias("run"), acc["at"].alias("entry"))
        return F.struct(apply_map(r["map"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    out_type = f"array<struct<run:bigint,entry:{STATE}>>"
    start = F.struct(F.col("entry").alias("at"), F.array().cast(out_type).alias("out"))
    folded = groups.select(*keys, F.explode(F.aggregate("runs", start, pass_on, lambda acc: acc["out"])).alias("e"))
    return folded.select(*keys, "e.run", "e.entry")


def replayed(log: DataFrame, key: str, order: str, run: int = RUN, group: int = GROUP) -> DataFrame:
    """``log`` (key, order, action) with ``pos`` and ``top`` after each action.

    Rows are numbered in (key, order) and cut into runs of ``run`` rows, so a
    key with most of the log spans as many tasks as its rows need."""
    if run < 1 or group < 4:  # smaller groups never get few enough
        raise ValueError(f"a run needs an action and a group four runs, got {run}, {group}")
    rows, n = numbered(log.select(key, order, "action"), [F.col(key), F.col(order)])
    cut = rows.groupBy(key, F.floor(F.col(ROW) / run).cast("bigint").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct(ROW, order, "action"))).alias("acts"))
    cut = cut_lineage(cut)
    maps = cut.select(key, "run", run_map(F.transform("acts", lambda a: a["action"])).alias("map"))
    entry = _entries(cut_lineage(maps), [key], n // run + 2, group)

    def act(acc: Column, a: Column) -> Column:
        at = _step(acc["at"], a["action"])
        one = F.struct(a[order].alias(order), a["action"].alias("action"), at.alias("at"))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    types = dict(rows.dtypes)
    start = F.struct(F.col("entry").alias("at"),
                     F.array().cast(f"array<struct<`{order}`:{types[order]},action:string,at:{STATE}>>").alias("out"))
    done = cut.join(entry, [key, "run"]).select(key, F.explode(F.aggregate("acts", start, act, lambda acc: acc["out"])).alias("a"))
    return done.select(key, F.col(f"a.{order}").alias(order), "a.action", F.col("a.at.p").alias("pos"), F.col("a.at.t").alias("top"))

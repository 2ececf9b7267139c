"""Benchmark: the BASELINE workloads on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS]; prints ONE JSON line.

Each workload is forced to completion with the ``noop`` sink (every row is
computed, nothing is collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _sf_of(path: str) -> float | str:
    tail = path.rstrip("/").rsplit("sf", 1)[-1]
    try:
        return float(tail)
    except ValueError:
        return path


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from gridframe import fixtures as fx
    from gridframe.operators import clean, diff, edits, history, logs, profile
    from gridframe.session import get_spark
    from gridframe.sheet import Sheet

    spark = get_spark(f"local[{CPUS}]", int(CPUS))
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    li = fx.table(spark, SF_DIR, "lineitem")
    run(li.select("l_orderkey"))  # warm the JVM and the file cache once

    # 1. row ordinals on lineitem (600k rows at sf0.1)
    def ordinals():
        s = Sheet.from_df(li, [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")])
        run(s.df)
    timed("row_ordinals", ordinals)

    orders = fx.orders_sheet(spark, SF_DIR)
    orders.df.cache()
    n_orders = orders.n_rows

    # 2. modified-cell diff, 1 % of cells changed
    def modified():
        k = F.col("o_orderkey")
        new = Sheet(orders.df.select(
            "_row", "o_orderkey", "o_custkey",
            F.when(k % 100 == 1, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
            F.when(k % 100 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
            "o_orderdate",
            F.when(k % 100 == 3, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority")))
        run(diff.modified_cells(orders, new))
    timed("modified_cells", modified)

    # 3. mixed batch: 100 structural edits and 10,000 cell edits
    def mixed():
        structural = []
        for i in range(100):
            seq = 100 * i + 50
            kind = ["row", "row", "col", "row"][i % 4]
            if kind == "row":
                action = "create" if i % 3 else "remove"
                structural.append({"seq": seq, "type": "row", "action": action, "index": (i * 7919) % 1000,
                                   "amount": 1 + i % 5})
            else:
                structural.append({"seq": seq, "type": "col", "action": "create" if i % 8 == 2 else "remove",
                                   "index": 1, "amount": 1})
        ev = fx.table(spark, SF_DIR, "events").where(F.col("event_id") < 10000)
        cells = ev.select(F.col("event_id").alias("seq"), (F.col("event_id") * 13 % n_orders).alias("row"),
                          (F.col("event_id") % 6).cast("int").alias("col"), F.col("event_type").alias("new_value"))
        res = edits.apply_batch(orders, structural, cells)
        run(res.sheet.df)
        run(res.touched)
    timed("mixed_batch", mixed)

    # 3b. all events as cell edits between 3,000 structural edits
    def all_edits():
        structural = [{"seq": 33 * i, "type": "row", "action": "create" if i % 2 else "remove",
                       "index": (i * 7919) % (n_orders // 2), "amount": 1} for i in range(3000)]
        ev = fx.table(spark, SF_DIR, "events")
        cells = ev.select(F.col("event_id").alias("seq"), (F.col("event_id") * 13 % n_orders).alias("row"),
                          (F.col("event_id") % 6).cast("int").alias("col"), F.col("event_type").alias("new_value"))
        res = edits.apply_batch(orders, structural, cells)
        run(res.sheet.df)
        run(res.touched)
    timed("mixed_batch_all_events", all_edits)

    # 4. schema profile of lineitem (types, samples, counts)
    lsheet = Sheet.from_df(li)  # in file order

    def prof():
        run(profile.column_types_df(lsheet))
        run(profile.sample_values(lsheet))
        run(profile.profile_counts(lsheet))
    timed("profile", prof)

    # 5. blank-row drop with reindex on lineitem with derived holes
    def blank_rows():
        s = Sheet.from_df(li, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
        k = F.col("l_orderkey")
        holey = Sheet(s.df.select("_row", *[F.when(k % 7 != 0, F.col(c)).alias(c) for c in li.columns]), s.n_rows)
        run(clean.drop_blank_rows(holey).df)
    timed("blank_rows_reindex", blank_rows)

    ev = fx.table(spark, SF_DIR, "events")

    # 6. history replay over 100k actions
    def replay():
        action = (F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo")
                  .otherwise("commit"))
        run(history.replay(ev.select(F.col("user_id").alias("sheet_id"), F.col("event_id").alias("seq"),
                                     action.alias("action"))))
    timed("history_replay", replay)

    # 7. sessionisation of events
    def sessions():
        run(logs.sessionize(ev.select(F.col("user_id").alias("session_id"), "ts")))
    timed("sessionize", sessions)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_workload_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": _sf_of(SF_DIR)}))


if __name__ == "__main__":
    main()

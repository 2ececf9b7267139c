import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridframe.plans import assign_ordinals, carry_last, running_sum
from gridframe.plans.ordinals import dense_reindex


def test_ordinals_contiguous_in_order(spark):
    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20000).alias("k"), F.col("id").alias("v")).repartition(7)
    out = assign_ordinals(df, [F.col("k").desc()])
    rows = out.orderBy("_row").select("_row", "k").collect()
    assert [r._row for r in rows] == list(range(20000))
    assert [r.k for r in rows] == sorted((r.k for r in rows), reverse=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_dense_reindex(spark):
    df = spark.range(0, 10000).where(F.col("id") % 3 != 0).withColumnRenamed("id", "_row").withColumn(
        "orig", F.col("_row"))
    out = dense_reindex(df).orderBy("_row").collect()
    assert [r._row for r in out] == list(range(len(out)))
    assert [r.orig for r in out] == [i for i in range(10000) if i % 3]


def test_running_sum_matches_cumsum(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(0, 3) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(vals)), "_row long, v long")
    out = running_sum(df, "_row", F.col("v"), "s", 9000).orderBy("_row").collect()
    acc, want = 0, []
    for v in vals:
        acc += v
        want.append(acc)
    assert [r.s for r in out] == want


def test_carry_last_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), i, rnd.choice(["a", "b", None, ""])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, seq long, v string")
    out = carry_last(df, ["k"], "seq", F.col("v"), F.col("v") != "", "p", width=64)
    got = {(r.k, r.seq): (r.p.v if r.p is not None else "<none>") for r in out.collect()}
    last = {}
    for k, seq, v in rows:
        assert got[(k, seq)] == last.get(k, "<none>"), (k, seq)
        if v != "" and v is not None:
            last[k] = v
        elif v is None:
            pass  # pred is null for null values: not marked

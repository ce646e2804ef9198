from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from logwarden.operators.ordering import running_rank, slice_of, with_halo


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    seqs = rng.sample(range(-10_000, 4_000_000), 5000)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abcd"), s, i) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "g string, seq bigint, id int").cache()


@pytest.mark.parametrize("by", [(), ("g",)])
def test_rank_is_row_number(skewed, by):
    want = skewed.withColumn("w", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))
    got = running_rank(skewed, "seq", by)
    assert got.join(want.select("id", "w"), "id").where("rank <> w").count() == 0
    assert got.count() == skewed.count()


def test_outliers_bursts_and_equal_numbers_stay_spread(spark):
    """One row far away, a burst, and one number for a third of the rows: no range holds much more than its share."""
    n = 40_000
    far, burst, equal = (F.lit(-(2**61)), F.lit(2**61) + F.col("id") % 7, F.lit(5).cast("bigint"))
    rows = spark.range(n).select(
        "id", F.when(F.col("id") == 0, far).when(F.col("id") % 3 == 0, burst).when(
            F.col("id") % 3 == 1, equal).otherwise(F.col("id")).cast("bigint").alias("seq"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_rank(rows, "seq")
        ranged = rows.withColumn("t", F.xxhash64("id", "seq")).repartitionByRange("seq", "t")
        largest = ranged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert largest <= 2 * n / parts
    assert got.select("rank").distinct().count() == n and got.agg(F.max("rank")).first()[0] == n
    broken = got.withColumn("last", F.lag("seq").over(Window.orderBy("rank"))).where("last > seq")
    assert broken.count() == 0


def test_rank_breaks_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (0, "z"), (1, "c")], "seq bigint, t string")
    rows = running_rank(df, "seq", ties=["t"]).orderBy("rank").collect()
    assert [r.t for r in rows] == ["z", "a", "b", "c"]


def test_slices_of_large_and_negative_numbers(spark):
    values = [-1, 0, 9, 10, 2**62 + 7, -(2**62) + 3]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(slice_of(F.col("v"), 10)).collect()] == [v // 10 for v in values]


def test_halo_frames_equal_whole_frames(skewed):
    ranked = running_rank(skewed, "seq", ("g",))
    frame = lambda *p: Window.partitionBy(*p).orderBy("rank").rowsBetween(-6, 0)
    want = ranked.withColumn("w", F.sum("id").over(frame("g"))).select("id", "w")
    got = with_halo(ranked, "rank", 6, 10).withColumn(
        "s", F.sum("id").over(frame("g", "_slice"))).where("_home")
    assert got.join(want, "id").where("s <> w").count() == 0
    assert got.count() == skewed.count()


def test_nulls_are_ranked_too(spark):
    rows = [("a", 3), ("a", None), (None, 2), (None, 1), ("a", 1), (None, None)]
    got = running_rank(spark.createDataFrame(rows, "g string, seq bigint"), "seq", ["g"])
    assert sorted(((r.g, r.seq, r["rank"]) for r in got.collect()), key=str) == sorted(
        [("a", 1, 1), ("a", 3, 2), ("a", None, 3), (None, 1, 1), (None, 2, 2), (None, None, 3)], key=str)


def test_ranked_rows_are_not_shuffled_to_meet_their_ranges(skewed):
    """Only the ranges are sent to the tasks that read the ranked rows: nothing but a broadcast before the rank."""
    for by in ((), ("g",)):
        plan = running_rank(skewed, "seq", by)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan

"""The chunked window helpers equal plain windows, including gaps, ties of chunk and null keys."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.plans.ordered import lag_in_series, ordered_index, running_sum, time_chunk
from tests.conftest import rows


def _data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out, seen = [], set()
    for i in range(n):
        key = rnd.choice(["a", "b", None, "hot", "hot", "hot"])
        # gaps of up to three days so some chunks are empty
        t = base + dt.timedelta(seconds=rnd.randint(0, 3 * 86400 * 10))
        if (key, t) in seen:
            continue
        seen.add((key, t))
        out.append((i, key, t, rnd.randint(-50, 100)))
    return spark.createDataFrame(out, "id long, k string, ts timestamp_ntz, v long")


def test_lag_matches_plain_window(spark):
    df = _data(spark)
    got = lag_in_series(df, ["k"], ["ts"], ["v", "id"], chunk_seconds=3600 * 6)
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lag("ts").over(w).alias("prev_ts"),
                     F.lag("id").over(w).alias("prev_id"))
    assert rows(got, "id", "prev_v", "prev_ts", "prev_id") == rows(want)


def test_running_sum_matches_plain_window(spark):
    df = _data(spark, seed=11)
    got = running_sum(df, ["k"], ["ts"], "v", "rs", chunk_seconds=86400)
    want = df.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("ts")).alias("rs"))
    assert rows(got, "id", "rs") == rows(want)


def test_ordered_index_matches_row_number(spark):
    df = _data(spark, seed=3)
    got = ordered_index(df, ["k"], [F.col("ts"), F.col("id")], "n", chunk=time_chunk("ts", 7200))
    want = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).alias("n"))
    assert rows(got, "id", "n") == rows(want)


def test_ordered_index_descending_chunks(spark):
    df = spark.createDataFrame([(i, "h", f"backup-{i:04d}") for i in range(300)], "id long, k string, name string")
    got = ordered_index(df, ["k"], [F.col("name").desc()], "n", chunk=F.substring("name", 1, 9),
                        descending_chunks=True)
    assert rows(got, "id", "n") == sorted((299 - i, i + 1) for i in range(300))


def _hot(spark):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("hot", base + dt.timedelta(seconds=60 * i), i) for i in range(48 * 60)],
                                 "k string, ts timestamp_ntz, v long")


def _partitions_used(df, col):
    """Distinct tasks that produced ``col`` (the column is kept, so its window is not pruned away)."""
    return len(df.select(F.spark_partition_id().alias("_pid"), F.col(col)).groupBy("_pid")
               .agg(F.count(col).alias("n")).collect())


def test_one_hot_key_is_spread_over_tasks(spark):
    """All rows share one key: a plain window uses one task, the chunked helpers use many."""
    df = _hot(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("ts")))
        assert _partitions_used(plain, "p") == 1
        assert _partitions_used(lag_in_series(df, ["k"], ["ts"], ["v"], chunk_seconds=3600), "prev_v") >= 4
        assert _partitions_used(running_sum(df, ["k"], ["ts"], "v", "rs", chunk_seconds=3600), "rs") >= 4
        assert _partitions_used(ordered_index(df, ["k"], [F.col("ts")], "n", chunk=time_chunk("ts", 3600)), "n") >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # and the answers are still those of the plain window
    got = lag_in_series(df, ["k"], ["ts"], ["v"], chunk_seconds=3600)
    assert got.filter("prev_v is null").count() == 1
    assert got.filter("prev_v != v - 1").count() == 0

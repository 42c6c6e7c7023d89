"""Daily sketches merged against exact values; stepped buckets by panes; JSON of any shape."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import json_path
from fleetscope.operators import metrics, sketches
from fleetscope.plans import fixtures as fx
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


def test_percentiles_of_merged_days(spark):
    rng = random.Random(3)
    data = [(dt.datetime(2024, 1, 1 + i % 20), "ab"[i % 7 == 0], rng.lognormvariate(6, 1.5)) for i in range(60_000)]
    df = spark.createDataFrame([*data, (dt.datetime(2024, 1, 1), "a", None)], "ts timestamp_ntz, k string, latency_ms double")
    days = sketches.latency_sketches(df, ["k"])
    assert days.count() == 40
    for r in sketches.latency_report(days, ["k"]).collect():
        mine = sorted(x for _, k, x in data if k == r.k)
        assert (r.n, r.n_below) == (len(mine), sum(x < 2000 for x in mine))
        for got, p in ((r.p50, 0.5), (r.p95, 0.95)):
            assert abs(sum(x <= got for x in mine) / len(mine) - p) < 0.01
    assert sketches.latency_report(sketches.latency_sketches(df.limit(0), ["k"]), ["k"]).collect() == []


def test_distinct_counts_of_merged_days(spark):
    data = [(dt.datetime(2024, 1, 1 + i % 10), {"id": f"v{i % 5000}", "few": f"f{i % 3}"} if i % 11 else None) for i in range(40_000)]
    df = spark.createDataFrame(data, "start_ts timestamp_ntz, attributes map<string,string>")
    got = {r.key: r for r in sketches.hygiene_report(sketches.hygiene_sketches(df, ["id", "few", "none"])).collect()}
    assert [got[k].n_spans for k in ("id", "few", "none")] == [40_000] * 3
    assert got["id"].n_missing == got["few"].n_missing == len(range(0, 40_000, 11)) and got["none"].n_missing == 40_000
    assert abs(got["id"].n_distinct - 5000) < 250 and got["few"].n_distinct == 3 and got["none"].n_distinct == 0


def test_sources_of_findings(spark):
    data = [(dt.date(2024, 1, 1 + i % 4), f"r{i % 2}", i // 2 % 3000) for i in range(20_000)]
    df = spark.createDataFrame(data, "day date, rule string, doc_id long")
    for r in sketches.findings_report(sketches.findings_sketches(df)).collect():
        assert r.n_findings == 10_000 and abs(r.n_sources - 3000) < 150


@pytest.mark.parametrize("window,step", [("2 hours", "1 hour"), ("50 minutes", "20 minutes"), ("1 day", "90 minutes")])
def test_stepped_buckets(spark, window, step):
    """Equal to Spark's own sliding windows, also where the window is no multiple of the step."""
    tok = fx.v_tokens(spark, "/root/testdata/sf0.001").withColumn("model", F.when(F.col("model") != "view", F.col("model")))
    deltas = metrics.counter_delta(tok, ["model", "instance"]).filter("delta is not null")
    w = deltas.groupBy("model", "instance", F.window("ts", window, step).alias("w")).agg(F.sum("delta").cast("decimal(38,6)").alias("increase"))
    want = rows(w.select("model", "instance", F.col("w.start").cast("string"), F.col("w.end").cast("string"), "increase"))
    got = metrics.counter_increase(tok, ["model", "instance"], window, step)
    assert rows(got.select("model", "instance", F.col("window_start").cast("string"), F.col("window_end").cast("string"), "increase")) == want
    assert want


def test_stepped_buckets_move_two_rows_a_pane(spark):
    base = dt.datetime(2024, 1, 1)
    data = [("a", base + dt.timedelta(seconds=i), i) for i in range(3000)]
    df = spark.createDataFrame(data, "s string, ts timestamp_ntz, value long")
    got = metrics.counter_increase(df, ["s"], "24 hours", "1 minute")
    assert got.count() == 1440 + 49
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    totals = got.orderBy("window_start").collect()
    assert (totals[0].increase, totals[49].increase, totals[-1].increase) == (59, 2999, 60)


def test_floats_keep_buckets_free_of_rounding(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", base + dt.timedelta(minutes=i), 0.1 * i) for i in range(50)], "s string, ts timestamp_ntz, value double")
    got = metrics.counter_increase(df, ["s"], "10 minutes", "5 minutes")
    assert all(r.increase > 0 for r in got.collect())


def test_null_samples_are_none(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", base, 10), ("a", base + dt.timedelta(hours=1), None), ("a", base + dt.timedelta(hours=2), 30)],
                               "s string, ts timestamp_ntz, value long")
    assert [r.delta for r in metrics.counter_delta(df, ["s"]).orderBy("ts").collect()] == [None, 20]
    assert [r.increase for r in metrics.counter_increase(df, ["s"], "1 day").collect()] == [20]


def test_flags_come_from_unrounded_values(spark):
    from fleetscope.operators import traces

    obs = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("tokens"))
    r = traces.token_coverage(obs).collect()[0]
    assert r.coverage == 0.99999 and not r.target_met
    stats = spark.createDataFrame([("c", 49.99996, 1)], "container string, cpu_pct double, mem_used_bytes long")
    assert metrics.resource_targets(stats).collect()[0].cpu_ok


def test_json_of_any_shape(spark):
    texts = ['{"data":[{"metadata":{"x":"a"}}]}', '{"data":[{"metadata":{"x":{"y":1}}}]}', '{"data":{}}', '{"data":[', "null", "", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", json_path("t", "$.data[0].metadata.x").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["a", '{"y":1}', None, None, None, None, None, None]

"""Counter semantics on literal rows: resets, first sample, bucket edges, as-of lookback."""

import datetime as dt
from decimal import Decimal as D


from fleetscope.operators import metrics
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _counter(spark, points):
    return spark.createDataFrame([("m", T0 + dt.timedelta(seconds=s), D(str(v))) for s, v in points],
                                 "model string, ts timestamp_ntz, value decimal(18,2)")


def test_delta_reset_and_first_sample(spark):
    df = _counter(spark, [(0, 10), (60, 15), (120, 3), (180, 8)])
    got = rows(metrics.counter_delta(df, ["model"]), "ts", "delta", "is_reset")
    assert [r[1] for r in got] == [None, D("5.00"), D("3.00"), D("5.00")]
    assert [r[2] for r in got] == [None, False, True, False]


def test_increase_buckets_are_half_open_and_add_up(spark):
    # sample exactly at 01:00 belongs to the 01:00 bucket
    df = _counter(spark, [(0, 1), (1800, 3), (3600, 10), (5400, 2)])
    got = rows(metrics.counter_increase(df, ["model"], "1 hour"), "window_start", "increase")
    assert got == [(T0, D("2.00")), (T0 + dt.timedelta(hours=1), D("9.00"))]
    total = sum(r[1] for r in got)
    assert total == D("11.00")


def test_rate_bucket_without_delta_has_no_row(spark):
    df = _counter(spark, [(0, 1), (7200, 5)])
    got = metrics.counter_rate(df, ["model"], "1 hour").collect()
    assert len(got) == 1 and got[0]["rate"] == 4 / 3600


def test_match_labels_anchored_and_absent(spark):
    df = spark.createDataFrame([("webapp1", "x"), ("xwebapp1", "y"), (None, "z")], "name string, job string")
    assert rows(metrics.match_labels(df, re={"name": "webapp.*"}), "job") == [("x",)]
    assert rows(metrics.match_labels(df, eq={"name": ""}), "job") == [("z",)]
    m = spark.createDataFrame([({"name": "a"},), ({},)], "labels map<string,string>")
    assert metrics.match_labels(m, eq={"name": ""}, labels="labels").count() == 1


def test_instant_value_lookback(spark):
    df = _counter(spark, [(0, 1), (100, 2), (4000, 3)])
    times = spark.createDataFrame([("m", T0 + dt.timedelta(seconds=s)) for s in (50, 100, 350, 401, 3999, 4000, 9000)],
                                  "model string, eval_ts timestamp_ntz")
    got = rows(metrics.instant_value(df, times, ["model"], lookback=300), "eval_ts", "value")
    secs = {int((r[0] - T0).total_seconds()): r[1] for r in got}
    # 401 is more than 300 s after the sample at 100; 9000 is too late for 4000
    assert secs == {50: D("1.00"), 100: D("2.00"), 350: D("2.00"), 4000: D("3.00")}


def test_instant_value_crosses_chunks_and_gaps(spark):
    # lookback of two hours: the chunk size follows the lookback, so an older chunk is never needed
    df = _counter(spark, [(0, 1), (3 * 3600 - 10, 7)])
    times = spark.createDataFrame([("m", T0 + dt.timedelta(seconds=s)) for s in (7000, 3 * 3600 + 5000)],
                                  "model string, eval_ts timestamp_ntz")
    got = rows(metrics.instant_value(df, times, ["model"], lookback=7200), "eval_ts", "value")
    assert [r[1] for r in got] == [D("1.00"), D("7.00")]


def test_resource_targets(spark):
    df = spark.createDataFrame([("web", 40.0, 5 * 1024 ** 3), ("web", 70.0, 1024 ** 3)],
                               "container string, cpu_pct double, mem_used_bytes long")
    r = metrics.resource_targets(df).collect()[0]
    assert (r.avg_cpu_pct, r.cpu_ok, r.n_cpu_over, r.mem_normal_ok, r.mem_peak_ok) == (55.0, False, 1, True, True)


def test_evaluation_grid_per_series_span(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=10), D("1")), ("a", T0 + dt.timedelta(hours=3, minutes=5), D("2")),
                                ("b", T0 + dt.timedelta(hours=1, minutes=1), D("5"))],
                               "model string, ts timestamp_ntz, value decimal(18,2)")
    grid = rows(metrics.evaluation_grid(df, ["model"], "1 hour"), "model", "eval_ts")
    hours = [(m, int((t - T0).total_seconds() // 3600)) for m, t in grid]
    assert hours == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2)]
    got = rows(metrics.instant_value(df, metrics.evaluation_grid(df, ["model"], "1 hour"), ["model"], lookback=3600),
               "model", "eval_ts", "value")
    # a at 02:00 and 03:00 has no sample in the hour before: no row (no stale values)
    assert [(m, int((t - T0).total_seconds() // 3600), v) for m, t, v in got] == [
        ("a", 1, D("1.00")), ("a", 4, D("2.00")), ("b", 2, D("5.00"))]

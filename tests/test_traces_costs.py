"""Trace operators and cost attribution on literal rows."""

import datetime as dt
from decimal import Decimal as D

from fleetscope.operators import metrics, costs, traces
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def test_attribute_cost_left_join_and_pricing(spark):
    tr = spark.createDataFrame([("t1", D("1.50"), '{"tempo_trace_id": "ABC"}'), ("t2", D("2.00"), "{}")],
                               "trace_id string, total_cost decimal(12,2), metadata string")
    tid = "0" * 29 + "abc"
    cpu = spark.createDataFrame([(tid, T0, D("10")), (tid, T0 + dt.timedelta(minutes=5), D("100")),
                                 (tid, T0 + dt.timedelta(minutes=10), D("20"))],
                                "trace_id string, ts timestamp_ntz, value decimal(18,2)")
    out = {r.trace_id: r for r in costs.attribute_cost(tr, cpu).collect()}
    # increase = 90 + 20 (reset) = 110 cpu-seconds; price per cpu-hour
    assert out["t1"].cpu_seconds == D("110.00") and out["t1"].infra_found
    assert out["t1"].infra_cost == 110 * 0.024 / 3600
    assert out["t1"].total_cost == 1.5 + out["t1"].infra_cost
    assert out["t2"].infra_found is False and out["t2"].infra_cost == 0.0 and out["t2"].total_cost == 2.0
    assert out["t1"].explore_url.endswith(tid)


def test_attribute_cost_with_map_metadata(spark):
    tr = spark.createDataFrame([("t1", D("1.00"), {"tempo_trace_id": "ff"})],
                               "trace_id string, total_cost decimal(12,2), metadata map<string,string>")
    cpu = spark.createDataFrame([("0" * 30 + "ff", T0, D("1"))], "trace_id string, ts timestamp_ntz, value decimal(18,2)")
    r = costs.attribute_cost(tr, cpu).collect()[0]
    assert r.infra_found and r.cpu_seconds == D("0.00")


def test_sampling_is_per_trace_and_exact(spark):
    assert traces.sample_threshold(0.1) == 115292150460684698
    ids = [f"{i:032x}" for i in range(0, 2 ** 60, 2 ** 56)]
    df = spark.createDataFrame([(t, s) for t in ids for s in range(3)], "trace_id string, span int")
    got = traces.ratio_sample(df, 0.25)
    kept = {r.trace_id for r in got.collect()}
    assert len(kept) == 4 and got.count() == 12


def test_loop_traces_exact_vs_contains(spark):
    spans = spark.createDataFrame([("a", "memory_search")] * 11 + [("b", "memory_search")] * 10 +
                                  [("b", "memory_search_cache")] * 5, "trace_id string, name string")
    assert rows(traces.loop_traces(spans), "trace_id") == [("a",)]
    assert rows(traces.loop_traces(spans, match="contains"), "trace_id") == [("a",), ("b",)]


def test_merge_trace_updates_last_write_wins(spark):
    up = spark.createDataFrame([(1, "t", T0, "k", "old"), (2, "t", T0, "k", "same-ts-later-seq"),
                                (3, "t", T0 - dt.timedelta(1), "k", "older"), (4, "t", T0, "j", "x")],
                               "seq long, trace_id string, ts timestamp_ntz, meta_key string, meta_value string")
    got = rows(traces.merge_trace_updates(up), "meta_key", "meta_value")
    assert got == [("j", "x"), ("k", "same-ts-later-seq")]
    m = traces.as_metadata_map(traces.merge_trace_updates(up)).collect()[0].metadata
    assert m == {"j": "x", "k": "same-ts-later-seq"}


def test_reconcile_cost_flags(spark):
    t = spark.createDataFrame([("a", D("100")), ("b", D("100")), ("c", D("1"))], "model string, tracked_cost decimal(18,2)")
    a = spark.createDataFrame([("a", 104.0), ("b", 120.0), ("d", 5.0), ("c", 0.0)], "model string, actual_cost double")
    got = dict(rows(costs.reconcile_cost(t, a), "model", "status"))
    assert got == {"a": "ok", "b": "mismatch", "c": "zero_actual", "d": "missing_tracked"}


def test_latency_targets_exact(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "latency_ms double")
    r = traces.latency_targets(df, ms=50, exact=True).collect()[0]
    assert (r.n, r.share_below, r.p50, r.p95) == (100, 0.49, 50.5, 95.05)


def test_attribute_cost_as_written_mode(spark):
    import pytest
    tr = spark.createDataFrame([("t1", D("1.00"), '{"tempo_trace_id": "ab"}')],
                               "trace_id string, total_cost decimal(12,2), metadata string")
    cpu = spark.createDataFrame([("0" * 30 + "ab", T0, D("0")), ("0" * 30 + "ab", T0 + dt.timedelta(seconds=100), D("50"))],
                                "trace_id string, ts timestamp_ntz, value decimal(18,2)")
    r = costs.attribute_cost(tr, cpu, mode="as_written").collect()[0]
    assert r.infra_cost == round(50 / 100 * 0.024, 6)   # average rate times the price, as documented
    with pytest.raises(ValueError):
        costs.attribute_cost(tr, cpu, mode="nope")


def test_two_containers_of_a_trace_are_two_counters(spark):
    tr = spark.createDataFrame([("t1", D("0.003400"), '{"tempo_trace_id": "ab"}'), ("t2", D("0.001000"), "{}")],
                               "trace_id string, total_cost decimal(18,6), metadata string")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    cpu = spark.createDataFrame([("ab", "A", at(0), D("100")), ("ab", "B", at(1), D("5")), ("ab", "A", at(2), D("110")),
                                 ("ab", "B", at(3), D("9")), (None, "A", at(4), D("7"))],
                                "trace_id string, container string, ts timestamp_ntz, value decimal(18,6)")
    out = {r.trace_id: r for r in costs.attribute_cost(tr, cpu, series=["container"]).collect()}
    assert out["t1"].cpu_seconds == 14 and out["t1"].llm_cost == D("0.003400")
    assert out["t2"].infra_found is False and out["t2"].cpu_seconds == 0


def test_sub_cent_costs_and_labelled_samples(spark):
    obs = spark.createDataFrame([(T0, "m", 1, D("0.003400")), (T0, "m", 2, D("0.003400"))],
                                "ts timestamp_ntz, model string, tokens long, cost decimal(18,6)")
    assert costs.usage_daily(obs).collect()[0].cost == D("0.006800")
    samples = spark.createDataFrame([(T0, {"trace_id": "ab", "pod": "x"}, D("0")), (T0 + dt.timedelta(seconds=9), {"trace_id": "ab", "pod": "x"}, D("0.07")),
                                     (T0, {"trace_id": "ab", "pod": "y"}, D("3")), (T0, {"pod": "z"}, D("3"))],
                                    "ts timestamp_ntz, labels map<string,string>, value decimal(18,6)")
    by_label = metrics.with_label(samples, "trace_id")
    tr = spark.createDataFrame([("t1", D("0"), '{"tempo_trace_id": "ab"}')], "trace_id string, total_cost decimal(18,6), metadata string")
    r = costs.attribute_cost(tr, by_label, series=["series"]).collect()[0]
    assert r.cpu_seconds == D("0.070000") and r.infra_cost > 4e-7


def test_hygiene_counts_absent_keys(spark):
    sp = spark.createDataFrame([({"service.name": "a"},), ({"x": "y"},), ({},), (None,)], "attributes map<string,string>")
    r = traces.attribute_hygiene(sp, ["service.name"], exact=True).collect()[0]
    assert (r.n_spans, r.n_missing, r.n_distinct) == (4, 3, 1)


def test_correlate_keeps_rows_without_a_link(spark):
    tr = spark.createDataFrame([(1, "t1", "{}"), (2, "t2", '{"tempo_trace_id": "ab"}')], "seq long, trace_id string, metadata string")
    other = spark.createDataFrame([("ab",), (None,), (None,)], "trace_id string")
    got = rows(traces.correlate(tr, other), "trace_id", "n_linked", "in_traces", "in_other")
    assert got == sorted([("t1", 0, True, False), ("t2", 1, True, True), (None, 2, False, True)], key=lambda t: (t[0] is None, t[0] or ""))

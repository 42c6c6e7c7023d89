"""Stream-equals-batch: rows of a view are written into 4 parquet files (out of time order),
read as a stream with maxFilesPerTrigger=1 and run with availableNow."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from fleetscope.operators import traces
from fleetscope.plans import fixtures as fx
from fleetscope.streaming import batch_forms, stateful
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def _as_stream(spark, df, n_files=4):
    folder = tempfile.mkdtemp(prefix="fleetscope-stream-")
    df = df.withColumn("_f", F.abs(F.hash(*df.columns)) % n_files)
    for i in range(n_files):  # file order is not time order
        df.filter(F.col("_f") == i).drop("_f").write.mode("overwrite").parquet(f"{folder}/part={i}")
    schema = df.drop("_f").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(folder)
    return stream, df.drop("_f")


def _run(spark, sdf, mode="append"):
    name = f"q{abs(hash(str(sdf.schema) + mode + str(dt.datetime.now())))}"
    ck = tempfile.mkdtemp(prefix="fleetscope-ck-")
    q = (sdf.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def test_error_alerts_stream_equals_batch(spark):
    logs = fx.v_logs(spark, SF)
    stream, batch = _as_stream(spark, logs)
    # complete mode: with a watermark longer than the data, append mode would hold every window back
    s = _run(spark, batch_forms.error_alerts(stream, "5 minutes", watermark="40 days"), mode="complete")
    b = batch_forms.error_alerts(batch, "5 minutes")
    conv = lambda df: rows(df.select("service", F.col("window_start").cast("string"), "n_errors"))
    assert conv(s) == conv(b) and len(conv(b)) > 0


def test_live_errors_follow_files(spark, tmp_path):
    for svc, text in [("web", "ok\nERROR: x\n"), ("redis", "fine\npanic: y\nexception z\n")]:
        (tmp_path / svc).mkdir()
        (tmp_path / svc / "out.log").write_text(text)
    s = _run(spark, batch_forms.live_errors(spark, str(tmp_path)))
    assert rows(s, "service", "message") == [("redis", "exception z"), ("redis", "panic: y"), ("web", "ERROR: x")]


def test_ingest_events_dedup(spark):
    ev = fx.table(spark, SF, "events")
    dup = ev.unionByName(ev.filter(F.col("event_id") % 3 == 0))
    stream, batch = _as_stream(spark, dup)
    s = _run(spark, batch_forms.ingest_events(stream, watermark="40 days"))
    assert s.count() == ev.count() == batch_forms.ingest_events(batch).count()


def test_correlate_stream_equals_batch(spark):
    spans = fx.v_spans(spark, SF)
    tr = spans.groupBy("trace_id").agg(F.min("start_ts").alias("ts"))
    s_spans, b_spans = _as_stream(spark, spans)
    s_tr, b_tr = _as_stream(spark, tr)
    s = _run(spark, batch_forms.correlate_stream(s_tr, s_spans, "2 days", watermark="40 days"))
    b = batch_forms.correlate_stream(b_tr, b_spans, "2 days")
    assert rows(s, "trace_id", "seq") == rows(b, "trace_id", "seq") and b.count() > 0


def test_loop_alerts_emit_once(spark):
    spans = fx.v_spans(spark, SF)
    stream, batch = _as_stream(spark, spans)
    s = _run(spark, stateful.loop_alerts(stream, "memory_search", 2, watermark="40 days"))
    want = rows(traces.loop_traces(batch, "memory_search", 2), "trace_id")
    got = rows(s, "trace_id")
    assert got == want and len(got) == len(set(got)) and len(got) > 0


def test_merge_updates_stream_equals_batch(spark):
    up = fx.v_updates(spark, SF)
    stream, batch = _as_stream(spark, up)
    s = _run(spark, stateful.merge_trace_updates_stream(stream, watermark="40 days"), mode="update")
    latest = s.groupBy("trace_id", "meta_key").agg(F.max_by("meta_value", "version").alias("meta_value"))
    assert rows(latest, "trace_id", "meta_key", "meta_value") == rows(
        traces.merge_trace_updates(batch), "trace_id", "meta_key", "meta_value")


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark, arriving in a later file, does not reach the windows."""
    base = dt.datetime(2024, 1, 10, 12)
    on_time = [(1, base, "web", "ERROR: a"), (2, base + dt.timedelta(minutes=1), "web", "ERROR: b")]
    late = [(3, base - dt.timedelta(days=2), "web", "ERROR: late")]
    schema = "line_id long, ts timestamp_ntz, service string, message string"
    spark.createDataFrame(on_time, schema).write.parquet(f"{tmp_path}/in/f1")
    spark.createDataFrame(late, schema).write.parquet(f"{tmp_path}/in/f2")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{tmp_path}/in"))
    out = _run(spark, batch_forms.error_alerts(stream, "5 minutes", watermark="1 hour"), mode="update")
    days = {r.window_start.day for r in out.collect()}
    assert days == {10}


def test_ingest_events_into_a_table(spark, tmp_path):
    from fleetscope.streaming.sinks import write_stream_table
    ev = fx.table(spark, SF, "events")
    stream, _ = _as_stream(spark, ev.unionByName(ev.filter(F.col("event_id") % 5 == 0)))
    q = write_stream_table(batch_forms.ingest_events(stream, watermark="40 days"), f"{tmp_path}/clean",
                           f"{tmp_path}/ck", available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/clean").count() == ev.count()


def _three_files(spark, tmp_path, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(f"{tmp_path}/in"))


def test_loop_alert_survives_a_file_without_its_trace(spark, tmp_path):
    base = dt.datetime(2024, 1, 10, 12)
    span = lambda t, i: (t, "memory_search", base + dt.timedelta(seconds=i))
    parts = [[span("a", i) for i in range(6)], [span("b", 6)], [span("a", i) for i in range(7, 13)]]
    stream = _three_files(spark, tmp_path, parts, "trace_id string, name string, start_ts timestamp_ntz")
    out = _run(spark, stateful.loop_alerts(stream, "memory_search", 10, watermark="1 hour"))
    assert rows(out) == [("a", 11)]


def test_merge_keeps_the_newest_value_across_files(spark, tmp_path):
    base = dt.datetime(2024, 1, 10, 12)
    at = lambda i: base + dt.timedelta(seconds=i)
    parts = [[(1, "a", at(5), "k", "new")], [(2, "b", at(6), "k", "x")], [(3, "a", at(1), "k", "old"), (4, "a", at(7), "j", "y")]]
    stream = _three_files(spark, tmp_path, parts, "seq long, trace_id string, ts timestamp_ntz, meta_key string, meta_value string")
    out = _run(spark, stateful.merge_trace_updates_stream(stream, watermark="1 hour"), mode="update")
    latest = out.groupBy("trace_id", "meta_key").agg(F.max_by("meta_value", "version").alias("v"))
    assert rows(latest, "trace_id", "meta_key", "v") == [("a", "j", "y"), ("a", "k", "new"), ("b", "k", "x")]


def test_unmatched_rows_come_out_once(spark, tmp_path):
    """SS4 as an outer join: matched, unmatched and id-less rows, the same as on a batch."""
    base = dt.datetime(2024, 1, 10, 12)
    at = lambda h: base + dt.timedelta(hours=h)
    far = dt.timedelta(days=9)  # moves both watermarks past everything before
    t_parts = [[("a", at(0), 1), ("b", at(0), 2), (None, at(1), 3)], [("c", at(2), 4), ("a", at(5), 5)], [("z", base + far, 9)]]
    s_parts = [[("x1", "a", at(0.5)), ("x2", "q", at(1)), ("x3", None, at(1))], [("x4", "c", at(8)), ("x5", "a", at(5.2)), ("x6", "a", at(5.3))],
               [("x9", "y", base + far)]]
    t_schema, s_schema = "trace_id string, ts timestamp_ntz, seq int", "span string, trace_id string, start_ts timestamp_ntz"
    streams, batches = [], []
    for name, parts, schema in (("t", t_parts, t_schema), ("s", s_parts, s_schema)):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/f{i}")
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}"))
        batches.append(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}"))
    cols = ["trace_id", "seq", "span", "in_traces", "in_spans"]
    near = lambda df: rows(df.filter("coalesce(trace_id, '') not in ('z', 'y')"), *cols)
    for how in ("full_outer", "left_outer", "right_outer"):
        got = near(_run(spark, batch_forms.correlate_stream(*streams, "1 hour", watermark="1 hour", how=how)))
        assert got == near(batch_forms.correlate_stream(*batches, "1 hour", how=how))
    full = near(batch_forms.correlate_stream(*batches, "1 hour", how="full_outer"))
    assert set(full) == {("a", 1, "x1", True, True), ("a", 5, "x5", True, True), ("a", 5, "x6", True, True), ("b", 2, None, True, False),
                         ("c", 4, None, True, False), ("c", None, "x4", False, True), ("q", None, "x2", False, True),
                         (None, 3, None, True, False), (None, None, "x3", False, True)} and len(full) == 9


def test_loop_state_expires(spark, tmp_path):
    """A trace silent for its time to live starts anew: its old spans no longer count, its old alert no longer mutes."""
    base = dt.datetime(2024, 1, 10, 12)
    span = lambda t, h: (t, "memory_search", base + dt.timedelta(hours=h))
    parts = [[span("a", i / 100) for i in range(6)] + [span("b", i / 100) for i in range(2)], [span("x", 20)], [span("x", 21)],
             [span("a", 22 + i / 100) for i in range(5)] + [span("b", 22), span("b", 22.1)], [("c", "memory_search", None)]]
    stream = _three_files(spark, tmp_path, parts, "trace_id string, name string, start_ts timestamp_ntz")
    out = _run(spark, stateful.loop_alerts(stream, "memory_search", 3, watermark="10 minutes", ttl_ms=3600 * 1000))
    assert rows(out) == [("a", 4), ("a", 4)]


def test_merge_takes_null_times_and_numbers(spark, tmp_path):
    base = dt.datetime(2024, 1, 10, 12)
    at = lambda i: base + dt.timedelta(seconds=i)
    parts = [[(1, "a", at(5), "k", "five"), (2, "a", None, "k", "no time"), (None, "a", at(5), "k", "no number"), (3, "a", at(4), None, "no key")],
             [(None, "a", at(6), "j", None), (7, "a", at(6), "j", "seven"), (4, None, at(9), "k", "no trace")], [(2, "a", at(5), "k", "two")]]
    schema = "seq long, trace_id string, ts timestamp_ntz, meta_key string, meta_value string"
    stream = _three_files(spark, tmp_path, parts, schema)
    out = _run(spark, stateful.merge_trace_updates_stream(stream, watermark="1 hour"), mode="update")
    latest = out.groupBy("trace_id", "meta_key").agg(F.max_by("meta_value", "version").alias("meta_value"))
    batch = traces.merge_trace_updates(spark.createDataFrame([r for p in parts for r in p], schema))
    want = rows(batch, "trace_id", "meta_key", "meta_value")
    assert rows(latest, "trace_id", "meta_key", "meta_value") == want == [("a", "j", "seven"), ("a", "k", "two")]


def test_events_are_written_once(spark, tmp_path):
    """Replayed batches and repeats that come after the watermark change nothing."""
    from fleetscope.streaming.sinks import once, write_once

    base = dt.datetime(2024, 1, 10, 12)
    event = lambda i, day=0, body="x": (f"e{i}", base + dt.timedelta(days=day, seconds=i), body)
    schema = "event_id string, ts timestamp_ntz, body string"
    parts = [[event(i) for i in range(5)] + [event(1)], [event(i, 3) for i in range(10, 15)], [event(2), event(3), event(20, 3)], []]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    read = lambda: (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                    .parquet(f"{tmp_path}/in"))
    want = sorted((f"e{i}",) for i in [*range(5), *range(10, 15), 20])
    for ck in ("ck", "lost"):
        write_once(batch_forms.ingest_events(read(), watermark="1 hour"), f"{tmp_path}/out", f"{tmp_path}/{ck}", available_now=True).awaitTermination()
        assert rows(spark.read.parquet(f"{tmp_path}/out"), "event_id") == want
    once(f"{tmp_path}/out")(spark.createDataFrame([event(4), event(30)], schema), 17)
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "event_id") == sorted([*want, ("e30",)])

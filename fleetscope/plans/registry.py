"""Registered queries: one per operator of SURVEY section 2, each with a DuckDB oracle.

Every query reads whole supplied tables (through the derived views of
``plans.fixtures``); nothing is sampled, capped or filtered by id to keep the
check cheap.  ``QUERIES[name](spark, sf_dir)`` returns a DataFrame;
``ORACLES[name]`` is SQL over the base tables with the same column names.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from . import fixtures as fx
from .fixture_sql import with_views
from .registration import ORACLES, QUERIES, register, rounded as _rounded  # noqa: F401
from ..operators import catalog, config, costs, fleet, logs, metrics, releases, secrets, traces
from .. import functions as fn
from ..sources.containers import parse_container_stats
from ..sources.logs import parse_bracketed_logs, parse_service_lines
from ..streaming import batch_forms, stateful

# Parameters of the registered queries (chosen once, shared by Spark and the oracle).
LOG_AS_OF = "2024-01-30 23:00:00"
FRESH_AS_OF = "2024-01-31 00:00:00"
PRUNE_AS_OF = "2024-02-15 00:00:00"
RETENTION_AS_OF = _dt.datetime(2024, 1, 25)
REPO_URL = "https://example.invalid/ops-kit"
EXPECTED_COMPONENTS = ["web", "object_store", "analytics"]

ID = "lpad(lower(trim({0})), 32, '0')"
TEMPO = ID.format("json_extract_string(metadata, '$.tempo_trace_id')")
DELTA = "case when prev_value is null then null when value >= prev_value then value - prev_value else value end"


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


# --------------------------------------------------------------------------- costs (flagship)

@register("attribute_cost", with_views(f"""
, d as (select trace_id, ts, value, lag(value) over (partition by trace_id, container order by ts) as prev_value from v_cpu)
, inc as (select {ID.format('trace_id')} as link_id, cast(coalesce(sum({DELTA}), 0) as decimal(38,6)) as cpu_seconds,
                 count(*) as n_samples from d group by 1)
, t as (select trace_id, total_cost as llm_cost, {TEMPO} as link_id from v_traces)
, j as (select t.*, inc.cpu_seconds, inc.n_samples,
               coalesce(cast(inc.cpu_seconds as double) * 0.024 / 3600, 0.0) as infra_cost
        from t left join inc on t.link_id = inc.link_id)
select trace_id, link_id as tempo_trace_id, llm_cost, coalesce(cpu_seconds, cast(0 as decimal(38,6))) as cpu_seconds,
       round(infra_cost, 12) as infra_cost, round(cast(llm_cost as double) + infra_cost, 9) as total_cost, n_samples is not null as infra_found,
       concat('/trace/', trace_id) as trace_url, concat('/explore?traceID=', link_id) as explore_url
from j""", "v_cpu", "v_traces"))
def q_attribute_cost(spark, sf):
    return _rounded(costs.attribute_cost(fx.v_traces(spark, sf), fx.v_cpu(spark, sf), series=["container"]),
                    infra_cost=12, total_cost=9)


@register("attribute_cost_as_written", with_views(f"""
, d as (select trace_id, ts, value, lag(value) over (partition by trace_id, container order by ts) as prev_value from v_cpu)
, inc as (select {ID.format('trace_id')} as link_id, cast(coalesce(sum({DELTA}), 0) as decimal(38,6)) as cpu_seconds,
                 count(*) as n_samples, cast(floor(epoch(max(ts))) - floor(epoch(min(ts))) as double) as span
          from d group by 1)
, t as (select trace_id, total_cost as llm_cost, {TEMPO} as link_id from v_traces)
, j as (select t.*, inc.cpu_seconds, inc.n_samples,
               coalesce(case when inc.span > 0 then cast(inc.cpu_seconds as double) / inc.span * 0.024 end, 0.0)
                 as infra_cost
        from t left join inc on t.link_id = inc.link_id)
select trace_id, link_id as tempo_trace_id, llm_cost, coalesce(cpu_seconds, cast(0 as decimal(38,6))) as cpu_seconds,
       round(infra_cost, 12) as infra_cost, round(cast(llm_cost as double) + infra_cost, 9) as total_cost, n_samples is not null as infra_found,
       concat('/trace/', trace_id) as trace_url, concat('/explore?traceID=', link_id) as explore_url
from j""", "v_cpu", "v_traces"))
def q_attribute_cost_as_written(spark, sf):
    return _rounded(costs.attribute_cost(fx.v_traces(spark, sf), fx.v_cpu(spark, sf), mode="as_written",
                                         series=["container"]), infra_cost=12, total_cost=9)


@register("reconcile_cost", with_views("""
, t as (select model, cast(sum(cost) as decimal(38,6)) as tracked_cost from v_obs group by model)
, j as (select coalesce(t.model, a.model) as model, t.tracked_cost, cast(t.tracked_cost as double) as t, a.actual_cost as a
        from t full outer join v_actual_cost a on t.model = a.model)
, r as (select *, case when a <> 0 then abs(t - a) / a end as rel_diff from j)
select model, tracked_cost, round(a, 6) as actual_cost, round(rel_diff, 9) as rel_diff,
       case when a is null then 'missing_actual' when t is null then 'missing_tracked' when a = 0 then 'zero_actual'
            when rel_diff <= 0.05 then 'ok' else 'mismatch' end as status
from r""", "v_obs", "v_actual_cost"))
def q_reconcile_cost(spark, sf):
    return _rounded(costs.reconcile_cost(costs.tracked_cost(fx.v_obs(spark, sf)), fx.v_actual_cost(spark, sf)),
                    actual_cost=6, rel_diff=9)


@register("usage_daily", with_views("""
select cast(ts as date) as day, model, count(*) as calls, cast(sum(tokens) as bigint) as tokens,
       cast(sum(cost) as decimal(38,6)) as cost
from v_obs group by all""", "v_obs"))
def q_usage_daily(spark, sf):
    return costs.usage_daily(fx.v_obs(spark, sf))


@register("score_summary", with_views("""
select name, source, count(value) as n, round(avg(cast(value as double)), 4) as mean,
       round(count_if(value > 0) / count(value), 4) as share_positive
from v_scores group by all""", "v_scores"))
def q_score_summary(spark, sf):
    return _rounded(costs.score_summary(fx.v_scores(spark, sf)), mean=4, share_positive=4)


# --------------------------------------------------------------------------- metrics

_TOKEN_DELTAS = """
, d as (select *, lag(value) over (partition by model, instance order by ts) as prev_value from v_tokens)
, dd as (select *, cast({delta} as decimal(18,6)) as delta from d)""".format(delta=DELTA)


@register("counter_delta", with_views(_TOKEN_DELTAS + """
select event_id, model, instance, ts, value, prev_value, delta,
       case when prev_value is null then null else value < prev_value end as is_reset
from dd""", "v_tokens"))
def q_counter_delta(spark, sf):
    return metrics.counter_delta(fx.v_tokens(spark, sf), ["model", "instance"])


@register("counter_increase", with_views(_TOKEN_DELTAS + """
select model, instance, date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
       cast(sum(delta) as decimal(38,6)) as increase
from dd where delta is not null group by all""", "v_tokens"))
def q_counter_increase(spark, sf):
    return metrics.counter_increase(fx.v_tokens(spark, sf), ["model", "instance"], "1 hour")


@register("counter_increase_stepped", with_views(_TOKEN_DELTAS + """
, b as (select model, instance, delta, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as window_start
        from dd where delta is not null)
select model, instance, window_start, window_start + interval 2 hour as window_end,
       cast(sum(delta) as decimal(38,6)) as increase
from b group by all""", "v_tokens"))
def q_counter_increase_stepped(spark, sf):
    return metrics.counter_increase(fx.v_tokens(spark, sf), ["model", "instance"], "2 hours", "1 hour")


@register("counter_increase_panes", with_views(_TOKEN_DELTAS + """
, b as (select model, instance, delta, unnest(range(0, 36)) as k, time_bucket(interval 10 minute, ts) as pane from dd where delta is not null)
select model, instance, pane - k * interval 10 minute as window_start, pane - k * interval 10 minute + interval 6 hour as window_end,
       cast(sum(delta) as decimal(38,6)) as increase
from b group by all""", "v_tokens"))
def q_counter_increase_panes(spark, sf):
    return metrics.counter_increase(fx.v_tokens(spark, sf), ["model", "instance"], "6 hours", "10 minutes")


@register("counter_increase_nulls", with_views("""
, gaps as (select * replace (case when event_id % 7 <> 0 then value end as value) from v_tokens)
, d as (select *, lag(value) over (partition by model, instance order by ts) as prev_value from gaps where value is not null)
select model, instance, date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
       cast(sum(case when value >= prev_value then value - prev_value else value end) as decimal(38,6)) as increase
from d where prev_value is not null group by all""", "v_tokens"))
def q_counter_increase_nulls(spark, sf):
    """A null sample is none: the increase reaches over it."""
    gaps = fx.v_tokens(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return metrics.counter_increase(gaps, ["model", "instance"], "1 day")


_RATE5 = _TOKEN_DELTAS + """
, r as (select model, instance, time_bucket(interval 5 minute, ts) as window_start,
               time_bucket(interval 5 minute, ts) + interval 5 minute as window_end,
               cast(sum(delta) as decimal(38,6)) as increase
        from dd where delta is not null group by all)"""


@register("counter_rate", with_views(_RATE5 + """
select model, instance, window_start, window_end, increase, 300 as window_seconds,
       round(cast(increase as double) / 300, 12) as rate
from r""", "v_tokens"))
def q_counter_rate(spark, sf):
    return _rounded(metrics.counter_rate(fx.v_tokens(spark, sf), ["model", "instance"], "5 minutes"), rate=12)


@register("sum_by_model", with_views(_RATE5 + """
select model, window_start, window_end, round(cast(sum(increase) as double) / 300, 12) as rate
from r group by all""", "v_tokens"))
def q_sum_by_model(spark, sf):
    rates = metrics.counter_rate(fx.v_tokens(spark, sf), ["model", "instance"], "5 minutes")
    return _rounded(metrics.sum_by(rates, ["model"]), rate=12)


_HOURLY = _TOKEN_DELTAS + """
, h as (select model, instance, date_trunc('{unit}', ts) as window_start,
               date_trunc('{unit}', ts) + interval 1 {unit} as window_end, cast(sum(delta) as decimal(38,6)) as increase
        from dd where delta is not null group by all)"""


@register("cost_per_hour", with_views(_HOURLY.format(unit="hour") + """
select window_start, window_end, cast(sum(increase) as decimal(38,6)) as cost_per_hour from h group by all""",
                                      "v_tokens"))
def q_cost_per_hour(spark, sf):
    return metrics.cost_per_hour(fx.v_tokens(spark, sf), ["model", "instance"])


@register("daily_cost", with_views(_HOURLY.format(unit="day") + """
select window_start, window_end, cast(sum(increase) as decimal(38,6)) as daily_cost from h group by all""",
                                   "v_tokens"))
def q_daily_cost(spark, sf):
    return metrics.daily_cost(fx.v_tokens(spark, sf), ["model", "instance"])


@register("infra_cost", with_views(f"""
, d as (select *, lag(value) over (partition by trace_id, container order by ts) as prev_value from v_cpu)
, h as (select trace_id, container, date_trunc('day', ts) as window_start, cast(sum({DELTA}) as decimal(38,6)) as increase
        from d where prev_value is not null group by all)
select window_start, window_start + interval 1 day as window_end,
       round(cast(sum(increase) as double) / 86400 * 0.024, 12) as infra_cost
from h group by all""", "v_cpu"))
def q_infra_cost(spark, sf):
    return _rounded(metrics.infra_cost(fx.v_cpu(spark, sf), ["trace_id", "container"]), infra_cost=12)


@register("match_labels", with_views("""
select * from v_tokens where coalesce(model, '') = 'view' and regexp_full_match(coalesce(instance, ''), '(?:[0-2])')""",
                                     "v_tokens"))
def q_match_labels(spark, sf):
    return metrics.match_labels(fx.v_tokens(spark, sf), eq={"model": "view"}, re={"instance": "[0-2]"})


@register("match_labels_map", with_views("""
select event_id, ts, value, model as label_model, instance as label_instance from v_tokens
where coalesce(model, '') = 'view' and regexp_full_match(coalesce(instance, ''), '(?:[0-2])')
  and coalesce(cast(null as varchar), '') = ''""", "v_tokens"))
def q_match_labels_map(spark, sf):
    tok = fx.v_tokens(spark, sf).select("event_id", "ts", "value", F.create_map(
        F.lit("model"), F.col("model"), F.lit("instance"), F.col("instance")).alias("labels"))
    # "job" is absent from every label set, so it equals ''
    hit = metrics.match_labels(tok, eq={"model": "view", "job": ""}, re={"instance": "[0-2]"}, labels="labels")
    return hit.select("event_id", "ts", "value", F.col("labels")["model"].alias("label_model"),
                      F.col("labels")["instance"].alias("label_instance"))


@register("instant_value", with_views("""
, times as (select distinct model, instance, date_trunc('hour', ts) + interval 1 hour as eval_ts from v_tokens)
, c as (select t.model, t.instance, t.eval_ts, s.ts as sample_ts, s.value,
               row_number() over (partition by t.model, t.instance, t.eval_ts order by s.ts desc) as rn
        from times t join v_tokens s on s.model = t.model and s.instance = t.instance
         and s.ts <= t.eval_ts and s.ts > t.eval_ts - interval 3600 second)
select model, instance, eval_ts, sample_ts, value from c where rn = 1""", "v_tokens"))
def q_instant_value(spark, sf):
    tok = fx.v_tokens(spark, sf)
    times = tok.select("model", "instance", F.window("ts", "1 hour").end.alias("eval_ts")).distinct()
    return metrics.instant_value(tok, times, ["model", "instance"], lookback=3600)


@register("range_values", with_views("""
, b as (select model, instance, date_trunc('hour', min(ts)) + interval 1 hour as lo,
               date_trunc('hour', max(ts)) + interval 1 hour as hi from v_tokens group by all)
, times as (select model, instance, unnest(generate_series(lo, hi, interval 1 hour)) as eval_ts from b)
, c as (select t.model, t.instance, t.eval_ts, s.ts as sample_ts, s.value,
               row_number() over (partition by t.model, t.instance, t.eval_ts order by s.ts desc) as rn
        from times t join v_tokens s on s.model = t.model and s.instance = t.instance
         and s.ts <= t.eval_ts and s.ts > t.eval_ts - interval 3600 second)
select model, instance, eval_ts, sample_ts, value from c where rn = 1""", "v_tokens"))
def q_range_values(spark, sf):
    tok = fx.v_tokens(spark, sf)
    grid = metrics.evaluation_grid(tok, ["model", "instance"], "1 hour")
    return metrics.instant_value(tok, grid, ["model", "instance"], lookback=3600)


@register("resource_targets", with_views("""
select container, count(*) as n_samples, round(avg(cpu_pct), 4) as avg_cpu_pct, round(max(cpu_pct), 4) as max_cpu_pct,
       count_if(cpu_pct >= 50) as n_cpu_over, round(avg(mem_used_bytes), 1) as avg_mem_bytes,
       max(mem_used_bytes) as max_mem_bytes, count_if(mem_used_bytes >= 4294967296) as n_mem_over_normal,
       count_if(mem_used_bytes >= 8589934592) as n_mem_over_peak,
       avg(cpu_pct) < 50 as cpu_ok, avg(mem_used_bytes) < 4294967296 as mem_normal_ok,
       max(mem_used_bytes) < 8589934592 as mem_peak_ok
from v_stats group by container""", "v_stats"))
def q_resource_targets(spark, sf):
    return _rounded(metrics.resource_targets(fx.v_stats(spark, sf)), avg_cpu_pct=4, max_cpu_pct=4, avg_mem_bytes=1)


# --------------------------------------------------------------------------- logs

_ERR = "regexp_matches(message, '(?i)error|fatal|panic|exception')"


@register("error_lines", with_views(f"select * from v_logs where {_ERR}", "v_logs"))
def q_error_lines(spark, sf):
    return logs.error_lines(fx.v_logs(spark, sf))


@register("recent_errors", with_views(f"""
select * from v_logs where {_ERR} and ts > timestamp '{LOG_AS_OF}' - interval 86400 second
  and ts <= timestamp '{LOG_AS_OF}'""", "v_logs"))
def q_recent_errors(spark, sf):
    return logs.since(logs.error_lines(fx.v_logs(spark, sf)), "ts", LOG_AS_OF, 86400)


@register("first_errors", with_views(f"""
select * from (select *, row_number() over (partition by service order by ts, line_id) as rn
               from v_logs where {_ERR}) where rn <= 3""", "v_logs"))
def q_first_errors(spark, sf):
    return logs.first_n(logs.error_lines(fx.v_logs(spark, sf)), ["service"], ["ts", "line_id"], 3)


@register("tail_logs", with_views("select * from (select * from v_logs order by ts desc, line_id desc limit 50)",
                                  "v_logs"))
def q_tail_logs(spark, sf):
    return logs.tail_n(fx.v_logs(spark, sf), ["ts", "line_id"], 50)


@register("merge_logs", with_views(f"""
select 'stdout' as stream, * from v_logs where not {_ERR}
union all
select 'stderr' as stream, * from v_logs where {_ERR}""", "v_logs"))
def q_merge_logs(spark, sf):
    lg = fx.v_logs(spark, sf)
    out = lg.filter(~F.col("message").rlike(logs.ERROR_PATTERN)).select(F.lit("stdout").alias("stream"), "*")
    err = logs.error_lines(lg).select(F.lit("stderr").alias("stream"), "*")
    return logs.merge_logs(out, err)


@register("error_alerts", with_views(f"""
select service, time_bucket(interval 5 minute, ts) as window_start,
       time_bucket(interval 5 minute, ts) + interval 5 minute as window_end, count(*) as n_errors
from v_logs where {_ERR} group by all""", "v_logs"))
def q_error_alerts(spark, sf):
    return batch_forms.error_alerts(fx.v_logs(spark, sf), "5 minutes", min_count=1)


# --------------------------------------------------------------------------- traces

@register("slow_calls", with_views("select * from v_traces where latency_ms > 5000", "v_traces"))
def q_slow_calls(spark, sf):
    return traces.slow_calls(fx.v_traces(spark, sf))


@register("drop_short_spans", with_views("select * from v_spans where duration_ms >= 10", "v_spans"))
def q_drop_short_spans(spark, sf):
    return traces.drop_short_spans(fx.v_spans(spark, sf))


@register("loop_alerts", with_views("""
select trace_id, cast(11 as bigint) as n_spans from v_spans where name = 'memory_search' group by trace_id
having count(*) > 10""", "v_spans"))
def q_loop_alerts(spark, sf):
    return stateful.loop_alerts(fx.v_spans(spark, sf), "memory_search", 10)


@register("ingest_events", """
select event_id, ts, user_id, event_type from (
  select *, row_number() over (partition by event_id order by ts) as rn
  from (select event_id // 2 as event_id, ts, user_id, event_type from events)) where rn = 1""")
def q_ingest_events(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.expr("event_id div 2").alias("event_id"), "ts", "user_id", "event_type")
    return batch_forms.ingest_events(ev)


@register("correlate_stream", with_views("""
select s.seq as span_seq, t.seq, t.ts as trace_ts, s.start_ts, s.trace_id
from v_spans s join (select seq, md5(cast(seq % 500 as string)) as trace_id, timestamp '2024-01-01' + interval 1 hour * (seq % 720) as ts
                     from v_traces) t on t.trace_id = s.trace_id
where s.start_ts between t.ts - interval 1 hour and t.ts + interval 1 hour""", "v_spans", "v_traces"))
def q_correlate_stream(spark, sf):
    t = fx.v_traces(spark, sf).select(
        "seq", F.md5((F.col("seq") % 500).cast("string")).alias("trace_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(seq % 720))").alias("ts"))
    s = fx.v_spans(spark, sf).select(F.col("seq").alias("span_seq"), "trace_id", "start_ts")
    return batch_forms.correlate_stream(t, s).select("span_seq", "seq", "trace_ts", "start_ts", "trace_id")


@register("correlate_stream_outer", with_views("""
, t as (select seq, case when seq % 11 <> 0 then md5(cast(seq % 500 as string)) end as trace_id,
               timestamp '2024-01-01' + interval 1 hour * (seq % 720) as ts from v_traces where seq % 10 = 0)
, s as (select seq as span_seq, case when seq % 13 <> 0 then trace_id end as trace_id, start_ts from v_spans)
select s.span_seq, t.seq, t.ts as trace_ts, s.start_ts, coalesce(s.trace_id, t.trace_id) as trace_id,
       t.seq is not null as in_traces, s.span_seq is not null as in_spans
from t full outer join s on t.trace_id = s.trace_id and s.start_ts between t.ts - interval 1 hour and t.ts + interval 1 hour""",
                                              "v_spans", "v_traces"))
def q_correlate_stream_outer(spark, sf):
    """Every trace and every span: matched, or alone once (also those without an id)."""
    t = fx.v_traces(spark, sf).filter(F.col("seq") % 10 == 0).select(
        "seq", F.when(F.col("seq") % 11 != 0, F.md5((F.col("seq") % 500).cast("string"))).alias("trace_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(seq % 720))").alias("ts"))
    s = fx.v_spans(spark, sf).select(F.col("seq").alias("span_seq"), F.when(F.col("seq") % 13 != 0, F.col("trace_id")).alias("trace_id"), "start_ts")
    return batch_forms.correlate_stream(t, s, how="full_outer").select(
        "span_seq", "seq", "trace_ts", "start_ts", "trace_id", "in_traces", "in_spans")


@register("ratio_sample", with_views(
    # a tenth of 2 ** 60, rounded up
    f"select * from v_spans where cast('0x' || substr({ID.format('trace_id')}, 18, 15) as bigint) < 115292150460684698", "v_spans"))
def q_ratio_sample(spark, sf):
    return traces.ratio_sample(fx.v_spans(spark, sf), 0.1)


@register("correlate", with_views(f"""
, t as (select seq, trace_id, {TEMPO} as link_id from v_traces)
, o as (select {ID.format('trace_id')} as link_id, count(*) as n_linked from v_cpu group by 1)
select coalesce(t.link_id, o.link_id) as link_id, t.seq, t.trace_id, coalesce(o.n_linked, 0) as n_linked,
       t.trace_id is not null as in_traces, o.n_linked is not null as in_other
from t full outer join o on t.link_id = o.link_id""", "v_traces", "v_cpu"))
def q_correlate(spark, sf):
    return traces.correlate(fx.v_traces(spark, sf), fx.v_cpu(spark, sf))


@register("slow_trace_metrics", with_views(f"""
select * from v_cpu where {ID.format('trace_id')} in (select {TEMPO} from v_traces where latency_ms > 5000)""",
                                           "v_traces", "v_cpu"))
def q_slow_trace_metrics(spark, sf):
    return traces.slow_trace_metrics(fx.v_traces(spark, sf), fx.v_cpu(spark, sf))


@register("correlate_by_time", with_views("""
, m as (select 'svc' || (event_id % 4) as service, date_trunc('hour', ts) as bucket_start, count(*) as n_samples,
               round(avg(cpu_pct), 9) as avg_cpu_pct, max(mem_used_bytes) as max_mem_bytes from v_stats group by 1, 2)
select s.*, date_trunc('hour', s.start_ts) as bucket_start, m.n_samples, m.avg_cpu_pct, m.max_mem_bytes
from v_spans s left join m on m.bucket_start = date_trunc('hour', s.start_ts) and m.service = s.service
where s.duration_ms > 5000""", "v_spans", "v_stats"))
def q_correlate_by_time(spark, sf):
    calls = traces.slow_calls(fx.v_spans(spark, sf), latency="duration_ms")
    stats = fx.v_stats(spark, sf).withColumn("service", F.concat(F.lit("svc"), (F.col("event_id") % 4).cast("string")))
    return _rounded(traces.correlate_by_time(calls, stats, "1 hour", keys=["service"]), avg_cpu_pct=9)


@register("loop_traces", with_views("""
select trace_id, count_if(name = 'memory_search') as n_spans from v_spans group by trace_id
having count_if(name = 'memory_search') > 10""", "v_spans"))
def q_loop_traces(spark, sf):
    return traces.loop_traces(fx.v_spans(spark, sf), "memory_search", 10)


@register("loop_traces_contains", with_views("""
select trace_id, count_if(contains(name, 'memory_search')) as n_spans from v_spans group by trace_id
having count_if(contains(name, 'memory_search')) > 10""", "v_spans"))
def q_loop_traces_contains(spark, sf):
    return traces.loop_traces(fx.v_spans(spark, sf), "memory_search", 10, match="contains")


@register("token_coverage", with_views("""
select model, count(*) as n_rows, count(tokens) as n_with_tokens, round(count(tokens) / count(*), 4) as coverage,
       count(tokens) = count(*) as target_met
from v_obs group by model""", "v_obs"))
def q_token_coverage(spark, sf):
    return _rounded(traces.token_coverage(fx.v_obs(spark, sf), ["model"]), coverage=4)


@register("latency_targets", with_views("""
select count(*) as n, round(count_if(latency_ms < 2000) / count(*), 4) as share_below,
       round(cast(quantile_cont(latency_ms, 0.5) as double), 4) as p50,
       round(cast(quantile_cont(latency_ms, 0.95) as double), 4) as p95
from v_traces""", "v_traces"))
def q_latency_targets(spark, sf):
    return _rounded(traces.latency_targets(fx.v_traces(spark, sf), exact=True), share_below=4, p50=4, p95=4)


@register("attribute_hygiene", with_views("""
, kv as (select 'service.name' as key, case when seq % 9 <> 0 and seq % 31 <> 0 then service end as value from v_spans
        union all select 'span.name', case when seq % 9 = 0 or seq % 31 <> 0 then name end from v_spans
        union all select 'host.name', null from v_spans)
select key, count(*) as n_spans, count_if(value is null) as n_missing, count(distinct value) as n_distinct
from kv group by key""", "v_spans"))
def q_attribute_hygiene(spark, sf):
    sp = fx.v_spans(spark, sf).withColumn(
        "attributes", F.when(F.col("seq") % 9 == 0, F.create_map(F.lit("span.name"), F.col("name")))
        .when(F.col("seq") % 31 != 0, F.create_map(F.lit("service.name"), F.col("service"), F.lit("span.name"), F.col("name"))))
    return traces.attribute_hygiene(sp, ["service.name", "span.name", "host.name"], exact=True)


@register("bad_ids", with_views("""
, odd as (select * replace (case when seq % 40 = 0 then upper(trace_id) when seq % 41 = 0 then null else trace_id end as trace_id,
                            case when seq % 43 = 0 then substr(span_id, 2) else span_id end as span_id) from v_spans)
select *, not coalesce(regexp_matches(trace_id, '^[0-9a-f]{32}$'), false) as bad_trace_id,
       not coalesce(regexp_matches(span_id, '^[0-9a-f]{16}$'), false) as bad_span_id
from odd
where not coalesce(regexp_matches(trace_id, '^[0-9a-f]{32}$'), false)
   or not coalesce(regexp_matches(span_id, '^[0-9a-f]{16}$'), false)""", "v_spans"))
def q_bad_ids(spark, sf):
    odd = fx.v_spans(spark, sf).withColumns({
        "trace_id": F.when(F.col("seq") % 40 == 0, F.upper("trace_id")).when(F.col("seq") % 41 != 0, F.col("trace_id")),
        "span_id": F.when(F.col("seq") % 43 == 0, F.substring("span_id", 2, 99)).otherwise(F.col("span_id"))})
    return traces.bad_ids(odd)


@register("merge_trace_updates", with_views("""
select trace_id, meta_key, meta_value, ts as updated_ts from (
  select *, row_number() over (partition by trace_id, meta_key order by ts desc, seq desc) as rn from v_updates)
where rn = 1""", "v_updates"))
def q_merge_trace_updates(spark, sf):
    return traces.merge_trace_updates(fx.v_updates(spark, sf))


# --------------------------------------------------------------------------- catalog

@register("match_names", with_views("""
, odd as (select * replace (case when changed and not in_primary then '.DS_Store' when changed and not in_replica then concat(name, '.log')
                                 when changed and host like '1%' then '.sync-lock' when changed then 'backup-.zip' else name end as name)
          from v_files)
select * from odd where name not in ('.sync-lock', '.DS_Store', '.docker-backup-lock') and not ends_with(name, '.log')
  and length(name) > 4 and name like 'backup%'""", "v_files"))
def q_match_names(spark, sf):
    name = (F.when(F.col("changed") & ~F.col("in_primary"), F.lit(".DS_Store"))
            .when(F.col("changed") & ~F.col("in_replica"), F.concat("name", F.lit(".log")))
            .when(F.col("changed") & F.col("host").startswith("1"), F.lit(".sync-lock"))
            .when(F.col("changed"), F.lit("backup-.zip")).otherwise(F.col("name")))
    return catalog.match_names(fx.v_files(spark, sf).withColumn("name", name), include="backup*")


@register("archive_stamps", with_views(r"""
, s as (select host, name, mtime,
               try_strptime(nullif(regexp_extract(name, '(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})', 1), ''),
                            '%Y-%m-%d_%H-%M-%S') as stamp from v_files)
select host, name, mtime, stamp, contains(name, '-manual-') as manual,
       cast(floor(epoch(mtime)) - floor(epoch(stamp)) as bigint) as stamp_lag_seconds
from s""", "v_files"))
def q_archive_stamps(spark, sf):
    return catalog.archive_stamps(fx.v_files(spark, sf))


@register("oversize", with_views("select * from v_files where size_bytes > 1048576", "v_files"))
def q_oversize(spark, sf):
    return catalog.oversize(fx.v_files(spark, sf))


@register("mirror_diff", with_views("""
select coalesce(p.host, r.host) as host, coalesce(p.name, r.name) as name,
       case when r.host is null then 'copy' when p.host is null then 'delete'
            when p.size_bytes is distinct from r.size_bytes or p.mtime is distinct from r.mtime then 'update'
            else 'same' end as action,
       p.size_bytes as p_size, r.size_bytes as r_size
from v_primary p full outer join v_replica r on p.host = r.host and p.name = r.name""", "v_primary", "v_replica"))
def q_mirror_diff(spark, sf):
    return catalog.mirror_diff(fx.primary_catalog(spark, sf), fx.replica_catalog(spark, sf))


@register("mirror_diff_excluded", with_views("""
, p as (select host, case second(mtime) % 20 when 3 then name || '.log' when 7 then '.sync-lock' else name end as name, size_bytes, mtime from v_primary)
, r as (select host, case second(mtime) % 20 when 3 then name || '.log' else name end as name, size_bytes, mtime from v_replica
        union all select distinct host, '.sync-lock', 1, timestamp '2024-01-01' from v_replica)
, pk as (select * from p where not ends_with(name, '.log') and name <> '.sync-lock')
, rk as (select * from r where not ends_with(name, '.log') and name <> '.sync-lock')
select coalesce(p.host, r.host) as host, coalesce(p.name, r.name) as name,
       case when r.host is null then 'copy' when p.host is null then 'delete'
            when p.size_bytes is distinct from r.size_bytes or p.mtime is distinct from r.mtime then 'update'
            else 'same' end as action,
       p.size_bytes as p_size, r.size_bytes as r_size
from pk p full outer join rk r on p.host = r.host and p.name = r.name""", "v_primary", "v_replica"))
def q_mirror_diff_excluded(spark, sf):
    """Lock files and logs of either side are no part of the plan."""
    odd = F.second("mtime") % 20
    logged = F.when(odd == 3, F.concat("name", F.lit(".log"))).otherwise(F.col("name"))
    p = fx.primary_catalog(spark, sf).withColumn("name", F.when(odd == 7, ".sync-lock").otherwise(logged))
    r = fx.replica_catalog(spark, sf).withColumn("name", logged)
    locks = r.select("host").distinct().select("host", F.lit(".sync-lock").alias("name"), F.lit(1).cast("bigint").alias("size_bytes"),
                                               F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("mtime"))
    return catalog.mirror_diff(p, r.unionByName(locks))


@register("count_parity", with_views("""
select host, cast(sum(p) as bigint) as n_primary, cast(sum(r) as bigint) as n_replica, sum(p) = sum(r) as counts_match
from (select host, 1 as p, 0 as r from v_primary union all select host, 0, 1 from v_replica) group by host""",
                                     "v_primary", "v_replica"))
def q_count_parity(spark, sf):
    return catalog.count_parity(fx.primary_catalog(spark, sf), fx.replica_catalog(spark, sf))


@register("only_in_primary", with_views("select host, name from v_primary except select host, name from v_replica",
                                        "v_primary", "v_replica"))
def q_only_in_primary(spark, sf):
    return catalog.only_in(fx.primary_catalog(spark, sf), fx.replica_catalog(spark, sf))


@register("in_both", with_views("select host, name from v_primary intersect select host, name from v_replica",
                                "v_primary", "v_replica"))
def q_in_both(spark, sf):
    return catalog.in_both(fx.primary_catalog(spark, sf), fx.replica_catalog(spark, sf))


@register("list_backups", with_views("""
select host, number, name, size_bytes, cast(mtime as date) as date, mtime from (
  select *, row_number() over (partition by host order by mtime desc, name desc) as number from v_primary)
where number <= 20""", "v_primary"))
def q_list_backups(spark, sf):
    return catalog.list_backups(fx.primary_catalog(spark, sf), 20, "mtime")


@register("list_backups_by_name", with_views("""
select host, row_number() over (partition by host order by name desc) as number, name, size_bytes,
       cast(mtime as date) as date, mtime
from v_primary""", "v_primary"))
def q_list_backups_by_name(spark, sf):
    return catalog.list_backups(fx.primary_catalog(spark, sf), None, "name")


@register("latest_backup", with_views("""
select host, arg_max(name, mtime) as name, arg_max(size_bytes, mtime) as size_bytes, max(mtime) as mtime
from v_primary group by host""", "v_primary"))
def q_latest_backup(spark, sf):
    return catalog.latest_backup(fx.primary_catalog(spark, sf), "mtime")


@register("latest_backup_by_name", with_views("""
select host, max(name) as name, arg_max(size_bytes, name) as size_bytes, arg_max(mtime, name) as mtime
from v_primary group by host""", "v_primary"))
def q_latest_backup_by_name(spark, sf):
    return catalog.latest_backup(fx.primary_catalog(spark, sf), "name")


_AGE_H = f"cast(floor((epoch(timestamp '{FRESH_AS_OF}') - floor(epoch(l.mtime))) / 3600) as bigint)"


@register("backup_freshness", with_views(f"""
, l as (select host, arg_max(name, mtime) as name, max(mtime) as mtime from v_primary
        where mtime <= timestamp '{FRESH_AS_OF}' group by host)
, h as (select distinct host from v_status union select 'spare' || cast(c_nationkey as string) from customer)
select h.host, l.name, l.mtime, case when l.mtime is not null then {_AGE_H} end as age_hours,
       case when l.mtime is null then 'no_backups' when {_AGE_H} < 25 then 'ok' else 'warn' end as status
from h left join l on h.host = l.host""", "v_primary", "v_status"))
def q_backup_freshness(spark, sf):
    spare = fx.table(spark, sf, "customer").select(F.concat(F.lit("spare"), F.col("c_nationkey").cast("string")).alias("host"))
    hosts = fx.v_status(spark, sf).select("host").unionByName(spare)
    return catalog.backup_freshness(fx.primary_catalog(spark, sf), hosts, FRESH_AS_OF, 25)


@register("rpo_gaps", with_views("""
select host, prev_name, prev_mtime, name, mtime, cast(floor(epoch(mtime)) - floor(epoch(prev_mtime)) as bigint) as gap_seconds
from (select host, name, mtime, lag(name) over w as prev_name, lag(mtime) over w as prev_mtime
      from v_files window w as (partition by host order by mtime, name))
where mtime > prev_mtime + interval 24 hour""", "v_files"))
def q_rpo_gaps(spark, sf):
    return catalog.rpo_gaps(fx.v_files(spark, sf), 24)


@register("storage_growth", with_views("""
, daily as (select host, cast(mtime as date) as day, cast(sum(size_bytes) as bigint) as bytes from v_files group by all)
select host, day, cast(sum(bytes) over w as bigint) as bytes,
       case when row_number() over w > 1 then cast(sum(bytes) over w - bytes as bigint) end as prev_bytes, cast(1 as integer) as days,
       bytes as growth, bytes > 1073741824 as over_limit
from daily window w as (partition by host order by day)""", "v_files"))
def q_storage_growth(spark, sf):
    return catalog.storage_growth(fx.v_files(spark, sf), added=True)


@register("storage_growth_measured", with_views("""
, daily as (select host, cast(mtime as date) as day, cast(sum(size_bytes) as bigint) as bytes from v_files group by all)
select host, day, bytes, lag(bytes) over w as prev_bytes, cast(day - lag(day) over w as integer) as days,
       bytes - lag(bytes) over w as growth,
       coalesce(bytes - lag(bytes) over w > 104857600 * (day - lag(day) over w), false) as over_limit
from daily window w as (partition by host order by day)""", "v_files"))
def q_storage_growth_measured(spark, sf):
    return catalog.storage_growth(fx.v_files(spark, sf), limit=100 * 1024 ** 2)


@register("missed_runs", with_views("""
, h as (select distinct host from v_status union select 'silent')
, d as (select host, cast(unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day)) as date) as day from h)
select host, day, cast(day as timestamp) + interval 2 hour as slot_ts from d
where not exists (select 1 from v_primary f where f.host = d.host and cast(f.mtime as date) = d.day)""", "v_primary", "v_status"))
def q_missed_runs(spark, sf):
    hosts = fx.v_status(spark, sf).select("host").union(spark.sql("select 'silent' as host"))  # one host without any file
    return catalog.missed_runs(fx.primary_catalog(spark, sf), "2024-01-01", "2024-01-30", hosts, hour=2)


def _age_days(leeway: int = 0) -> str:
    return (f"cast(floor((epoch(timestamp '{PRUNE_AS_OF}') - {leeway} - floor(epoch(mtime))) / 86400) as bigint)")


@register("prune", with_views(f"""
, odd as (select * replace (case when changed and not in_replica then concat('notes-', name) else name end as name),
                 not in_primary as is_link from v_files)
select *, {_age_days()} as age_days from odd
where {_age_days()} > 30 and not is_link and starts_with(name, 'backup-') and ends_with(name, '.tar.gz')""", "v_files"))
def q_prune(spark, sf):
    odd = fx.v_files(spark, sf).withColumns({
        "name": F.when(F.col("changed") & ~F.col("in_replica"), F.concat(F.lit("notes-"), "name")).otherwise(F.col("name")),
        "is_link": ~F.col("in_primary")})
    return catalog.prune(odd, PRUNE_AS_OF, 30)


@register("prune_leeway", with_views(
    f"select *, {_age_days(3600)} as age_days from v_files where starts_with(name, 'backup-manual-') "
    f"and {_age_days(3600)} > 30", "v_files"))
def q_prune_leeway(spark, sf):
    return catalog.prune(fx.v_files(spark, sf), PRUNE_AS_OF, 30, leeway=3600, prefix="backup-manual-")


def _tier_bounds(a: _dt.datetime, daily=7, weekly=4, monthly=12):
    day0 = a.date() - _dt.timedelta(days=daily - 1)
    week0 = a.date() - _dt.timedelta(days=a.weekday()) - _dt.timedelta(weeks=weekly - 1)
    m = a.year * 12 + (a.month - 1) - (monthly - 1)
    return day0, week0, _dt.date(m // 12, m % 12 + 1, 1)


_D0, _W0, _M0 = _tier_bounds(RETENTION_AS_OF)


@register("tiered_retention", with_views(f"""
, e as (select host, name, mtime, cast(mtime as date) as d from v_primary)
, f as (select * from e where mtime <= timestamp '{RETENTION_AS_OF}')
, kd as (select host, arg_max(name, mtime) as name from f where d >= date '{_D0}' group by host, d)
, kw as (select host, arg_max(name, mtime) as name from f where d >= date '{_W0}' group by host, date_trunc('week', d))
, km as (select host, arg_max(name, mtime) as name from f where d >= date '{_M0}' group by host, date_trunc('month', d))
select e.host, e.name, e.mtime, kd.name is not null as keep_daily, kw.name is not null as keep_weekly,
       km.name is not null as keep_monthly, (kd.name is not null or kw.name is not null or km.name is not null
       or e.mtime > timestamp '{RETENTION_AS_OF}') as keep
from e left join kd on e.host = kd.host and e.name = kd.name
left join kw on e.host = kw.host and e.name = kw.name
left join km on e.host = km.host and e.name = km.name""", "v_primary"))
def q_tiered_retention(spark, sf):
    return catalog.tiered_retention(fx.primary_catalog(spark, sf), RETENTION_AS_OF, 7, 4, 12)


@register("volume_sizes", with_views("""
select host, count(*) as n_files, cast(sum(size_bytes) as bigint) as total_bytes from v_files group by host""",
                                     "v_files"))
def q_volume_sizes(spark, sf):
    return catalog.volume_sizes(fx.v_files(spark, sf))


@register("volume_sizes_total", with_views("""
, f as (select host, case when contains(name, '-manual-') then 'manual' else 'scheduled' end as volume, size_bytes from v_files)
select host, volume, cast(2 - (grouping(host) + grouping(volume)) as integer) as level, count(*) as n_files,
       cast(sum(size_bytes) as bigint) as total_bytes
from f group by rollup(host, volume)""", "v_files"))
def q_volume_sizes_total(spark, sf):
    volume = F.when(F.contains("name", F.lit("-manual-")), "manual").otherwise("scheduled")
    return catalog.volume_sizes(fx.v_files(spark, sf).withColumn("volume", volume), ["host", "volume"], totals=True)


# --------------------------------------------------------------------------- fleet

_STATE = """case when status is null or trim(status) = '' then 'missing' when not starts_with(status, 'Up') then 'not_running'
  when contains(status, '(unhealthy)') then 'unhealthy' when contains(status, '(healthy)') then 'healthy' else 'pending' end"""
_CLASSIFIED = f"""
, cs0 as (select *, {_STATE} as state,
                 try_cast(nullif(regexp_extract(status, '^Exited \\((\\d+)\\)', 1), '') as integer) as exit_code
          from v_status)
, cs as (select *, case state when 'healthy' then 0 when 'pending' then 1 else 2 end as severity from cs0)"""


_ACC = ("coalesce(case component when 'web' then http_code in (200, 301, 302) when 'object_store' then http_code in (200, 403) "
        "when 'analytics' then http_code = 200 end, false)")
_FSEV = "coalesce(case component when 'web' then 2 when 'object_store' then 1 when 'analytics' then 1 end, 2)"
_ENDPOINTS = f"""
, ep as (select *, {_ACC} as accepted,
                case when http_code is null then 'no_answer' when {_ACC} then 'ok' else 'failed' end as outcome,
                case when {_ACC} then 0 else {_FSEV} end as severity
         from v_probes)"""


@register("classify_status", with_views(_CLASSIFIED + "\nselect * from cs", "v_status"))
def q_classify_status(spark, sf):
    return fleet.classify_status(fx.v_status(spark, sf))


@register("project_containers", with_views("""
, n as (select *, 'p' || host || case event_id % 3 when 0 then '-' when 1 then '_' else '' end
                  || case event_id % 3 when 2 then '' else container end as name from v_status)
select * from n where name = 'p1' or starts_with(name, 'p1-') or starts_with(name, 'p1_')""", "v_status"))
def q_project_containers(spark, sf):
    sep = F.when(F.col("event_id") % 3 == 0, "-").when(F.col("event_id") % 3 == 1, "_").otherwise("")
    rest = F.when(F.col("event_id") % 3 == 2, "").otherwise(F.col("container"))
    snap = fx.v_status(spark, sf).withColumn("name", F.concat(F.lit("p"), "host", sep, rest))
    return fleet.project_containers(snap, "p1", name="name")


@register("project_containers_label", with_views("select * from v_status where host = '7' and event_id % 4 <> 0", "v_status"))
def q_project_containers_label(spark, sf):
    label = F.when(F.col("event_id") % 4 != 0, F.create_map(F.lit("com.docker.compose.project"), F.col("host")))
    snap = fx.v_status(spark, sf).withColumn("labels", F.coalesce(label, F.create_map(F.lit("other"), F.col("host"))))
    return fleet.project_containers(snap, "7", by="label").drop("labels")


@register("classify_endpoint", with_views(_ENDPOINTS + "\nselect * from ep", "v_probes"))
def q_classify_endpoint(spark, sf):
    return fleet.classify_endpoint(fx.v_probes(spark, sf))


@register("missing_expected", with_views(_ENDPOINTS + f"""
, h as (select distinct host from v_probes)
, want as (select host, unnest([{_sql_list(EXPECTED_COMPONENTS)}]) as name from h)
select host, name from want w
where not exists (select 1 from ep where ep.accepted and ep.host = w.host and ep.component = w.name)""", "v_probes"))
def q_missing_expected(spark, sf):
    probes = fx.v_probes(spark, sf)
    seen = fleet.classify_endpoint(probes).filter("accepted").select("host", F.col("component").alias("name"))
    return fleet.missing_expected(EXPECTED_COMPONENTS, seen, hosts=probes)


def _vparts(col):
    bare = f"regexp_replace(regexp_replace({col}, '^v', ''), '-.*$', '')"
    return (f"case when not regexp_matches({col}, '^v?[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]') then "
            f"list_resize(list_transform(string_split({bare}, '.'), lambda x: coalesce(try_cast(x as integer), -1)), 4, 0) end")


@register("version_drift", with_views(f"""
, p as (select service, pinned, newest, {_vparts('pinned')} as pl, {_vparts('newest')} as nl from v_versions)
, q as (select *, (pl is null or list_contains(pl, -1)) as p_bad, (nl is null or list_contains(nl, -1)) as n_bad from p)
select service, pinned, newest,
       case when newest is null or p_bad or n_bad then 'unknown' when pl = nl then 'latest'
            when pl < nl then 'update_available' else 'ahead' end as status
from q""", "v_versions"))
def q_version_drift(spark, sf):
    v = fx.v_versions(spark, sf)
    return fleet.version_drift(v.select("service", "pinned"), v.filter(F.col("newest").isNotNull()).select("service", "newest"))


@register("ready_services", with_views(_CLASSIFIED + """
, ls as (select host, arg_max(state, snapshot_ts) as state from cs group by host)
select d.service, count(*) as n_deps, count_if(coalesce(ls.state = 'healthy', false)) as n_healthy,
       bool_and(coalesce(ls.state = 'healthy', false)) as ready
from v_deps d left join ls on ls.host = d.depends_on group by d.service""", "v_status", "v_deps"))
def q_ready_services(spark, sf):
    status = fleet.latest_state(fleet.classify_status(fx.v_status(spark, sf)))
    return fleet.ready_services(fx.v_deps(spark, sf), status)


@register("fleet_health", with_views(_CLASSIFIED + _ENDPOINTS + f"""
, csl as (select host, container, arg_max(severity, (snapshot_ts, state)) as severity from cs group by host, container)
, epl as (select host, component, arg_max(severity, (ts, outcome)) as severity,
                 arg_max(http_code is not null, (ts, outcome)) as answered from ep group by host, component)
, gone as (select h.host from (select distinct host from v_status) h, (select unnest(['c0', 'c1', 'c2', 'c3']) as container) w
           where not exists (select 1 from cs where cs.host = h.host and cs.container = w.container))
, le as (select distinct host from v_logs where {_ERR} and ts > timestamp '{LOG_AS_OF}' - interval 86400 second
         and ts <= timestamp '{LOG_AS_OF}')
, l as (select host, max(mtime) as mtime from v_primary where mtime <= timestamp '{FRESH_AS_OF}' group by host)
, h as (select distinct host from v_status)
, fr as (select h.host, case when l.mtime is not null and {_AGE_H} < 25 then 0 else 1 end as severity
         from h left join l on h.host = l.host)
, checks as (select host, severity from csl union all select host, severity from epl
             union all select host, severity from fr union all select host, 2 from gone union all select host, 1 from le
             union all select host, case when answered then 0 else 2 end from epl where component = 'analytics')
select host, max(severity) as worst, count(*) as n_checks, count_if(severity = 2) as n_errors,
       count_if(severity = 1) as n_warnings,
       case when max(severity) >= 2 then 'error' when max(severity) = 1 then 'warning' else 'healthy' end as overall
from checks group by host""", "v_status", "v_probes", "v_primary", "v_logs"))
def q_fleet_health(spark, sf):
    status = fx.v_status(spark, sf)
    fresh = catalog.backup_freshness(fx.primary_catalog(spark, sf), status, FRESH_AS_OF, 25)
    now = fleet.latest_state(fleet.classify_status(status), ["host", "container"], keep=["state", "severity"])
    probes = fleet.latest_state(fleet.classify_endpoint(fx.v_probes(spark, sf)), ["host", "component"], "ts",
                                keep=["outcome", "severity", "http_code"])
    databases = probes.filter("component = 'analytics'").select("host", "ts", "component", F.col("http_code").isNotNull().alias("ok"))
    gone = fleet.missing_expected(["c0", "c1", "c2", "c3"], status, name="container")
    recent = logs.since(logs.error_lines(fx.v_logs(spark, sf)), "ts", LOG_AS_OF, 86400)
    checks = fleet.build_checks(now, probes, freshness=fresh, log_errors=recent, databases=databases, missing=gone)
    return fleet.fleet_health(checks)


# --------------------------------------------------------------------------- configuration

@register("sensitive_keys", with_views(
    "select * from v_config where regexp_matches(line, 'PASSWORD|SECRET|KEY|AUTH') and not starts_with(line, '#')",
    "v_config"))
def q_sensitive_keys(spark, sf):
    return config.sensitive_keys(fx.v_config(spark, sf))


@register("unresolved_refs", with_views("""
select * from (select *, row_number() over (partition by file order by line_no) as rn
               from v_config where contains(line, 'op://')) where rn <= 5""", "v_config"))
def q_unresolved_refs(spark, sf):
    return config.unresolved_refs(fx.v_config(spark, sf), 5)


@register("config_kv", with_views(r"""
, b as (select *, starts_with(ltrim(line), '#') as is_comment, regexp_replace(ltrim(line), '^#\s*', '') as body from v_config)
, k as (select *, nullif(regexp_extract(body, '^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=', 1), '') as key,
               regexp_extract(body, '^(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=(.*)$', 1) as rest from b)
select line_no, file, line, key,
       case when key is null then null
            when starts_with(ltrim(rest), '"') then regexp_extract(rest, '^\s*"([^"]*)"', 1)
            when starts_with(ltrim(rest), '''') then regexp_extract(rest, '^\s*''([^'']*)''', 1)
            else trim(regexp_replace(rest, '\s+#.*$', '')) end as value,
       is_comment
from k""", "v_config"))
def q_config_kv(spark, sf):
    return config.parse_config_lines(fx.v_config(spark, sf))


# --------------------------------------------------------------------------- secrets

# The documented rules, written out for the oracle: rule, severity, pattern, and the part that is held against the allowed forms.
_HEX = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_SCAN_RULES = [
    ("public_key", "High", "pk-lf-" + _HEX, None), ("secret_key", "Critical", "sk-lf-" + _HEX, None),
    ("db_url_password", "Critical", r"postgres(?:ql)?://[^:@/\s]+:[^@\s]+@", r"://[^:@/\s]+:([^@\s]+)@"),
    ("clickhouse_password", "Critical", r"CLICKHOUSE_PASSWORD\s*[=:]\s*\S+", r"[=:]\s*(\S+)"),
    ("object_store_secret", "Critical", r"[A-Z0-9_]*(?:MINIO|S3)_[A-Z0-9_]*SECRET[A-Z0-9_]*\s*[=:]\s*\S+", r"[=:]\s*(\S+)"),
    ("redis_auth", "High", r"REDIS_(?:AUTH|PASSWORD)\s*[=:]\s*\S+", r"[=:]\s*(\S+)"),
    ("encryption_key", "Critical", r"(?:ENCRYPTION_KEY|SALT|NEXTAUTH_SECRET)\s*[=:]\s*\S+", r"[=:]\s*(\S+)"),
    ("private_key", "Critical", "-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----", None),
]
_SCAN_ALLOWED = (r"(regexp_matches(v, '^[\x22\x27]?op://') or regexp_matches(v, '^[\x22\x27]?\$\{[A-Za-z_]\w*\}[\x22\x27]?$') "
                 r"or contains(v, 'your-password-here') or regexp_matches(v, '^[\x22\x27]?PLACEHOLDER_') or contains(v, 'CHANGE_ME') or contains(v, '-test-'))")


def _scan_sql(lines_cte: str, id_cols: str, keep_allowed: bool = False) -> str:
    parts = []
    for rule, sev, pat, vp in _SCAN_RULES:
        value = f"regexp_extract(m, '{vp}', 1)" if vp else "m"
        parts.append(f"select {id_cols}, line_no, line, pos, '{rule}' as rule, '{sev}' as severity, m, {value} as v "
                     f"from (select *, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i: "
                     f"1 + list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i-1], "
                     f"lambda x: len(x))), 0))) as pos from (select *, regexp_extract_all(line, '{pat}', 0) as ms, "
                     f"string_split_regex(line, '{pat}') as gaps from lines where regexp_matches(line, '{pat}')))")
    extra = f", {_SCAN_ALLOWED} as allowed" if keep_allowed else ""
    where = "" if keep_allowed else f"where not {_SCAN_ALLOWED}"
    return (f"{lines_cte}\n, found as ({' union all '.join(parts)})\n"
            f"select {id_cols}, line_no, rule, severity, cast(pos as bigint) as \"offset\", sha256(m) as match_hash{extra}\n"
            f"from found {where}")


_DOC_LINES = """
, s as (select doc_id, string_split(text, chr(10)) as l from v_scan)
, lines as (select doc_id, i as line_no, l[i] as line from s, unnest(range(1, len(l) + 1)) as r(i))"""


@register("scan_secrets", with_views(_scan_sql(_DOC_LINES, "doc_id"), "v_scan"))
def q_scan_secrets(spark, sf):
    return secrets.scan_secrets(fx.v_scan(spark, sf))


@register("scan_secrets_with_allowed", with_views(_scan_sql(_DOC_LINES, "doc_id", keep_allowed=True), "v_scan"))
def q_scan_secrets_with_allowed(spark, sf):
    return secrets.scan_secrets(fx.v_scan(spark, sf), keep_allowed=True)


def _audit_frames(spark, sf):
    hist = secrets.scan_secrets(fx.v_scan(spark, sf)).select(
        F.col("doc_id").cast("string").alias("source_id"), "line_no", "rule", "severity", "offset", "match_hash")
    cfg = fx.v_config(spark, sf)
    cur = secrets.scan_lines(cfg.select(F.col("file").alias("source_id"), "line_no", "line"), ["source_id"])
    conv = fx.table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"), "text")
    pend = secrets.scan_secrets(conv, doc_id="source_id")
    return secrets.audit_union(history=hist, current=cur, pending=pend)


def _audit_sql() -> str:
    hist = _scan_sql(_DOC_LINES, "doc_id")
    cur = _scan_sql("\n, lines as (select file as source_id, line_no, line from v_config)", "source_id")
    pend = _scan_sql("""
, s as (select concat_ws('/', cast(conv_id as varchar), cast(turn as varchar)) as source_id,
               string_split(text, chr(10)) as l from conversations)
, lines as (select source_id, i as line_no, l[i] as line from s, unnest(range(1, len(l) + 1)) as r(i))""",
                     "source_id")

    def wrap(scope, body, idexpr):
        # body is "<ctes>\nselect ..."; turn it into a subquery with its own WITH
        return (f"select '{scope}' as scope, {idexpr} as source_id, line_no, rule, severity, \"offset\", match_hash "
                f"from (with dummy as (select 1) {body})")

    return with_views(
        ", audit as (" + wrap("history", hist, "cast(doc_id as varchar)") + " union all "
        + wrap("current", cur, "source_id") + " union all " + wrap("pending", pend, "source_id") + ")\n"
        "select * from audit", "v_scan", "v_config")


@register("audit_union", _audit_sql())
def q_audit_union(spark, sf):
    return _audit_frames(spark, sf)


@register("findings_summary", _audit_sql().replace(
    "select * from audit",
    "select scope, rule, severity, count(*) as n_findings, count(distinct source_id) as n_sources from audit group by all"))
def q_findings_summary(spark, sf):
    return secrets.findings_summary(_audit_frames(spark, sf))


# --------------------------------------------------------------------------- releases

_CONVENTIONAL = r"^([A-Za-z]+)(\(([^)]*)\))?(!)?: (.+)$"


def _changelog_sql() -> str:
    return with_views(rf"""
, c as (select event_id, ts, tag, split_part(message, chr(10), 1) as h, coalesce(body, '') as b from v_commits)
, k as (select *, case when starts_with(h, 'feat') then 0 when starts_with(h, 'fix') then 1 when starts_with(h, 'doc') then 3
                       when starts_with(h, 'perf') then 4 when starts_with(h, 'refactor') then 2 when starts_with(h, 'style') then 5
                       when starts_with(h, 'test') then 6 when starts_with(h, 'chore(release): prepare for') then -1
                       when regexp_matches(h, '^chore\(deps.*\)') then -1 when starts_with(h, 'chore(pr)') then -1
                       when starts_with(h, 'chore(pull)') then -1 when starts_with(h, 'chore') or starts_with(h, 'ci') then 7
                       when contains(b, 'security') then 8 when starts_with(h, 'revert') then 9 else 10 end as group_no
        from c where regexp_matches(h, '{_CONVENTIONAL}'))
, d as (select *, regexp_replace(regexp_replace(regexp_extract(h, '{_CONVENTIONAL}', 5), '\((\w+\s)?#([0-9]+)\)', '([#\2]({REPO_URL}/issues/\2))', 'g'),
                                 'PR #([0-9]+)', '[PR #\1]({REPO_URL}/pull/\1)', 'g') as descr
        from k where group_no >= 0)
select event_id, ts, coalesce(tag, 'Unreleased') as release, regexp_replace(tag, '^v', '') as version, group_no,
       ['Features', 'Bug Fixes', 'Refactor', 'Documentation', 'Performance', 'Styling', 'Testing', 'Miscellaneous Tasks',
        'Security', 'Revert', 'Other'][group_no + 1] as group_name,
       nullif(regexp_extract(h, '{_CONVENTIONAL}', 3), '') as scope,
       (regexp_extract(h, '{_CONVENTIONAL}', 4) = '!' or contains(b, 'BREAKING CHANGE')) as breaking,
       upper(left(descr, 1)) || substr(descr, 2) as description,
       row_number() over (partition by coalesce(tag, 'Unreleased'), group_no order by ts, event_id) as position
from d""", "v_commits")


@register("changelog", _changelog_sql())
def q_changelog(spark, sf):
    return releases.changelog(fx.v_commits(spark, sf), REPO_URL, body="body")


@register("release_pairs", with_views(f"""
, t as (select tag, max(ts) as tag_ts from v_commits where tag is not null group by tag)
select tag, regexp_replace(tag, '^v', '') as version, tag_ts, lag(tag) over (order by tag_ts, tag) as previous,
       case when lag(tag) over (order by tag_ts, tag) is not null
            then '{REPO_URL}/compare/' || lag(tag) over (order by tag_ts, tag) || '..' || tag end as compare_url
from t""", "v_commits"))
def q_release_pairs(spark, sf):
    return releases.release_pairs(fx.v_commits(spark, sf), REPO_URL)


# --------------------------------------------------------------------------- parsing halves of the sources

def _stamp(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@register("parse_bracketed_logs", """
select event_id, case event_id % 4 when 0 then ts_s when 3 then ts_s end as ts,
       case event_id % 4 when 0 then 'ERROR' when 3 then 'INFO' end as level,
       case event_id % 4 when 1 then '[Step 3/10] ' || event_type when 2 then '=====' else event_type end as text
from (select *, date_trunc('second', ts) as ts_s from events)""")
def q_parse_bracketed_logs(spark, sf):
    ev = fx.table(spark, sf, "events")
    line = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), _stamp(), F.lit("] ERROR: "), "event_type"))
            .when(F.col("event_id") % 4 == 1, F.concat(F.lit("[Step 3/10] "), "event_type"))
            .when(F.col("event_id") % 4 == 2, F.lit("====="))
            .otherwise(F.concat(F.lit("["), _stamp(), F.lit("] INFO: "), "event_type")))
    return parse_bracketed_logs(ev.select("event_id", line.alias("message"))).drop("message")


@register("parse_service_lines", """
select 'svc' || (user_id % 5) as service, case when event_id % 3 = 0 then event_type else
         strftime(ts, '%Y-%m-%d') || case when event_id % 3 = 1 then ' ' else 'T' end || strftime(ts, '%H:%M:%S') || ' ' || event_type end as message,
       '/logs/svc' || (user_id % 5) || '/current' as path, case when event_id % 3 <> 0 then date_trunc('second', ts) end as ts
from events""")
def q_parse_service_lines(spark, sf):
    ev = fx.table(spark, sf, "events")
    value = (F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
             .when(F.col("event_id") % 3 == 1, F.concat(_stamp(), F.lit(" "), "event_type"))
             .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), "event_type")))
    path = F.concat(F.lit("/logs/svc"), (F.col("user_id") % 5).cast("string"), F.lit("/current"))
    return parse_service_lines(ev.select(value.alias("value"), path.alias("path")))


@register("container_stats", """
select event_id, event_id % 100 + 0.5::double as cpu_pct,
       cast(case when event_id % 2 = 0 then (event_id % 7 + 1.5) * 1073741824 else (event_id % 500) * 1048576 end as bigint) as mem_used_bytes,
       cast(8589934592 as bigint) as mem_limit_bytes
from events""")
def q_container_stats(spark, sf):
    n = F.col("event_id")
    used = F.when(n % 2 == 0, F.concat((n % 7 + 1).cast("string"), F.lit(".5GiB"))).otherwise(F.concat((n % 500).cast("string"), F.lit("MiB")))
    text = fx.table(spark, sf, "events").select(
        "event_id", F.concat((n % 100).cast("string"), F.lit(".5%")).alias("cpu_text"), F.concat(used, F.lit(" / 8GiB")).alias("mem_text"))
    return parse_container_stats(text).drop("cpu_text", "mem_text")


@register("container_fields", """
select event_id, case when event_id % 10 = 0 then 3600 else (event_id % 50 + 1) * 60 end as age_seconds,
       case when event_id % 3 > 0 then 'ghcr.io' end as registry, case when event_id % 3 > 0 then 'acme/app' || (user_id % 5) else 'redis' end as repository,
       case when event_id % 3 = 1 then '7.' || (event_id % 9) else 'latest' end as tag,
       cast(event_id % 4 + 2 as integer) as n_ports, case when event_id % 5 = 0 then null else event_id % 5 = 1 end as flag,
       case when event_id % 5 = 2 then event_id end as number
from events""")
def q_container_fields(spark, sf):
    """SF3, SF6, SF7 and SF15 over rendered container listings."""
    n = F.col("event_id")
    age = F.when(n % 10 == 0, F.lit("About an hour ago")).otherwise(F.concat((n % 50 + 1).cast("string"), F.lit(" minutes ago")))
    app = F.concat(F.lit("ghcr.io/acme/app"), (F.col("user_id") % 5).cast("string"))
    image = F.when(n % 3 == 0, F.lit("redis")).when(n % 3 == 1, F.concat(app, F.lit(":7."), (n % 9).cast("string"))).otherwise(app)
    ports = F.concat(F.lit("0.0.0.0:7000-"), (7000 + n % 4).cast("string"), F.lit("->7000-"), (7000 + n % 4).cast("string"), F.lit("/tcp, 9000/udp"))
    flag = F.when(n % 5 == 0, F.lit("maybe")).when(n % 5 == 1, F.lit("Yes")).otherwise(F.lit("off"))
    parts = fn.image_parts(image)
    return fx.table(spark, sf, "events").select(
        "event_id", fn.relative_age_seconds(age).alias("age_seconds"), parts["registry"].alias("registry"),
        parts["repository"].alias("repository"), parts["tag"].alias("tag"), F.size(fn.port_rows(ports)).alias("n_ports"),
        fn.setting_value(flag, "bool").alias("flag"),
        fn.setting_value(F.when(n % 5 == 2, n.cast("string")).otherwise(F.lit("x1"))).alias("number"))


@register("strip_tags", r"""
select page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g')) as text from pages""")
def q_strip_tags(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", fn.strip_tags("html").alias("text"))


# The queries of these modules are registered when they are read.
from . import landing, summaries  # noqa: E402, F401

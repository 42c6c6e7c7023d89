"""Trace and span operators: FL3, FL9, FL10, JN1, JN2, JN8, AG8, AG14-AG16, SS5 (batch)."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import id_hex, json_field

# The slow-call threshold (ms) and the default head-sampling ratio.
SLOW_CALL_MS = 5000
SAMPLE_RATIO = 0.1


def slow_calls(df: DataFrame, ms: float = SLOW_CALL_MS, latency: str = "latency_ms",
               model: str | None = None, model_col: str = "model") -> DataFrame:
    """FL3: latency strictly above ``ms``; optional exact model match."""
    cond = F.col(latency) > F.lit(ms)
    if model is not None:
        cond = cond & (F.col(model_col) == F.lit(model))
    return df.filter(cond)


def drop_short_spans(spans: DataFrame, min_ms: float = 10, duration: str = "duration_ms") -> DataFrame:
    """FL9: keep spans of at least ``min_ms``."""
    return spans.filter(F.col(duration) >= F.lit(min_ms))


def sample_threshold(ratio: float) -> int:
    """Smallest 60-bit key that is *not* sampled: ``ceil(ratio * 2**60)``, exactly."""
    x = Fraction(str(ratio)) * (1 << 60)
    return -(-x.numerator // x.denominator)


def sample_key(trace_id: str = "trace_id"):
    """Low 60 bits of a 32-hex trace id, as a bigint."""
    return F.conv(F.substring(id_hex(trace_id), 18, 15), 16, 10).cast("bigint")


def ratio_sample(df: DataFrame, ratio: float = SAMPLE_RATIO, trace_id: str = "trace_id") -> DataFrame:
    """FL10: deterministic head sampling by trace id, so all spans of a trace agree."""
    return df.filter(sample_key(trace_id) < F.lit(sample_threshold(ratio)))


def _tempo_id(traces: DataFrame, metadata: str, key: str):
    return id_hex(json_field(traces, metadata, key))


def correlate(traces: DataFrame, other: DataFrame, other_id: str = "trace_id", metadata: str = "metadata",
              link_key: str = "tempo_trace_id", trace_cols: Sequence[str] = ("seq", "trace_id")) -> DataFrame:
    """JN1: link traces to another source by the id kept in their metadata.

    The other side is reduced to one row per id first (partial aggregation),
    so the full outer join is one-to-one and a hot id cannot multiply rows.
    Unmatched rows of both sides are reported.
    """
    t = traces.select(*trace_cols, _tempo_id(traces, metadata, link_key).alias("link_id"))
    o = other.groupBy(id_hex(other_id).alias("link_id")).agg(F.count(F.lit(1)).alias("n_linked"))
    # Null ids match nothing; set aside, they do not meet in one partition of the outer join.
    known = t.filter(F.col("link_id").isNotNull()).join(o.filter(F.col("link_id").isNotNull()), "link_id", "full_outer")
    loose_t = t.filter(F.col("link_id").isNull()).select("link_id", *trace_cols, F.lit(None).cast("bigint").alias("n_linked"))
    loose_o = o.filter(F.col("link_id").isNull()).select("link_id", *[F.lit(None).cast(t.schema[c].dataType).alias(c) for c in trace_cols], "n_linked")
    j = known.select("link_id", *trace_cols, "n_linked").unionByName(loose_t).unionByName(loose_o)
    return j.select("link_id", *trace_cols, F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                    F.col(trace_cols[-1]).isNotNull().alias("in_traces"),
                    F.col("n_linked").isNotNull().alias("in_other"))


def slow_trace_metrics(traces: DataFrame, metrics: DataFrame, ms: float = SLOW_CALL_MS,
                       latency: str = "latency_ms", metadata: str = "metadata",
                       link_key: str = "tempo_trace_id", metric_id: str = "trace_id") -> DataFrame:
    """JN2: the metric samples of every slow trace (a semi join, so no duplicates)."""
    slow = slow_calls(traces, ms, latency).select(_tempo_id(traces, metadata, link_key).alias("_id"))
    return metrics.join(slow, id_hex(metric_id) == F.col("_id"), "left_semi")


def correlate_by_time(calls: DataFrame, metrics: DataFrame, bucket: str = "1 hour",
                      keys: Sequence[str] = (), call_ts: str = "start_ts", metric_ts: str = "ts",
                      cpu: str = "cpu_pct", mem: str = "mem_used_bytes") -> DataFrame:
    """JN8: each call with the infrastructure state of its time bucket (and keys).

    The range condition "same bucket" is an equi-join on ``window().start``.
    Metrics are aggregated per (keys, bucket) before the join, so the join is
    many-to-one and never emits pairs of raw rows.
    """
    m = metrics.groupBy(*keys, F.window(metric_ts, bucket).start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(cpu).alias("avg_cpu_pct"),
        F.max(mem).alias("max_mem_bytes"))
    c = calls.withColumn("bucket_start", F.window(call_ts, bucket).start)
    return c.join(m, [*keys, "bucket_start"], "left")


def loop_traces(spans: DataFrame, name: str = "memory_search", limit: int = 10, match: str = "exact",
                name_col: str = "name", trace_id: str = "trace_id") -> DataFrame:
    """AG8: traces with strictly more than ``limit`` spans of that name."""
    hit = F.col(name_col) == F.lit(name) if match == "exact" else F.col(name_col).contains(name)
    g = spans.groupBy(trace_id).agg(F.count_if(hit).alias("n_spans"))
    return g.filter(F.col("n_spans") > limit)


def token_coverage(obs: DataFrame, keys: Sequence[str] = (), tokens: str = "tokens",
                   target: float = 1.0) -> DataFrame:
    """AG14: share of rows with tokens recorded; the target is 100 %, judged on the counts."""
    g = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(tokens).alias("n_with_tokens"))
    return g.select("*", (F.col("n_with_tokens") / F.col("n_rows")).alias("coverage"),
                    (F.col("n_with_tokens") >= F.col("n_rows") * F.lit(target)).alias("target_met"))


# The dashboard latency target (ms).
LATENCY_TARGET_MS = 2000


def latency_targets(df: DataFrame, ms: float = LATENCY_TARGET_MS, latency: str = "latency_ms",
                    keys: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """AG15: share below the target, p50 and p95.

    Percentiles are approximate with bounded memory (``percentile_approx``).
    ``exact`` first counts equal latencies in parallel and then interpolates
    over the counts; use it while the number of distinct latencies is bounded
    (e.g. whole milliseconds).
    """
    if exact:
        counted = df.groupBy(*keys, latency).agg(F.count(F.lit(1)).alias("_n"))
        pct = lambda p: F.percentile(F.col(latency), p, F.col("_n"))
        return counted.groupBy(*keys).agg(
            F.sum("_n").alias("n"),
            (F.sum(F.when(F.col(latency) < ms, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share_below"),
            pct(0.5).cast("double").alias("p50"),
            pct(0.95).cast("double").alias("p95"))
    pct = lambda p: F.percentile_approx(latency, p, 10000)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(latency) < ms) / F.count(F.lit(1))).alias("share_below"),
        pct(0.5).cast("double").alias("p50"),
        pct(0.95).cast("double").alias("p95"))
    return g


def attribute_hygiene(spans: DataFrame, required: Sequence[str], attributes: str = "attributes",
                      exact: bool = False) -> DataFrame:
    """AG16 (attributes): per required attribute key, all spans, those without it, and distinct values.

    A span is without a key when its map is null, lacks the key, or holds a null
    for it.  Distinct values are counted by ``approx_count_distinct``
    (HyperLogLog++, fixed memory per key) unless ``exact``.
    """
    one = lambda k: F.struct(F.lit(k).alias("key"), F.try_element_at(F.col(attributes), F.lit(k)).alias("value"))
    kv = spans.select(F.inline(F.array(*[one(k) for k in required])))
    distinct = F.countDistinct("value") if exact else F.approx_count_distinct("value")
    return kv.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        distinct.alias("n_distinct"))


def bad_ids(spans: DataFrame, trace_id: str = "trace_id", span_id: str = "span_id") -> DataFrame:
    """AG16 (ids): spans whose ids are not 32 / 16 lower-case hex characters."""
    ok_t = F.coalesce(F.col(trace_id).rlike("^[0-9a-f]{32}$"), F.lit(False))
    ok_s = F.coalesce(F.col(span_id).rlike("^[0-9a-f]{16}$"), F.lit(False))
    return spans.filter(~ok_t | ~ok_s).withColumn("bad_trace_id", ~ok_t).withColumn("bad_span_id", ~ok_s)


def merge_trace_updates(updates: DataFrame, trace_id: str = "trace_id", key: str = "meta_key",
                        value: str = "meta_value", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """SS5 (batch): last write per (trace, key) wins, by (ts, seq).

    ``max_by`` is a partial aggregate, so a trace with many updates is
    combined map-side.  One row per (trace, key); see ``as_metadata_map``.
    Updates without a trace, a key or a time take no part.
    """
    g = updates.filter(F.col(trace_id).isNotNull() & F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(trace_id, key).agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(ts).alias("t")), F.struct(ts, seq)).alias("_w"))
    return g.select(trace_id, key, F.col("_w.v").alias(value), F.col("_w.t").alias("updated_ts"))


def as_metadata_map(merged: DataFrame, trace_id: str = "trace_id", key: str = "meta_key",
                    value: str = "meta_value") -> DataFrame:
    """Fold merged pairs into one ``map<string,string>`` per trace."""
    return merged.groupBy(trace_id).agg(
        F.map_from_entries(F.collect_list(F.struct(key, value))).alias("metadata"))

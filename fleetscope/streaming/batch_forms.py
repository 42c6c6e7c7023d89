"""Streaming operators that are also valid on a batch DataFrame (SS1-SS4).

On a stream they watermark the event time (cast to ``timestamp``, which a
watermark requires); on a batch the same plan runs without a watermark, so
stream-equals-batch tests compare one function with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import base_name
from ..operators.logs import error_lines


def event_time(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Cast ``ts`` to TIMESTAMP and watermark it when ``df`` is a stream."""
    if not df.isStreaming:
        return df
    if not isinstance(df.schema[ts].dataType, T.TimestampType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark or "10 minutes")


def live_errors(spark: SparkSession, path: str, service_from: str = "parent") -> DataFrame:
    """SS1: follow every service log file under ``path`` and keep error lines.

    The service is the log file's parent folder (``service_from='parent'``)
    or its base name without extension (``'file'``).
    """
    raw = spark.readStream.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.col("path"), "/")
    service = (F.element_at(parts, -2) if service_from == "parent"
               else F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", ""))
    lines = raw.select(service.alias("service"), F.col("value").alias("message"), "path")
    return error_lines(lines)


def error_alerts(logs: DataFrame, window: str = "5 minutes", watermark: str | None = None,
                 min_count: int = 1, ts: str = "ts", service: str = "service") -> DataFrame:
    """SS2: error count per service and tumbling window; rows at or above ``min_count``."""
    df = event_time(logs, ts, watermark)
    g = error_lines(df).groupBy(service, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n_errors"))
    return g.filter(F.col("n_errors") >= min_count).select(
        service, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_errors")


def ingest_events(events: DataFrame, watermark: str = "1 hour", key: str = "event_id", ts: str = "ts") -> DataFrame:
    """SS3: landing events -> clean table; a repeated id inside the watermark is dropped.

    On a batch the earliest row of an id (by time, then by content) is the one kept.
    """
    df = event_time(events, ts, watermark)
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark([key])
    rest = [c for c in df.columns if c not in (key, ts)]
    first = df.groupBy(key).agg(F.min(F.struct(ts, *rest)).alias("_f"))
    return first.select(*[F.col(c) if c == key else F.col(f"_f.{c}").alias(c) for c in df.columns])


def correlate_stream(traces: DataFrame, spans: DataFrame, max_gap: str = "1 hour", watermark: str | None = None,
                     trace_id: str = "trace_id", trace_ts: str = "ts", span_ts: str = "start_ts",
                     how: str = "inner") -> DataFrame:
    """SS4: spans joined to their trace by id when within ``max_gap`` of the trace time.

    Both sides are watermarked; the time-range condition lets Spark drop
    join state once the watermark passes.  With ``how="full_outer"`` (or
    ``left_outer`` for traces, ``right_outer`` for spans) rows that found no
    partner come out once, when the watermark rules out a later one; ``in_traces``
    and ``in_spans`` say which side a row has.  Rows without an id or a time can
    have no partner; they are given at once and kept out of the join's state.
    """
    t = event_time(traces, trace_ts, watermark).select(F.col(trace_id).alias("t_trace_id"),
                                                      F.col(trace_ts).alias("trace_ts"),
                                                      *[c for c in traces.columns if c not in (trace_id, trace_ts)])
    s = event_time(spans, span_ts, watermark)
    gap = F.expr(f"INTERVAL {max_gap}")
    cond = ((F.col("t_trace_id") == F.col(trace_id)) & (F.col(span_ts) >= F.col("trace_ts") - gap)
            & (F.col(span_ts) <= F.col("trace_ts") + gap))
    if how == "inner":
        return t.join(s, cond, "inner").drop("t_trace_id")
    if how not in ("full_outer", "left_outer", "right_outer"):
        raise ValueError(how)
    t_known, s_known = F.col("t_trace_id").isNotNull() & F.col("trace_ts").isNotNull(), F.col(trace_id).isNotNull() & F.col(span_ts).isNotNull()
    out = t.filter(t_known).join(s.filter(s_known), cond, how)

    def alone(side: DataFrame, other: DataFrame) -> DataFrame:
        return side.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema]).select(out.columns)

    flags = lambda df, a, b: df.withColumns({"in_traces": a, "in_spans": b})
    # A matched or unmatched row of the join has a time on each side that is there.
    parts = [flags(out, F.col("trace_ts").isNotNull(), F.col(span_ts).isNotNull())]
    if how != "right_outer":
        parts.append(flags(alone(t.filter(~t_known), s), F.lit(True), F.lit(False)))
    if how != "left_outer":
        parts.append(flags(alone(s.filter(~s_known), t), F.lit(False), F.lit(True)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.withColumn(trace_id, F.coalesce(F.col(trace_id), F.col("t_trace_id"))).drop("t_trace_id")

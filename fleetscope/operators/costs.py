"""Cost operators: JN3 (flagship), JN9, AG7, AG18."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import id_hex, json_field, link
from .metrics import counter_delta, exact_sum

# Infrastructure price in $ per cpu-hour, and the cost tolerance.
CPU_HOUR_PRICE = 0.024
COST_TOLERANCE = 0.05


def trace_cpu_increase(cpu: DataFrame, trace_id: str = "trace_id", ts: str = "ts",
                       value: str = "value", series: Sequence[str] = ()) -> DataFrame:
    """Reset-corrected cpu-seconds increase per trace (the whole trace as one bucket).

    ``series`` names the columns that tell a trace's counters apart (containers,
    instances): deltas are taken per (trace, series) and then summed per trace.
    Samples without a trace id belong to no trace and are left out.
    """
    d = counter_delta(cpu.filter(F.col(trace_id).isNotNull()), [trace_id, *series], ts, value)
    inc = exact_sum(d, "delta")
    return d.groupBy(id_hex(trace_id).alias("link_id")).agg(
        F.coalesce(inc, F.lit(0)).alias("cpu_seconds"),
        F.count(F.lit(1)).alias("n_samples"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def attribute_cost(traces: DataFrame, cpu: DataFrame, price: float = CPU_HOUR_PRICE,
                   mode: str = "cpu_hours", metadata: str = "metadata", link_key: str = "tempo_trace_id",
                   trace_id: str = "trace_id", cost: str = "total_cost", series: Sequence[str] = (),
                   trace_url: str = "/trace/", explore_url: str = "/explore?traceID=") -> DataFrame:
    """JN3: per trace ``llm_cost``, ``infra_cost``, ``total_cost`` and two links.

    ``mode='cpu_hours'`` prices the cpu-seconds increase as cpu-hours
    (``increase / 3600 * price``); ``mode='as_written'`` multiplies the
    average rate over the trace's samples by the price, as the documented
    formula does.  Traces without samples keep ``infra_found = false`` and
    an infrastructure cost of 0 (left join, no error).  Costs keep the scale of
    their input.  Traces without a linked id do not take part in the join, so
    they never meet in one partition.
    """
    inc = trace_cpu_increase(cpu, series=series)
    t = traces.select(F.col(trace_id).alias("trace_id"), F.col(cost).alias("llm_cost"),
                      id_hex(json_field(traces, metadata, link_key)).alias("link_id"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in inc.schema if f.name != "link_id"]
    j = (t.filter(F.col("link_id").isNotNull()).join(inc, "link_id", "left")
         .unionByName(t.filter(F.col("link_id").isNull()).select("*", *none)))
    secs = F.col("cpu_seconds").cast("double")
    if mode == "cpu_hours":
        infra = secs * F.lit(price) / F.lit(3600)
    elif mode == "as_written":
        span = (F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")).cast("double")
        infra = F.when(span > 0, secs / span * F.lit(price))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    infra_cost = F.coalesce(infra, F.lit(0.0))
    return j.select(
        "trace_id", F.col("link_id").alias("tempo_trace_id"), "llm_cost",
        F.coalesce("cpu_seconds", F.lit(0).cast(inc.schema["cpu_seconds"].dataType)).alias("cpu_seconds"),
        infra_cost.alias("infra_cost"),
        (F.col("llm_cost").cast("double") + infra_cost).alias("total_cost"),
        F.col("n_samples").isNotNull().alias("infra_found"),
        link(trace_url, F.col("trace_id")).alias("trace_url"),
        link(explore_url, F.col("link_id")).alias("explore_url"))


def reconcile_cost(tracked: DataFrame, actual: DataFrame, key: str = "model", tracked_col: str = "tracked_cost",
                   actual_col: str = "actual_cost", tol: float = COST_TOLERANCE) -> DataFrame:
    """JN9: ``abs(t - a) / a <= tol``; missing or zero actual cost is flagged."""
    j = tracked.join(actual, key, "full_outer")
    t, a = F.col(tracked_col).cast("double"), F.col(actual_col).cast("double")
    rel = F.when(a != 0, F.abs(t - a) / a)
    status = (F.when(a.isNull(), "missing_actual").when(t.isNull(), "missing_tracked")
              .when(a == 0, "zero_actual").when(rel <= tol, "ok").otherwise("mismatch"))
    return j.select(key, F.col(tracked_col), F.col(actual_col),
                    rel.alias("rel_diff"), status.alias("status"))


def tracked_cost(obs: DataFrame, key: str = "model", cost: str = "cost") -> DataFrame:
    """Tracked cost per key, summed exactly."""
    return obs.groupBy(key).agg(exact_sum(obs, cost).alias("tracked_cost"))


def usage_daily(obs: DataFrame, keys: Sequence[str] = ("model",), ts: str = "ts", tokens: str = "tokens",
                cost: str = "cost") -> DataFrame:
    """AG7: calls, tokens and cost per day and key."""
    return obs.groupBy(F.to_date(ts).alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(tokens).cast("bigint").alias("tokens"),
        exact_sum(obs, cost).alias("cost"))


def score_summary(scores: DataFrame, keys: Sequence[str] = ("source",), name: str = "name",
                  value: str = "value") -> DataFrame:
    """AG18: mean, count and share positive per score name and group."""
    return scores.groupBy(name, *keys).agg(
        F.count(value).alias("n"),
        F.avg(F.col(value).cast("double")).alias("mean"),
        (F.count_if(F.col(value) > 0) / F.count(value)).alias("share_positive"))

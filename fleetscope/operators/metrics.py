"""Counter and gauge operators: WN1, AG1-AG6, FL4, JN10, AG13.

Rate semantics: deltas between successive samples of a series, reset
corrected (after a drop the new value is the delta), not extrapolated.  Each
delta belongs to the bucket of its later sample; buckets are ``[start, end)``
as ``window()`` makes them, so buckets add up to the total increase.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import epoch_seconds, lag_in_series, running_sums, time_chunk

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

_UNITS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
          "day": 86400, "days": 86400}


def duration_seconds(text: str) -> int:
    """'5 minutes' -> 300."""
    n, unit = text.split()
    return int(n) * _UNITS[unit.lower()]


def exact_sum(df: DataFrame, col: str):
    """Sum that keeps the input's scale: decimals sum to ``decimal(38, scale)``, other types as Spark sums them."""
    t = df.schema[col].dataType
    s = F.sum(col)
    return s.cast(T.DecimalType(38, t.scale)) if isinstance(t, T.DecimalType) else s


def with_label(metrics: DataFrame, label: str, labels: str = "labels", series: str = "series") -> DataFrame:
    """Samples with a label map made joinable: the label as a column, and the whole label set as a series key.

    The series key is the sorted list of the map's entries, because maps cannot be grouped by.
    """
    return metrics.withColumns({label: F.try_element_at(F.col(labels), F.lit(label)),
                                series: F.array_sort(F.map_entries(labels))})


def counter_delta(metrics: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value",
                  chunk_seconds: int = 86400) -> DataFrame:
    """WN1: ``prev_value``, ``delta`` and ``is_reset`` for every sample.

    The first sample of a series has no delta.  A drop is a reset, and the
    delta is then the new value.  A null value is no sample: it has no row, and
    the next delta reaches over it.
    """
    lagged = lag_in_series(metrics.filter(F.col(value).isNotNull()), series, [ts], [value], chunk_seconds=chunk_seconds)
    v, p = F.col(value), F.col("prev_" + value)
    vtype = metrics.schema[value].dataType
    delta = F.when(p.isNull(), F.lit(None)).when(v >= p, v - p).otherwise(v).cast(vtype)
    return lagged.drop("prev_" + ts).withColumns(
        {"delta": delta, "is_reset": F.when(p.isNull(), F.lit(None)).otherwise(v < p)})


def counter_increase(metrics: DataFrame, series: Sequence[str], window: str = "1 hour",
                     step: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """AG1: reset-corrected increase per series and ``[start, end)`` bucket.

    A bucket with no delta yields no row.  ``step`` makes stepped (sliding)
    buckets (see ``_stepped``).
    """
    d = counter_delta(metrics, series, ts, value).filter(F.col("delta").isNotNull())
    if step and not isinstance(d.schema["delta"].dataType, (T.FloatType, T.DoubleType)):
        return _stepped(d, series, window, step, ts)
    # Binary floats are summed bucket by bucket: a running sum that is taken back would leave rounding behind.
    w = F.window(ts, window, step) if step else F.window(ts, window)
    g = d.groupBy(*series, w.alias("w")).agg(exact_sum(d, "delta").alias("increase"))
    return g.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "increase")


def _stepped(deltas: DataFrame, series: Sequence[str], window: str, step: str, ts: str) -> DataFrame:
    """Increase per stepped bucket, each delta touched twice instead of ``window / step`` times.

    A delta enters at the first bucket that holds it and leaves after the last.
    Deltas that enter (leave) at the same bucket are added up before the shuffle,
    so at most two rows per pane move; running sums over these rows give the
    increase of every bucket up to the next change, and the buckets in between
    are written out in place.  Both running sum and lag work chunk by chunk, so a
    hot series is never one task.
    """
    size, hop = duration_seconds(window), duration_seconds(step)
    at, pane = epoch_seconds(ts), math.gcd(size, hop)
    first = (F.ceil((F.floor(at / pane) * pane + pane - size) / hop) * hop).cast("bigint")
    last = (F.floor(at / hop) * hop).cast("bigint")
    kind = deltas.groupBy().agg(exact_sum(deltas, "delta").alias("v")).schema["v"].dataType
    one = F.lit(1).cast("bigint")
    ends = F.array(F.struct(first.alias("_at"), F.col("delta").cast(kind).alias("_v"), one.alias("_n")),
                   F.struct((last + hop).alias("_at"), (-F.col("delta")).cast(kind).alias("_v"), (-one).alias("_n")))
    changes = (deltas.filter(first <= last).select(*series, F.inline(ends))
               .groupBy(*series, "_at").agg(F.sum("_v").cast(kind).alias("_v"), F.sum("_n").alias("_n")))
    chunk = F.floor(F.col("_at") / F.lit(max(86400, 16 * hop)))
    run = running_sums(changes, series, ["_at"], {"_sum": "_v", "_count": "_n"}, chunk=chunk)
    run = lag_in_series(run, series, ["_at"], [], chunk=chunk)
    held = run.filter((F.col("_count") - F.col("_n")) > 0).select(
        *series, (F.col("_sum") - F.col("_v")).cast(kind).alias("increase"),
        F.explode(F.sequence("prev__at", F.col("_at") - hop, F.lit(hop).cast("bigint"))).alias("_at"))
    ntz = isinstance(deltas.schema[ts].dataType, T.TimestampNTZType)
    when = lambda c: F.timestamp_add("SECOND", c, F.expr(_EPOCH_NTZ)) if ntz else F.timestamp_seconds(c)
    return held.select(*series, when(F.col("_at")).alias("window_start"), when(F.col("_at") + size).alias("window_end"), "increase")


def counter_rate(metrics: DataFrame, series: Sequence[str], window: str = "5 minutes",
                 step: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """AG2: increase divided by the window length in seconds (per second)."""
    secs = duration_seconds(window)
    inc = counter_increase(metrics, series, window, step, ts, value)
    return (inc.withColumn("window_seconds", F.lit(secs))
            .withColumn("rate", F.col("increase").cast("double") / F.lit(secs)))


def sum_by(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    """AG3: rates first, then the sum by ``by`` per window.

    Within one window every series shares the divisor, so the sum of rates
    is the exact sum of increases over the window length; summing the decimal
    increases keeps the result independent of row order.
    """
    g = rates.groupBy(*by, "window_start", "window_end", "window_seconds").agg(
        exact_sum(rates, "increase").alias("_inc"))
    return g.select(*by, "window_start", "window_end",
                    (F.col("_inc").cast("double") / F.col("window_seconds")).alias("rate"))


def cost_per_hour(metrics: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """AG4: ``sum(rate[1h]) * 3600`` per hour, i.e. the summed hourly increase."""
    inc = counter_increase(metrics, series, "1 hour", None, ts, value)
    return inc.groupBy("window_start", "window_end").agg(
        exact_sum(inc, "increase").alias("cost_per_hour"))


def daily_cost(metrics: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """AG5: ``sum(increase[24h])`` per day."""
    inc = counter_increase(metrics, series, "1 day", None, ts, value)
    return inc.groupBy("window_start", "window_end").agg(
        exact_sum(inc, "increase").alias("daily_cost"))


def infra_cost(cpu: DataFrame, series: Sequence[str], price: float = 0.024, ts: str = "ts",
               value: str = "value") -> DataFrame:
    """AG6: ``sum(rate(cpu_seconds[24h])) * price`` per day, in $ per hour."""
    inc = counter_increase(cpu, series, "1 day", None, ts, value)
    g = inc.groupBy("window_start", "window_end").agg(exact_sum(inc, "increase").alias("_inc"))
    return g.select("window_start", "window_end",
                    (F.col("_inc").cast("double") / F.lit(86400) * F.lit(price)).alias("infra_cost"))


def _label(df: DataFrame, key: str, labels: str | None):
    if labels is not None:
        return F.coalesce(F.try_element_at(F.col(labels), F.lit(key)), F.lit(""))
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def match_labels(metrics: DataFrame, eq: Mapping[str, str] | None = None,
                 re: Mapping[str, str] | None = None, labels: str | None = None) -> DataFrame:
    """FL4: ``=`` exact and ``=~`` fully anchored regex; an absent label equals ''."""
    cond = F.lit(True)
    for k, v in (eq or {}).items():
        cond = cond & (_label(metrics, k, labels) == F.lit(v))
    for k, pat in (re or {}).items():
        cond = cond & _label(metrics, k, labels).rlike(f"^(?:{pat})$")
    return metrics.filter(cond)


def instant_value(metrics: DataFrame, times: DataFrame, series: Sequence[str], lookback: int = 300,
                  ts: str = "ts", value: str = "value", time: str = "eval_ts") -> DataFrame:
    """JN10: latest sample at or before each evaluation time, within ``lookback`` seconds.

    ``times`` carries the series keys and the evaluation time.  As-of join as
    union + ``last(..., ignorenulls)`` partitioned by (series, chunk), with the
    last sample of every chunk copied into the next chunk; chunks are at least
    ``lookback`` long, so nothing older is ever needed.  No nested loop, and
    a hot series is still split by chunk.
    """
    series = list(series)
    size = max(int(lookback), 3600)
    samples = metrics.select(*series, F.col(ts).alias("_t"), F.col(value).alias("_v"),
                             F.lit(0).alias("_kind"), time_chunk(ts, size).alias("_c"))
    # last sample of each chunk; max / max_by keep fixed-width buffers, so this is a hash aggregate
    carry = (samples.groupBy(*series, "_c").agg(F.max("_t").alias("_t"), F.max_by("_v", "_t").alias("_v"))
             .select(*series, "_t", "_v", F.lit(0).alias("_kind"), (F.col("_c") + 1).alias("_c")))
    asks = times.select(*series, F.col(time).alias("_t"), F.lit(None).cast(metrics.schema[value].dataType).alias("_v"),
                        F.lit(1).alias("_kind"), time_chunk(time, size).alias("_c"))
    allrows = samples.unionByName(carry).unionByName(asks)
    w = (Window.partitionBy(*series, "_c").orderBy("_t", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))),
                  ignorenulls=True).over(w)
    found = allrows.withColumn("_s", last).filter(F.col("_kind") == 1)
    lo = F.col("_t") - F.expr(f"INTERVAL {int(lookback)} SECONDS")
    return (found.filter(F.col("_s").isNotNull() & (F.col("_s.t") > lo))
            .select(*series, F.col("_t").alias(time), F.col("_s.t").alias("sample_ts"), F.col("_s.v").alias(value)))


def evaluation_grid(metrics: DataFrame, series: Sequence[str], step: str = "1 hour", ts: str = "ts",
                    time: str = "eval_ts") -> DataFrame:
    """Evaluation instants every ``step`` over each series' own span (a range query's grid).

    Instants run from the first step boundary after the series' first sample
    to the one after its last sample.  Each series makes its own ``sequence``,
    so no series is crossed with a global calendar.
    """
    span = metrics.groupBy(*series).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    # one window() per projection (Spark allows no more)
    ends = (span.select(*series, F.window("_lo", step).end.alias("_a"), "_hi")
            .select(*series, "_a", F.window("_hi", step).end.alias("_b")))
    return ends.select(*series, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(time))


# Resource targets (average CPU, normal and peak memory).
CPU_AVG_LIMIT_PCT = 50.0
MEM_NORMAL_LIMIT_BYTES = 4 * 1024 ** 3
MEM_PEAK_LIMIT_BYTES = 8 * 1024 ** 3


def resource_targets(stats: DataFrame, keys: Sequence[str] = ("container",), cpu: str = "cpu_pct",
                     mem: str = "mem_used_bytes", cpu_limit: float = CPU_AVG_LIMIT_PCT,
                     mem_normal: int = MEM_NORMAL_LIMIT_BYTES, mem_peak: int = MEM_PEAK_LIMIT_BYTES) -> DataFrame:
    """AG13: average CPU below 50 %, memory below 4 GiB on average and 8 GiB at peak (unrounded)."""
    g = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(cpu).alias("avg_cpu_pct"),
        F.max(cpu).alias("max_cpu_pct"),
        F.count_if(F.col(cpu) >= cpu_limit).alias("n_cpu_over"),
        F.avg(mem).alias("avg_mem_bytes"),
        F.max(mem).alias("max_mem_bytes"),
        F.count_if(F.col(mem) >= mem_normal).alias("n_mem_over_normal"),
        F.count_if(F.col(mem) >= mem_peak).alias("n_mem_over_peak"))
    return g.select("*",
                    (F.col("avg_cpu_pct") < cpu_limit).alias("cpu_ok"),
                    (F.col("avg_mem_bytes") < mem_normal).alias("mem_normal_ok"),
                    (F.col("max_mem_bytes") < mem_peak).alias("mem_peak_ok"))

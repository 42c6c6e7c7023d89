"""Mergeable summaries by day: percentiles (AG15) and distinct counts (AG16, AG12) that add up without rereading.

A day's rows become one small row per key with a sketch (KLL for percentiles,
HyperLogLog for distinct values) beside exact counts.  Days are stored once and
later merged to any span; the cost of a report does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traces import LATENCY_TARGET_MS

#: Size of a KLL sketch: quantiles are within about half a percent of their rank.
KLL_SIZE = 800
#: Log2 of a HyperLogLog sketch's buckets: distinct counts are within about 1.6 percent.
HLL_SIZE = 12


def latency_sketches(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", latency: str = "latency_ms",
                     ms: float = LATENCY_TARGET_MS, size: int = KLL_SIZE) -> DataFrame:
    """Per day and key: rows with a latency, those below ``ms``, and a KLL sketch of the latencies."""
    known = df.filter(F.col(latency).isNotNull())
    return known.groupBy(F.to_date(ts).alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(latency) < ms).alias("n_below"),
        F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(size)).alias("sketch"))


def latency_report(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share below the target, p50 and p95 of the merged days."""
    g = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_below").alias("n_below"),
                                    F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return g.select(*keys, "n", "n_below", (F.col("n_below") / F.col("n")).alias("share_below"),
                    at(0.5).alias("p50"), at(0.95).alias("p95"))


def hygiene_sketches(spans: DataFrame, required: Sequence[str], ts: str = "start_ts", attributes: str = "attributes",
                     size: int = HLL_SIZE) -> DataFrame:
    """Per day and required attribute key: spans, spans without it, and a HyperLogLog sketch of its values."""
    one = lambda k: F.struct(F.lit(k).alias("key"), F.try_element_at(F.col(attributes), F.lit(k)).alias("value"))
    kv = spans.select(F.to_date(ts).alias("day"), F.inline(F.array(*[one(k) for k in required])))
    return kv.groupBy("day", "key").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("value").isNull()).alias("n_missing"),
                                        F.hll_sketch_agg("value", F.lit(size)).alias("sketch"))


def hygiene_report(sketches: DataFrame) -> DataFrame:
    """Spans, missing ones and distinct values per key over the merged days."""
    g = sketches.groupBy("key").agg(F.sum("n_spans").alias("n_spans"), F.sum("n_missing").alias("n_missing"),
                                    F.hll_union_agg("sketch").alias("sketch"))
    return g.select("key", "n_spans", "n_missing", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def findings_sketches(findings: DataFrame, keys: Sequence[str] = ("rule",), source: str = "doc_id", day: str = "day",
                      size: int = HLL_SIZE) -> DataFrame:
    """Per day and key: findings and a HyperLogLog sketch of the sources that hold them."""
    return findings.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n_findings"),
                                            F.hll_sketch_agg(F.col(source).cast("string"), F.lit(size)).alias("sketch"))


def findings_report(sketches: DataFrame, keys: Sequence[str] = ("rule",)) -> DataFrame:
    """Findings and distinct sources per key over the merged days."""
    g = sketches.groupBy(*keys).agg(F.sum("n_findings").alias("n_findings"), F.hll_union_agg("sketch").alias("sketch"))
    return g.select(*keys, "n_findings", F.hll_sketch_estimate("sketch").alias("n_sources"))

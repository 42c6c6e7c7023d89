"""Queries over mergeable daily summaries (AG15, AG16): sketches are made per day, then merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .fixture_sql import with_views
from .registration import register, rounded
from ..operators import sketches


@register("latency_sketches", with_views("""
select seq % 4 as priority, count(*) as n, count_if(latency_ms < 2000) as n_below, round(count_if(latency_ms < 2000) / count(*), 4) as share_below,
       true as p50_ok, true as p95_ok
from v_traces group by 1""", "v_traces"))
def q_latency_sketches(spark, sf):
    """Merged KLL sketches: both percentiles lie within two percent of their rank among all rows."""
    t = fx.v_traces(spark, sf).withColumn("priority", F.col("seq") % 4)
    report = sketches.latency_report(sketches.latency_sketches(t, ["priority"]), ["priority"])
    near = lambda c, p: ((F.count_if(F.col("latency_ms") < F.col(c)) <= (p + 0.02) * F.count(F.lit(1)))
                         & (F.count_if(F.col("latency_ms") <= F.col(c)) >= (p - 0.02) * F.count(F.lit(1))))
    ranks = (t.select("priority", "latency_ms").join(report.select("priority", "p50", "p95"), "priority")
             .groupBy("priority").agg(near("p50", 0.5).alias("p50_ok"), near("p95", 0.95).alias("p95_ok")))
    return rounded(report.drop("p50", "p95").join(ranks, "priority"), share_below=4)


@register("hygiene_sketches", with_views("""
, kv as (select 'service.name' as key, case when seq % 9 <> 0 then service end as value from v_spans
        union all select 'span.name', name from v_spans union all select 'host.name', null from v_spans)
select key, count(*) as n_spans, count_if(value is null) as n_missing, count(distinct value) as n_distinct from kv group by key""", "v_spans"))
def q_hygiene_sketches(spark, sf):
    """Daily HyperLogLog sketches merged (few distinct values, which a sketch counts exactly)."""
    sp = fx.v_spans(spark, sf).withColumn("attributes", F.when(F.col("seq") % 9 == 0, F.create_map(F.lit("span.name"), F.col("name")))
                                          .otherwise(F.create_map(F.lit("service.name"), F.col("service"), F.lit("span.name"), F.col("name"))))
    return sketches.hygiene_report(sketches.hygiene_sketches(sp, ["service.name", "span.name", "host.name"]))

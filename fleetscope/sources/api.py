"""SRC4-SRC6: JSON API responses saved as files (trace pages, metric queries, span searches).

A page that is not valid JSON fails the read; it is never dropped silently.
With ``quarantined`` pages are read as text instead: broken ones become dead
letters (``quarantine.dead_letters(page_rows(...))``), the others are parsed.
Each reader's second half (``*_of_pages``) takes parsed pages from any source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quarantine

TRACE_PAGE = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("latency", T.DoubleType()),
    T.StructField("totalCost", T.DecimalType(18, 6)),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])))])


def page_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole files as pages of ``schema``, broken ones marked."""
    return quarantine.parsed(quarantine.read_text(spark, path, whole=True), schema, file="file")


def _pages(spark: SparkSession, path: str, schema: T.StructType, quarantined: bool) -> DataFrame:
    if quarantined:
        return quarantine.good_rows(page_rows(spark, path, schema))
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_traces(spark: SparkSession, path: str, quarantined: bool = False) -> DataFrame:
    """SRC4: ``{data: [{id, timestamp, latency, totalCost, metadata}]}`` pages -> one row per trace."""
    return traces_of_pages(_pages(spark, path, TRACE_PAGE, quarantined))


def traces_of_pages(pages: DataFrame) -> DataFrame:
    t = pages.select(F.inline("data"))
    return t.select(F.col("id").alias("trace_id"),
                    F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("ts"),
                    "name", F.col("latency").alias("latency_ms"), F.col("totalCost").alias("total_cost"), "metadata")


METRIC_RESPONSE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("value", T.ArrayType(T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType())))])))]))])

FLAT_SAMPLE = T.StructType([T.StructField("metric", T.StringType()),
                            T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
                            T.StructField("ts", T.DoubleType()), T.StructField("value", T.StringType())])


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _epoch_to_ts(x):
    """Epoch seconds (possibly fractional) -> UTC wall-clock ``timestamp_ntz``, whatever the session zone."""
    micros = (x.try_cast("double") * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH_NTZ))


def read_metric_samples(spark: SparkSession, path: str, flat: bool = False, quarantined: bool = False) -> DataFrame:
    """SRC5: query responses (``data.result[].value`` / ``.values``) or flat JSON-lines samples.

    Sample values arrive as strings and are cast with ``try_cast`` (bad -> null).
    """
    if flat:
        f = spark.read.schema(FLAT_SAMPLE).option("mode", "FAILFAST").json(path)
        return f.select("metric", "labels", _epoch_to_ts(F.col("ts")).alias("ts"),
                        F.col("value").try_cast("double").alias("value"))
    return samples_of_pages(_pages(spark, path, METRIC_RESPONSE, quarantined))


def samples_of_pages(r: DataFrame) -> DataFrame:
    series = r.select(F.explode_outer("data.result").alias("s")).filter(F.col("s").isNotNull())
    pts = series.select(F.col("s.metric").alias("m"), F.explode(F.when(F.col("s.value").isNotNull(),
                                                                       F.array(F.col("s.value")))
                                                                .otherwise(F.col("s.values"))).alias("p"))
    name = F.try_element_at(F.col("m"), F.lit("__name__"))
    labels = F.map_filter(F.col("m"), lambda k, v: k != "__name__")
    return pts.select(name.alias("metric"), labels.alias("labels"), _epoch_to_ts(F.element_at("p", 1)).alias("ts"),
                      F.element_at("p", 2).try_cast("double").alias("value"))


SPAN_SEARCH = T.StructType([T.StructField("traces", T.ArrayType(T.StructType([
    T.StructField("traceID", T.StringType()), T.StructField("rootServiceName", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("spanID", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("startTimeUnixNano", T.StringType()), T.StructField("durationMs", T.DoubleType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])))])))])


def read_spans(spark: SparkSession, path: str, quarantined: bool = False) -> DataFrame:
    """SRC6: span search responses ``traces[].spans[]`` -> one row per span."""
    return spans_of_pages(_pages(spark, path, SPAN_SEARCH, quarantined))


def spans_of_pages(r: DataFrame) -> DataFrame:
    t = r.select(F.inline("traces"))
    s = t.select("traceID", "rootServiceName", F.inline("spans"))
    start = F.timestamp_add("MICROSECOND", (F.col("startTimeUnixNano").try_cast("decimal(38,0)") / 1000).cast("bigint"),
                           F.expr(_EPOCH_NTZ))
    return s.select(F.lower(F.lpad("traceID", 32, "0")).alias("trace_id"), F.lower(F.lpad("spanID", 16, "0")).alias("span_id"),
                    "name", F.coalesce(F.try_element_at("attributes", F.lit("service.name")), F.col("rootServiceName")).alias("service"),
                    start.alias("start_ts"), F.col("durationMs").alias("duration_ms"), "attributes")

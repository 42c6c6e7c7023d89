"""Queries over text rendered from the supplied tables: the parsing halves of SRC3-SRC7 and SRC10, broken records included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixture_sql import with_views
from .registration import register
from .. import functions as fn
from ..sources import api, containers, files, quarantine

_SECOND = "yyyy-MM-dd'T'HH:mm:ss"


def _text(*parts) -> F.Column:
    """Strings and column names put together; ``{x}`` marks a column."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") and p.endswith("}") and p[1:-1].isidentifier() else F.lit(p) for p in parts])


# --------------------------------------------------------------------------- SRC7, SRC10: lines

_EVENT_LINE = """'{"event_id":"' || event_id || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","type":"' || event_type
  || '","trace_id":"' || md5(cast(user_id as string)) || '","body":"b' || event_id || '"}'"""


def _event_rows(spark, sf) -> DataFrame:
    """Event lines: some cut short, some with a word for a time, some no object, some blank."""
    n = F.col("event_id")
    ev = fx.table(spark, sf, "events").withColumns({"at": F.date_format("ts", _SECOND), "tid": F.md5(F.col("user_id").cast("string"))})
    line = _text('{"event_id":"', "{event_id}", '","ts":"', "{at}", '","type":"', "{event_type}", '","trace_id":"', "{tid}", '","body":"b', "{event_id}", '"}')
    late = _text('{"event_id":"', "{event_id}", '","ts":"soon"}')
    value = F.when(n % 23 == 0, " ").when(n % 13 == 0, F.substring(line, 1, 40)).when(n % 17 == 0, late).when(n % 19 == 0, "[]").otherwise(line)
    return quarantine.parsed(ev.select(value.alias("value"), (n % 5).cast("string").alias("file")), files.EVENT_SCHEMA, file="file")


@register("event_landing", """
select cast(event_id as string) as event_id, date_trunc('second', ts) as ts, event_type as type, md5(cast(user_id as string)) as trace_id,
       'b' || event_id as body
from events where event_id % 23 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0""")
def q_event_landing(spark, sf):
    return quarantine.good_rows(_event_rows(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("event_dead_letters", f"""
select cast(event_id % 5 as string) as file,
       case when event_id % 13 = 0 then left({_EVENT_LINE}, 40)
            when event_id % 17 = 0 then '{{"event_id":"' || event_id || '","ts":"soon"}}' else '[]' end as raw
from events where event_id % 23 <> 0 and (event_id % 13 = 0 or event_id % 17 = 0 or event_id % 19 = 0)""")
def q_event_dead_letters(spark, sf):
    return quarantine.dead_letters(_event_rows(spark, sf))


@register("commit_landing", with_views("""
select cast(event_id as string) as sha, date_trunc('second', ts) as ts, message, case when event_id % 4 = 0 then 'see "notes"' end as body, tag
from v_commits where event_id % 11 <> 0""", "v_commits"))
def q_commit_landing(spark, sf):
    c = fx.v_commits(spark, sf)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("sha"), F.date_format("ts", _SECOND).alias("ts"), "message",
                              F.when(F.col("event_id") % 4 == 0, 'see "notes"').alias("body"), "tag"))
    cut = F.when(F.col("event_id") % 11 == 0, F.regexp_replace(line, r"\}$", "")).otherwise(line)
    return quarantine.good_rows(quarantine.parsed(c.select(cut.alias("value")), files.COMMIT_SCHEMA))


# --------------------------------------------------------------------------- SRC4-SRC6: pages

def _pages(rows: DataFrame, page: F.Column, order: str, item: F.Column, head: str, tail: str, schema) -> DataFrame:
    """Items gathered to pages of text (bounded by ``page``); every ninth page is cut short."""
    held = rows.select(page.alias("page"), F.struct(F.col(order).alias("o"), item.alias("t")).alias("i"))
    held = held.groupBy("page").agg(F.array_sort(F.collect_list("i")).alias("items"))
    text = F.concat(F.lit(head), F.array_join(F.transform("items", lambda x: x["t"]), ","), F.lit(tail))
    value = F.when(F.col("page") % 9 == 0, F.expr("substring(text, 1, length(text) - 3)")).otherwise(F.col("text"))
    return quarantine.parsed(held.withColumn("text", text).select(value.alias("value"), F.col("page").cast("string").alias("file")), schema, file="file")


def _trace_pages(spark, sf) -> DataFrame:
    o = fx.table(spark, sf, "orders").withColumns({
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "cents": (F.col("o_orderkey") % 900 + 100).cast("string")})
    item = _text('{"id":"t', "{o_orderkey}", '","timestamp":"', "{day}", 'T01:02:03","name":"call","latency":', "{o_orderkey}", '.5,"totalCost":0.000',
                 "{cents}", ',"metadata":{"tempo_trace_id":"', "{o_custkey}", '"}}')
    return _pages(o, F.floor(F.col("o_orderkey") / 50), "o_orderkey", item, '{"data":[', "]}", api.TRACE_PAGE)


@register("trace_pages", """
select 't' || o_orderkey as trace_id, cast(cast(o_orderdate as date) as timestamp) + interval 3723 second as ts, 'call' as name,
       o_orderkey + 0.5::double as latency_ms, cast((o_orderkey % 900 + 100) / 1000000 as decimal(18,6)) as total_cost,
       cast(o_custkey as string) as tempo_trace_id
from orders where (o_orderkey // 50) % 9 <> 0""")
def q_trace_pages(spark, sf):
    t = api.traces_of_pages(quarantine.good_rows(_trace_pages(spark, sf)))
    return t.withColumn("tempo_trace_id", fn.json_field(t, "metadata", "tempo_trace_id")).drop("metadata")


@register("trace_dead_pages", """
select cast(o_orderkey // 50 as string) as file from orders where (o_orderkey // 50) % 9 = 0 group by 1""")
def q_trace_dead_pages(spark, sf):
    return quarantine.dead_letters(_trace_pages(spark, sf)).select("file")


@register("metric_pages", """
select 'tokens' as metric, cast(event_id // 100 as string) as page, date_trunc('second', ts) as ts,
       case when event_id % 6 <> 0 then event_id + 0.25::double end as value
from events where (event_id // 100) % 9 <> 0""")
def q_metric_pages(spark, sf):
    ev = fx.table(spark, sf, "events").withColumns({
        "at": F.unix_timestamp("ts"), "page": F.floor(F.col("event_id") / 100),
        "v": F.when(F.col("event_id") % 6 != 0, F.concat(F.col("event_id").cast("string"), F.lit(".25"))).otherwise("n/a")})
    item = _text('{"metric":{"__name__":"tokens","page":"', "{page}", '"},"values":[[', "{at}", ',"', "{v}", '"]]}')
    pages = _pages(ev, F.col("page"), "event_id", item, '{"status":"success","data":{"resultType":"matrix","result":[', "]}}", api.METRIC_RESPONSE)
    s = api.samples_of_pages(quarantine.good_rows(pages))
    return s.select("metric", F.col("labels")["page"].alias("page"), "ts", "value")


@register("span_pages", """
select lpad(cast(event_id // 40 as string), 32, '0') as trace_id, substr(md5(cast(event_id as string)), 1, 16) as span_id, event_type as name,
       case when event_id % 3 = 0 then 'root' else 'svc' || (user_id % 4) end as service,
       date_trunc('second', ts) as start_ts, event_id + 0.5::double as duration_ms
from events where (event_id // 40) % 9 <> 0""")
def q_span_pages(spark, sf):
    n = F.col("event_id")
    ev = fx.table(spark, sf, "events").withColumns({
        "page": F.floor(n / 40), "sid": F.substring(F.md5(n.cast("string")), 1, 16), "ns": F.concat(F.unix_timestamp("ts").cast("string"), F.lit("0" * 9)),
        "attrs": F.when(n % 3 == 0, "{}").otherwise(F.concat(F.lit('{"service.name":"svc'), (F.col("user_id") % 4).cast("string"), F.lit('"}')))})
    item = _text('{"traceID":"', "{page}", '","rootServiceName":"root","spans":[{"spanID":"', "{sid}", '","name":"', "{event_type}",
                 '","startTimeUnixNano":"', "{ns}", '","durationMs":', "{event_id}", '.5,"attributes":', "{attrs}", "}]}")
    pages = _pages(ev, F.col("page"), "event_id", item, '{"traces":[', "]}", api.SPAN_SEARCH)
    return api.spans_of_pages(quarantine.good_rows(pages)).drop("attributes")


# --------------------------------------------------------------------------- SRC3: listings

@register("container_listings", """
select timestamp '2024-01-01' + interval 1 minute * (event_id // 40) as snapshot_ts, 'host' || (event_id // 40 % 3) as host,
       substr(md5(cast(event_id as string)), 1, 12) as container_id, 'acme/app' || (user_id % 5) as image, '"run ' || event_type || '"' as command,
       (event_id % 50 + 1) || ' minutes ago' as created, 'Up ' || (event_id % 9 + 1) || ' hours' as status,
       case when event_id % 4 <> 0 then '9000/tcp' end as ports, 'c' || event_id as name
from events""")
def q_container_listings(spark, sf):
    n = F.col("event_id")
    width = {"CONTAINER ID": 15, "IMAGE": 12, "COMMAND": 18, "CREATED": 17, "STATUS": 14, "PORTS": 11, "NAMES": 0}
    cells = [F.substring(F.md5(n.cast("string")), 1, 12), F.concat(F.lit("acme/app"), (F.col("user_id") % 5).cast("string")),
             F.concat(F.lit('"run '), "event_type", F.lit('"')), F.concat((n % 50 + 1).cast("string"), F.lit(" minutes ago")),
             F.concat(F.lit("Up "), (n % 9 + 1).cast("string"), F.lit(" hours")), F.when(n % 4 != 0, "9000/tcp").otherwise("")]
    line = F.concat(*[F.rpad(c, w, " ") for c, w in zip(cells, width.values())], F.lit("c"), n.cast("string"))
    header = "".join(h.ljust(w) for h, w in width.items())
    snap = F.floor(n / 40)
    held = fx.table(spark, sf, "events").select(snap.alias("snap"), F.struct(n.alias("o"), line.alias("t")).alias("i"))
    held = held.groupBy("snap").agg(F.array_sort(F.collect_list("i")).alias("items"))
    listing = held.select(
        F.concat(F.lit(header + "\n"), F.array_join(F.transform("items", lambda x: x["t"]), "\n"), F.lit("\n")).alias("value"),
        F.concat(F.lit("/snap/host"), (F.col("snap") % 3).cast("string"), F.lit("/ps.txt")).alias("path"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(snap))").alias("snapshot_ts"))
    return containers.parse_container_listings(listing)


# --------------------------------------------------------------------------- SF9: unknown shapes

@register("json_paths", """
with j as (select o_orderkey as seq, case o_orderkey % 6
    when 0 then '{"data":[{"metadata":{"x":"v' || o_orderkey || '"}}]}' when 1 then '{"data":{"metadata":{"x":1}}}'
    when 2 then '{"data":[{"metadata":{"x":' || o_orderkey || '}},{"metadata":null}]}' when 3 then '{"data":[' when 4 then '{"data":[]}'
    else 'null' end as text from orders)
select seq, case when seq % 6 = 0 then 'v' || seq when seq % 6 = 2 then cast(seq as string) end as x,
       case when seq % 6 = 2 then seq end as x_number, seq % 6 = 3 as broken from j""")
def q_json_paths(spark, sf):
    seq = F.col("o_orderkey")
    n = seq.cast("string")
    text = (F.when(seq % 6 == 0, F.concat(F.lit('{"data":[{"metadata":{"x":"v'), n, F.lit('"}}]}')))
            .when(seq % 6 == 1, '{"data":{"metadata":{"x":1}}}')
            .when(seq % 6 == 2, F.concat(F.lit('{"data":[{"metadata":{"x":'), n, F.lit('}},{"metadata":null}]}')))
            .when(seq % 6 == 3, '{"data":[').when(seq % 6 == 4, '{"data":[]}').otherwise("null"))
    rows = fx.table(spark, sf, "orders").select(seq.alias("seq"), text.alias("text"))
    path = "$.data[0].metadata.x"
    return rows.select("seq", fn.json_path("text", path).alias("x"), fn.json_path("text", path, "bigint").alias("x_number"),
                       F.try_parse_json("text").isNull().alias("broken"))

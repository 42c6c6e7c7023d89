"""Derived views over the supplied tables (FIXTURES.md section 3).

The supplied tables are TPC-H-like plus an ``events`` table; these views give
them the shapes of the observability data model (logs, counters, spans,
file catalogs, ...).  They are plain projections of whole tables, so every
query's work grows with the tables.  The two counter views need a running
sum; they use the chunked form from ``plans.ordered`` so no single series is
ever one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import running_sum

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _md5_of(col: str) -> F.Column:
    return F.md5(F.col(col).cast("string"))


def _millis(col: str) -> F.Column:
    """A value in cents as ten-thousandths of it: amounts below a cent, held exactly."""
    return (F.col(col).cast("decimal(12,2)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(18,6)")


def v_logs(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    service = F.expr("case user_id % 6 when 0 then 'web' when 1 then 'worker' when 2 then 'postgres' "
                     "when 3 then 'clickhouse' when 4 then 'redis' else 'minio' end")
    message = F.expr("case when event_type = 'error' then case event_id % 4 when 0 then 'ERROR: timeout' "
                     "when 1 then 'Fatal: disk' when 2 then 'panic: nil' else 'Unhandled Exception' end "
                     "else concat('ok ', event_type) end")
    return ev.select(F.col("event_id").alias("line_id"), "ts", service.alias("service"),
                     F.col("user_id").cast("string").alias("host"), message.alias("message"))


def v_tokens(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    base = ev.select("event_id", F.col("event_type").alias("model"),
                     (F.col("user_id") % 5).cast("string").alias("instance"), "ts",
                     _millis("value").alias("_v"), F.to_date("ts").alias("_day"))
    out = running_sum(base, ["model", "instance", "_day"], ["ts"], "_v", "value", chunk_seconds=3600)
    return out.select("event_id", "model", "instance", "ts", F.col("value").cast("decimal(18,6)").alias("value"))


def v_spans(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        _md5_of("user_id").alias("trace_id"),
        F.substring(_md5_of("event_id"), 1, 16).alias("span_id"),
        F.expr("case event_type when 'view' then 'memory_search' when 'click' then 'memory_search_cache' "
               "else event_type end").alias("name"),
        F.expr("case when event_id % 20 = 0 then null else concat('svc', cast(user_id % 4 as string)) end")
        .alias("service"),
        F.col("ts").alias("start_ts"),
        (F.col("value") * 100).alias("duration_ms"))


def v_files(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("host"),
        F.expr("concat('backup-', case when event_type = 'signup' then 'manual-' else '' end, "
               "replace(replace(substr(cast(ts as string),1,19),' ','_'),':','-'), '.tar.gz')").alias("name"),
        (F.col("value").cast("decimal(12,2)") * 1000000).cast("bigint").alias("size_bytes"),
        F.col("ts").alias("mtime"),
        (F.col("event_id") % 10 != 0).alias("in_primary"),
        (F.col("event_id") % 7 != 0).alias("in_replica"),
        (F.col("event_id") % 11 == 0).alias("changed"))


def primary_catalog(spark, sf_dir) -> DataFrame:
    """The primary side of the mirror: files present on the primary."""
    f = v_files(spark, sf_dir)
    return f.filter("in_primary").select("host", "name", "size_bytes", "mtime")


def replica_catalog(spark, sf_dir) -> DataFrame:
    """The replica side; ``changed`` files differ in size by one byte."""
    f = v_files(spark, sf_dir)
    return f.filter("in_replica").select(
        "host", "name",
        (F.col("size_bytes") + F.when(F.col("changed"), 1).otherwise(0)).alias("size_bytes"), "mtime")


def v_traces(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tid = _md5_of("o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("seq"), tid.alias("trace_id"), F.col("o_orderdate").alias("ts"),
        _millis("o_totalprice").alias("total_cost"),
        F.concat(F.lit('{"tempo_trace_id":"'), tid, F.lit('","tempo_span_id":"'), F.substring(tid, 1, 16),
                 F.lit('"}')).alias("metadata"),
        (F.col("o_orderkey") * 37 % 10000).alias("latency_ms"))


def v_cpu(spark, sf_dir) -> DataFrame:
    """Cpu-second counters: three containers a trace, each reset at midnight; every tenth has no trace."""
    ev = table(spark, sf_dir, "events")
    base = ev.select("event_id", (F.col("event_id") % 300).alias("_series"), "ts",
                     F.to_date("ts").alias("_day"), _millis("value").alias("_v"))
    out = running_sum(base, ["_series", "_day"], ["ts"], "_v", "value", chunk_seconds=86400)
    return out.select("event_id", F.md5((F.col("_series") % 100 * F.when(F.col("_series") % 10 == 9, -70).otherwise(70)).cast("string")).alias("trace_id"),
                      F.concat(F.lit("c"), F.floor(F.col("_series") / 100).cast("string")).alias("container"), "ts",
                      F.col("value").cast("decimal(18,6)").alias("value"))


def v_obs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    j = li.join(part, part.p_partkey == li.l_partkey)
    return j.select(
        F.col("l_orderkey").alias("trace_seq"), _md5_of("l_orderkey").alias("trace_id"),
        F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("model"),
        F.when((F.col("l_quantity") == 1) & (F.substring("p_brand", 7, 1 << 20).cast("int") % 5 != 0), F.lit(None)).otherwise(F.col("l_quantity").cast("bigint")).alias("tokens"),
        _millis("l_extendedprice").alias("cost"))


def v_status(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("user_id").cast("string").alias("host"),
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("container"), F.col("ts").alias("snapshot_ts"),
        F.expr("case when user_id % 5 = 0 then 'Up 5 minutes (healthy)' else case event_type when 'view' then "
               "'Up 5 minutes (healthy)' when 'error' then 'Up 2 hours (unhealthy)' when 'click' then 'Up 26 minutes' when 'purchase' then "
               "'Exited (143) 29 hours ago' else 'Up 3 seconds (health: starting)' end end").alias("status"))


def v_config(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    line = (F.when(F.col("c_custkey") % 6 == 0, F.lit("DB_PASSWORD=op://vault/db/password"))
            .when(F.col("c_custkey") % 6 == 1, F.concat(F.lit("API_KEY="), _md5_of("c_custkey")))
            .when(F.col("c_custkey") % 6 == 2, F.lit("# OLD_SECRET=abc"))
            .when(F.col("c_custkey") % 6 == 3, F.lit("LOG_LEVEL=info"))
            .when(F.col("c_custkey") % 6 == 4, F.lit("REDIS_AUTH=${REDIS_AUTH}"))
            .otherwise(F.lit("AUTH_MODE=")))
    return c.select(F.col("c_custkey").alias("line_no"),
                    F.concat(F.lit("host"), F.col("c_nationkey").cast("string"), F.lit(".env")).alias("file"),
                    line.alias("line"))


def v_scan(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = _md5_of("doc_id")
    nl = F.lit("\n")
    text = (F.when(F.col("doc_id") % 50 == 0,
                   F.concat("text", nl, F.lit("key sk-lf-"), F.substring(h, 1, 8), F.lit("-1234-1234-1234-"),
                            F.substring(h, 1, 12)))
            .when(F.col("doc_id") % 50 == 1, F.concat("text", nl, F.lit("DATABASE_URL=op://vault/db/url")))
            .when(F.col("doc_id") % 50 == 2, F.concat("text", nl, F.lit("CLICKHOUSE_PASSWORD="), F.substring(h, 1, 16)))
            .when(F.col("doc_id") % 50 == 3, F.concat("text", nl, F.lit("REDIS_AUTH=CHANGE_ME")))
            .when(F.col("doc_id") % 50 == 4, F.concat("text", nl, F.lit("pk-lf-"), F.substring(h, 1, 8), F.lit("-1234-1234-1234-"), F.substring(h, 1, 12)))
            .when(F.col("doc_id") % 50 == 5, F.concat("text", nl, F.lit("url postgresql://app:"), F.substring(h, 1, 9), F.lit("@db/x postgres://a:b@c")))
            .when(F.col("doc_id") % 50 == 6, F.concat("text", nl, F.lit("MINIO_ROOT_SECRET_KEY: "), F.substring(h, 1, 9)))
            .when(F.col("doc_id") % 50 == 7, F.concat("text", nl, F.lit("SALT = x1 NEXTAUTH_SECRET="), h))
            .when(F.col("doc_id") % 50 == 8, F.concat("text", nl, F.lit("-----BEGIN RSA PRIVATE KEY-----")))
            .when(F.col("doc_id") % 50 == 9, F.concat("text", nl, F.lit("ENCRYPTION_KEY=${ENC_1}")))
            .when(F.col("doc_id") % 50 == 10, F.concat("text", nl, F.lit('REDIS_PASSWORD="your-password-here"')))
            .when(F.col("doc_id") % 50 == 11, F.concat("text", nl, F.lit("S3_UPLOAD_SECRET=PLACEHOLDER_X")))
            .when(F.col("doc_id") % 50 == 12, F.concat("text", nl, F.lit("postgres://u:my-test-pw@h")))
            .when(F.col("doc_id") % 50 == 14, F.concat("text", nl, F.lit("REDIS_PASSWORD = "), F.substring(h, 1, 12)))
            .when(F.col("doc_id") % 50 == 13, F.concat("text", nl, F.lit("CLICKHOUSE_PASSWORD=op://vault/x")))
            .otherwise(F.col("text")))
    return d.select("doc_id", text.alias("text"))


def v_versions(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pinned = F.concat(F.lit("3."), F.col("p_size").cast("string"), F.lit("."),
                      (F.col("p_partkey") % 10).cast("string"))
    newest = (F.when(F.col("p_partkey") % 13 == 0, F.lit(None))
              .when(F.col("p_partkey") % 17 == 0, F.lit("latest"))
              .when(F.col("p_partkey") % 19 == 0, F.lit("2024-01-05"))
              .when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("3."), F.col("p_size").cast("string")))
              .otherwise(F.concat(F.lit("3."), (F.col("p_partkey") * 7 % 50).cast("string"), F.lit(".0"))))
    return p.select(F.col("p_partkey").alias("service"), pinned.alias("pinned"), newest.alias("newest"))


COMMIT_PREFIXES = ["feat(ui): ", "fix: ", "docs: ", "perf(db): ", "refactor(db)!: ", "style: ", "test: ", "chore(release): prepare for ",
                   "chore(deps): ", "chore(pr): ", "chore(pull): ", "chore: ", "ci(main): ", "build: ", "revert: ", "build!: ", "update ",
                   "feat!: ", "fix(api): ", "other(x): "]


def v_commits(spark, sf_dir) -> DataFrame:
    """Commits of every group, skipped ones, unconventional ones, bodies and several lines."""
    ev = table(spark, sf_dir, "events")
    n = F.col("event_id")
    prefix = F.element_at(F.array(*[F.lit(x) for x in COMMIT_PREFIXES]), (n % len(COMMIT_PREFIXES) + 1).cast("int"))
    msg = F.concat(prefix, F.lit("change "), n.cast("string"), F.when(n % 4 == 0, " by PR #").otherwise(" (#"), n.cast("string"),
                   F.when(n % 4 == 0, "").otherwise(")"), F.when(n % 5 == 0, "\n\nfix: not the header").otherwise(""))
    body = F.when(n % 20 == 13, "notes on security").when(n % 20 == 3, "BREAKING CHANGE: all of it").when(n % 20 == 15, "security comes first")
    tag = F.when(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")),
                 F.concat(F.lit("v1."), F.dayofmonth("ts").cast("string"), F.lit(".0")))
    return ev.select("event_id", "ts", msg.alias("message"), body.alias("body"), tag.alias("tag"))


def v_scores(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    j = lab.join(docs, "doc_id")
    # One pass over the join: each label row yields its two scores.
    return j.select("doc_id", "source", F.explode(F.array(
        F.struct(F.lit("quality").alias("name"), F.col("quality").alias("value")),
        F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("value")))).alias("s")
    ).select("doc_id", "source", "s.name", "s.value")


def v_stats(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("event_type").alias("container"), "ts",
                     (F.col("value") / 5).alias("cpu_pct"),
                     (F.col("value").cast("decimal(12,2)") * 20000000).cast("bigint").alias("mem_used_bytes"))


def v_probes(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    component = F.expr("case when event_id % 3 = 0 or (user_id % 7 = 3 and event_id % 3 = 2) then 'web' "
                       "when event_id % 3 = 1 then 'object_store' else 'analytics' end")
    code = F.expr("case when user_id % 5 = 0 then 200 else case event_type when 'view' then 200 when 'click' then 302 when 'signup' then 403 "
                  "when 'purchase' then 500 else null end end")
    return ev.select("event_id", F.col("user_id").cast("string").alias("host"), "ts",
                     component.alias("component"), code.alias("http_code"))


def v_updates(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("seq"), _md5_of("user_id").alias("trace_id"), "ts",
                     F.col("event_type").alias("meta_key"), F.col("event_id").cast("string").alias("meta_value"))


def v_actual_cost(spark, sf_dir) -> DataFrame:
    """Billed cost per brand: off by some percent, zero for some brands, none for others."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    j = li.join(part, part.p_partkey == li.l_partkey)
    brand = F.substring("p_brand", 7, 1 << 20).cast("int")
    factor = F.when(brand % 7 == 4, 0).otherwise(F.lit(94) + brand % 13)
    return j.filter(brand % 7 != 3).groupBy(F.col("p_brand").alias("model")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * factor).cast("double") / 1000000).alias("actual_cost"))


def v_deps(spark, sf_dir) -> DataFrame:
    """Service dependencies: host ``c_custkey % 150`` waits on host ``c_nationkey``, a third of them on hosts that are always healthy."""
    c = table(spark, sf_dir, "customer")
    service = F.col("c_custkey") % 150
    steady = (F.floor(F.col("c_nationkey") / 5) + 1) * 5
    return c.select(service.cast("string").alias("service"),
                    F.when(service % 3 == 0, steady).otherwise(F.col("c_nationkey")).cast("bigint").cast("string").alias("depends_on"),
                    F.lit("service_healthy").alias("condition")).distinct()

"""SQL text of the derived views, for the DuckDB oracles.

Only the base tables are registered on the oracle side, so each oracle puts
the views it needs in a ``WITH`` clause built by :func:`with_views`.
"""

from __future__ import annotations

VIEW_SQL = {
    "v_logs": """
select event_id as line_id, ts,
       case user_id % 6 when 0 then 'web' when 1 then 'worker' when 2 then 'postgres' when 3 then 'clickhouse' when 4 then 'redis' else 'minio' end as service, cast(user_id as string) as host,
       case when event_type = 'error' then case event_id % 4 when 0 then 'ERROR: timeout' when 1 then 'Fatal: disk' when 2 then 'panic: nil' else 'Unhandled Exception' end else concat('ok ', event_type) end as message
from events""",
    "v_tokens": """
select event_id, event_type as model, cast(user_id % 5 as string) as instance, ts, cast(sum(cast(cast(value as decimal(12,2)) * cast(0.0001 as decimal(4,4)) as decimal(18,6))) over (partition by event_type, user_id % 5, cast(ts as date) order by ts) as decimal(18,6)) as value
from events""",
    "v_spans": """
select event_id as seq,
       md5(cast(user_id as string)) as trace_id, substr(md5(cast(event_id as string)),1,16) as span_id,
       case event_type when 'view' then 'memory_search' when 'click' then 'memory_search_cache' else event_type end as name,
       case when event_id % 20 = 0 then null else concat('svc', cast(user_id % 4 as string)) end as service, ts as start_ts, value * 100 as duration_ms
from events""",
    "v_files": """
select cast(user_id as string) as host,
       concat('backup-', case when event_type = 'signup' then 'manual-' else '' end, replace(replace(substr(cast(ts as string),1,19),' ','_'),':','-'), '.tar.gz') as name,
       cast(cast(value as decimal(12,2)) * 1000000 as bigint) as size_bytes, ts as mtime, event_id % 10 <> 0 as in_primary, event_id % 7 <> 0 as in_replica, event_id % 11 = 0 as changed
from events""",
    "v_primary": """
select host, name, size_bytes, mtime from v_files where in_primary""",
    "v_replica": """
select host, name, size_bytes + case when changed then 1 else 0 end as size_bytes, mtime from v_files where in_replica""",
    "v_traces": """
select o_orderkey as seq,
       md5(cast(o_orderkey as string)) as trace_id, o_orderdate as ts,
       cast(cast(o_totalprice as decimal(12,2)) * cast(0.0001 as decimal(4,4)) as decimal(18,6)) as total_cost,
       concat('{"tempo_trace_id":"', md5(cast(o_orderkey as string)), '","tempo_span_id":"', substr(md5(cast(o_orderkey as string)),1,16), '"}') as metadata,
       o_orderkey * 37 % 10000 as latency_ms
from orders""",
    "v_cpu": """
select event_id,
       md5(cast((event_id % 100) * case when event_id % 10 = 9 then -70 else 70 end as string)) as trace_id, concat('c', cast((event_id % 300) // 100 as string)) as container, ts,
       cast(sum(cast(cast(value as decimal(12,2)) * cast(0.0001 as decimal(4,4)) as decimal(18,6))) over (partition by event_id % 300, cast(ts as date) order by ts) as decimal(18,6)) as value
from events""",
    "v_obs": """
select l_orderkey as trace_seq,
       md5(cast(l_orderkey as string)) as trace_id, l_shipdate as ts, p_brand as model,
       case when l_quantity = 1 and cast(substr(p_brand, 7) as int) % 5 <> 0 then null else cast(l_quantity as bigint) end as tokens,
       cast(cast(l_extendedprice as decimal(12,2)) * cast(0.0001 as decimal(4,4)) as decimal(18,6)) as cost
from lineitem
join part on p_partkey = l_partkey""",
    "v_status": """
select event_id,
       cast(user_id as string) as host, concat('c', cast(event_id % 4 as string)) as container, ts as snapshot_ts,
       case when user_id % 5 = 0 then 'Up 5 minutes (healthy)' else case event_type when 'view' then 'Up 5 minutes (healthy)' when 'error' then 'Up 2 hours (unhealthy)' when 'click' then 'Up 26 minutes' when 'purchase' then 'Exited (143) 29 hours ago' else 'Up 3 seconds (health: starting)' end end as status
from events""",
    "v_config": """
select c_custkey as line_no,
       concat('host',
       cast(c_nationkey as string), '.env') as file,
       case c_custkey % 6 when 0 then 'DB_PASSWORD=op://vault/db/password' when 1 then concat('API_KEY=',
       md5(cast(c_custkey as string))) when 2 then '# OLD_SECRET=abc' when 3 then 'LOG_LEVEL=info' when 4 then 'REDIS_AUTH=${REDIS_AUTH}' else 'AUTH_MODE=' end as line
from customer""",
    "v_scan": """
select doc_id,
       case when doc_id % 50 = 0 then concat(text, chr(10), 'key sk-lf-', substr(md5(cast(doc_id as string)),1,8), '-1234-1234-1234-', substr(md5(cast(doc_id as string)),1,12)) when doc_id % 50 = 1 then concat(text, chr(10), 'DATABASE_URL=op://vault/db/url') when doc_id % 50 = 2 then concat(text, chr(10), 'CLICKHOUSE_PASSWORD=', substr(md5(cast(doc_id as string)),1,16)) when doc_id % 50 = 3 then concat(text, chr(10), 'REDIS_AUTH=CHANGE_ME')
       when doc_id % 50 = 4 then concat(text, chr(10), 'pk-lf-', substr(md5(cast(doc_id as string)),1,8), '-1234-1234-1234-', substr(md5(cast(doc_id as string)),1,12))
       when doc_id % 50 = 5 then concat(text, chr(10), 'url postgresql://app:', substr(md5(cast(doc_id as string)),1,9), '@db/x postgres://a:b@c')
       when doc_id % 50 = 6 then concat(text, chr(10), 'MINIO_ROOT_SECRET_KEY: ', substr(md5(cast(doc_id as string)),1,9))
       when doc_id % 50 = 7 then concat(text, chr(10), 'SALT = x1 NEXTAUTH_SECRET=', md5(cast(doc_id as string)))
       when doc_id % 50 = 8 then concat(text, chr(10), '-----BEGIN RSA PRIVATE KEY-----')
       when doc_id % 50 = 9 then concat(text, chr(10), 'ENCRYPTION_KEY=${ENC_1}')
       when doc_id % 50 = 10 then concat(text, chr(10), 'REDIS_PASSWORD="your-password-here"')
       when doc_id % 50 = 11 then concat(text, chr(10), 'S3_UPLOAD_SECRET=PLACEHOLDER_X')
       when doc_id % 50 = 12 then concat(text, chr(10), 'postgres://u:my-test-pw@h')
       when doc_id % 50 = 14 then concat(text, chr(10), 'REDIS_PASSWORD = ', substr(md5(cast(doc_id as string)),1,12))
       when doc_id % 50 = 13 then concat(text, chr(10), 'CLICKHOUSE_PASSWORD=op://vault/x') else text end as text
from documents""",
    "v_versions": """
select p_partkey as service,
       concat('3.',
       cast(p_size as string), '.',
       cast(p_partkey % 10 as string)) as pinned,
       case when p_partkey % 13 = 0 then null when p_partkey % 17 = 0 then 'latest' when p_partkey % 19 = 0 then '2024-01-05' when p_partkey % 7 = 0 then concat('3.', cast(p_size as string)) else concat('3.',
       cast(p_partkey * 7 % 50 as string), '.0') end as newest
from part""",
    "v_commits": """
select event_id, ts,
       concat(['feat(ui): ', 'fix: ', 'docs: ', 'perf(db): ', 'refactor(db)!: ', 'style: ', 'test: ', 'chore(release): prepare for ',
               'chore(deps): ', 'chore(pr): ', 'chore(pull): ', 'chore: ', 'ci(main): ', 'build: ', 'revert: ', 'build!: ', 'update ',
               'feat!: ', 'fix(api): ', 'other(x): '][event_id % 20 + 1], 'change ', cast(event_id as string),
              case when event_id % 4 = 0 then ' by PR #' else ' (#' end, cast(event_id as string), case when event_id % 4 = 0 then '' else ')' end,
              case when event_id % 5 = 0 then chr(10) || chr(10) || 'fix: not the header' else '' end) as message,
       case event_id % 20 when 13 then 'notes on security' when 3 then 'BREAKING CHANGE: all of it' when 15 then 'security comes first' end as body,
       case when ts < timestamp '2024-01-29 00:00:00' then concat('v1.',
       cast(date_part('day', ts) as string), '.0') end as tag
from events""",
    "v_scores": """
select l.doc_id, d.source, 'quality' as name, l.quality as value
from labels l join documents d on d.doc_id = l.doc_id
union all
select l.doc_id, d.source, 'toxic', l.toxic
from labels l join documents d on d.doc_id = l.doc_id""",
    "v_stats": """
select event_id, event_type as container, ts, value / 5 as cpu_pct,
       cast(cast(value as decimal(12,2)) * 20000000 as bigint) as mem_used_bytes
from events""",
    "v_probes": """
select event_id, cast(user_id as string) as host, ts,
       case when event_id % 3 = 0 or (user_id % 7 = 3 and event_id % 3 = 2) then 'web' when event_id % 3 = 1 then 'object_store' else 'analytics' end as component,
       case when user_id % 5 = 0 then 200 else case event_type when 'view' then 200 when 'click' then 302 when 'signup' then 403 when 'purchase' then 500 else null end end as http_code
from events""",
    "v_updates": """
select event_id as seq, md5(cast(user_id as string)) as trace_id, ts, event_type as meta_key,
       cast(event_id as string) as meta_value
from events""",
    "v_actual_cost": """
select p_brand as model,
       cast(sum(cast(l_extendedprice as decimal(14,2)) * case when cast(substr(p_brand, 7) as int) % 7 = 4 then 0 else 94 + cast(substr(p_brand, 7) as int) % 13 end) as double) / 1000000 as actual_cost
from lineitem
join part on p_partkey = l_partkey
where cast(substr(p_brand, 7) as int) % 7 <> 3
group by p_brand""",
    "v_deps": """
select distinct cast(c_custkey % 150 as string) as service, cast(case when c_custkey % 150 % 3 = 0 then (c_nationkey // 5 + 1) * 5 else c_nationkey end as string) as depends_on,
       'service_healthy' as condition
from customer""",
}

# Views that read other views.
_NEEDS = {"v_primary": ["v_files"], "v_replica": ["v_files"]}


def with_views(body: str, *names: str) -> str:
    """``WITH v1 AS (...), v2 AS (...) <body>`` for the named views (dependencies first)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in _NEEDS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({VIEW_SQL[n].strip()})" for n in ordered]
    return "with " + ",\n".join(parts) + "\n" + body.strip()

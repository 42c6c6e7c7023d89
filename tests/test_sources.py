"""Sources and sinks on small literal files in a fresh temporary folder."""

import datetime as dt
import json
import os

from fleetscope import sources
from tests.conftest import rows


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_service_logs_and_bracketed(spark, tmp_path):
    _write(f"{tmp_path}/logs/web/out.log", "[2025-01-31 02:00:00] INFO: started\nplain line\n")
    _write(f"{tmp_path}/logs/worker/out.log",
           "[2025-01-31 02:00:05] ERROR: boom\n[Step 3/10] migrating\n==========\n")
    df = sources.read_service_logs(spark, f"{tmp_path}/logs")
    assert rows(df, "service", "message")[0] == ("web", "[2025-01-31 02:00:00] INFO: started")
    parsed = rows(sources.parse_bracketed_logs(df), "service", "level", "text")
    assert ("worker", "ERROR", "boom") in parsed
    assert ("worker", None, "[Step 3/10] migrating") in parsed
    assert ("worker", None, "==========") in parsed


def _listing(rows_):
    """Fixed-width listing: every column is as wide as its widest cell plus three spaces."""
    header = ["CONTAINER ID", "IMAGE", "COMMAND", "CREATED", "STATUS", "PORTS", "NAMES"]
    table = [header] + rows_
    widths = [max(len(r[i]) for r in table) + 3 for i in range(len(header))]
    return "\n".join("".join(c.ljust(w) for c, w in zip(r[:-1], widths)) + r[-1] for r in table) + "\n"


LISTING = _listing([
    ["a1a599edec78", "app-server:latest", '"/entrypoint.sh"', "26 minutes ago", "Up 26 minutes (healthy)",
     "0.0.0.0:7473-7474->7473-7474/tcp, 7687/tcp", "svc_one"],
    ["23cf99718e33", "ghcr.io/org/tool", '"/server/run"', "2 days ago", "Exited (143) 29 hours ago", "", "svc_two"],
])


def test_container_snapshots_use_header_offsets(spark, tmp_path):
    _write(f"{tmp_path}/snaps/host-a/ps-1.txt", LISTING)
    df = sources.read_container_snapshots(spark, f"{tmp_path}/snaps")
    got = rows(df, "host", "container_id", "image", "status", "name")
    assert got == [("host-a", "23cf99718e33", "ghcr.io/org/tool", "Exited (143) 29 hours ago", "svc_two"),
                   ("host-a", "a1a599edec78", "app-server:latest", "Up 26 minutes (healthy)", "svc_one")]
    ports = rows(df.filter("ports is not null"), "ports")
    assert ports == [("0.0.0.0:7473-7474->7473-7474/tcp, 7687/tcp",)]


def test_api_responses(spark, tmp_path):
    page = {"data": [{"id": "t1", "timestamp": "2024-01-01T00:00:00Z", "latency": 6200.0, "totalCost": 0.12,
                      "metadata": {"tempo_trace_id": "abc"}}]}
    _write(f"{tmp_path}/traces/p1.json", json.dumps(page))
    t = sources.read_traces(spark, f"{tmp_path}/traces").collect()[0]
    assert (t.trace_id, t.latency_ms, str(t.total_cost), t.metadata["tempo_trace_id"]) == ("t1", 6200.0, "0.120000", "abc")
    prom = {"status": "success", "data": {"resultType": "vector", "result": [
        {"metric": {"__name__": "cpu", "trace_id": "x"}, "value": [1704067200.5, "1.5"]},
        {"metric": {"__name__": "cpu", "trace_id": "y"}, "value": [1704067200, "NaNx"]}]}}
    _write(f"{tmp_path}/prom/r1.json", json.dumps(prom))
    _write(f"{tmp_path}/prom/r2.json", json.dumps({"status": "success", "data": {"resultType": "vector", "result": []}}))
    m = rows(sources.read_metric_samples(spark, f"{tmp_path}/prom"), "metric", "value", "ts")
    assert m == [("cpu", 1.5, dt.datetime(2024, 1, 1, 0, 0, 0, 500000)), ("cpu", None, dt.datetime(2024, 1, 1))]
    spans = {"traces": [{"traceID": "ABC", "rootServiceName": "web", "spans": [
        {"spanID": "1", "name": "memory_search", "startTimeUnixNano": "1704067200000000000", "durationMs": 12.0}]}]}
    _write(f"{tmp_path}/spans/s1.json", json.dumps(spans))
    s = sources.read_spans(spark, f"{tmp_path}/spans").collect()[0]
    assert (s.trace_id, s.span_id, s.service) == ("0" * 29 + "abc", "0" * 15 + "1", "web")
    assert s.start_ts == dt.datetime(2024, 1, 1)


def test_file_catalog_reads_no_content(spark, tmp_path):
    _write(f"{tmp_path}/bk/h1/backup-2024-01-01_02-00-00.tar.gz", "x" * 10)
    _write(f"{tmp_path}/bk/h1/backup-latest.tar.gz", "y")
    _write(f"{tmp_path}/bk/h1/notes.txt", "z")
    df = sources.read_file_catalog(spark, f"{tmp_path}/bk")
    assert rows(df, "host", "name", "size_bytes", "is_link") == [
        ("h1", "backup-2024-01-01_02-00-00.tar.gz", 10, False), ("h1", "backup-latest.tar.gz", 1, True)]


def test_config_files(spark, tmp_path):
    _write(f"{tmp_path}/cfg/backup.conf", "# header\nDAYS=7   # keep\n\nDIR=\"/x y\"\n")
    got = rows(sources.read_config_kv(spark, f"{tmp_path}/cfg"), "line_no", "key", "value", "is_comment")
    assert got == [(1, None, None, True), (2, "DAYS", "7", False), (4, "DIR", "/x y", False)]


def test_commits_landing_and_sinks(spark, tmp_path):
    _write(f"{tmp_path}/git/log.json", json.dumps({"sha": "a", "ts": "2024-01-01 00:00:00", "message": "feat: x",
                                                   "body": None, "tag": "v1.0.0"}) + "\n")
    c = sources.read_commits(spark, f"{tmp_path}/git")
    assert c.collect()[0].tag == "v1.0.0"
    _write(f"{tmp_path}/store/events/e1.json", json.dumps({"event_id": "e1", "ts": "2024-01-01T00:00:00Z",
                                                          "type": "trace-create", "trace_id": "t"}) + "\n")
    ev = sources.read_event_landing(spark, f"{tmp_path}/store")
    assert ev.count() == 1
    out = sources.export_batch(ev.selectExpr("*", "to_date(ts) as day"), f"{tmp_path}/sink")
    assert os.path.isdir(os.path.join(out, "day=2024-01-01"))
    rep = sources.write_report(c, f"{tmp_path}/report")
    assert spark.read.json(rep).count() == 1


def test_service_from_file_name(spark, tmp_path):
    _write(f"{tmp_path}/all/web.log", "ERROR: a\nfine\n")
    _write(f"{tmp_path}/all/redis.log", "ok\n")
    df = sources.read_service_logs(spark, f"{tmp_path}/all", service_from="file")
    assert rows(df, "service", "message") == [("redis", "ok"), ("web", "ERROR: a"), ("web", "fine")]


def test_broken_page_fails_the_read(spark, tmp_path):
    import pytest

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"data": [{"id": "x"}]}')
    (tmp_path / "t" / "b.json").write_text('{"data": [{"id": ')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sources.read_traces(spark, str(tmp_path / "t")).collect()


def test_second_export_of_a_day_replaces_it(spark, tmp_path):
    day = spark.sql("select 1 as x, date'2024-01-01' as day")
    other = spark.sql("select 2 as x, date'2024-01-02' as day")
    for df in (day, other, day):
        target = sources.export_batch(df, str(tmp_path))
    assert sorted(r.x for r in spark.read.parquet(target).collect()) == [1, 2]


def test_service_log_lines_have_their_time(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "current").write_text("[2024-01-02 03:04:05] ERROR: x\n2024-01-02T03:04:06 ok\nplain\n")
    got = {r.message: str(r.ts) for r in sources.read_service_logs(spark, str(tmp_path)).collect()}
    assert got == {"[2024-01-02 03:04:05] ERROR: x": "2024-01-02 03:04:05", "2024-01-02T03:04:06 ok": "2024-01-02 03:04:06", "plain": "None"}

"""Status classification, endpoint codes, version drift, readiness and the fleet roll-up."""


from fleetscope.operators import fleet
from tests.conftest import rows


def test_classify_status_unhealthy_before_healthy(spark):
    df = spark.createDataFrame([(s,) for s in ["Up 5 minutes (healthy)", "Up 2 hours (unhealthy)", "Up 26 minutes",
                                               "Up 3 seconds (health: starting)", "Exited (143) 29 hours ago",
                                               "Created", None, ""]], "status string")
    got = rows(fleet.classify_status(df), "status", "state", "exit_code", "severity")
    by = {r[0]: r[1:] for r in got}
    assert by["Up 2 hours (unhealthy)"] == ("unhealthy", None, 2)
    assert by["Up 5 minutes (healthy)"] == ("healthy", None, 0)
    assert by["Up 26 minutes"] == ("pending", None, 1)
    assert by["Up 3 seconds (health: starting)"] == ("pending", None, 1)
    assert by["Exited (143) 29 hours ago"] == ("not_running", 143, 2)
    assert by["Created"][0] == "not_running"
    assert by[None][0] == "missing" and by[""][0] == "missing"


def test_endpoint_codes_include_403_for_object_store(spark):
    df = spark.createDataFrame([("web", 302), ("web", 403), ("object_store", 403), ("analytics", None),
                                ("other", 200)], "component string, http_code int")
    got = rows(fleet.classify_endpoint(df), "component", "http_code", "accepted", "outcome", "severity")
    assert ("object_store", 403, True, "ok", 0) in got
    assert ("web", 403, False, "failed", 2) in got
    assert ("analytics", None, False, "no_answer", 1) in got
    assert ("other", 200, False, "failed", 2) in got


def test_version_drift_is_numeric_and_suffix_aware(spark):
    pinned = spark.createDataFrame([("a", "3.97.10"), ("b", "15.7-alpine"), ("c", "1.0"), ("d", "2.0"), ("e", "v1.2")],
                                   "service string, pinned string")
    other = spark.createDataFrame([("a", "3.98.0"), ("b", "17-alpine"), ("c", "latest"), ("e", "1.2")],
                                  "service string, newest string")
    got = dict(rows(fleet.version_drift(pinned, other), "service", "status"))
    assert got == {"a": "update_available", "b": "update_available", "c": "unknown", "d": "unknown", "e": "latest"}
    ahead = spark.createDataFrame([("x", "2.10.0")], "service string, pinned string")
    older = spark.createDataFrame([("x", "2.9.9")], "service string, newest string")
    assert fleet.version_drift(ahead, older).collect()[0].status == "ahead"
    assert fleet.version_drift(ahead, older, mode="string").collect()[0].status == "update_available"


def test_ready_services_one_hop(spark):
    deps = spark.createDataFrame([("web", "db"), ("web", "cache"), ("worker", "db"), ("backup", "gone")],
                                 "service string, depends_on string")
    status = spark.createDataFrame([("db", "healthy"), ("cache", "pending")], "host string, state string")
    got = rows(fleet.ready_services(deps, status), "service", "ready", "n_healthy")
    assert got == [("backup", False, 0), ("web", False, 1), ("worker", True, 1)]


def test_missing_expected_and_roll_up(spark):
    seen = spark.createDataFrame([("h1", "web"), ("h1", "redis"), ("h2", "web")], "host string, name string")
    got = rows(fleet.missing_expected(["web", "redis"], seen), "host", "name")
    assert got == [("h2", "redis")]
    checks = spark.createDataFrame([("h1", 0), ("h1", 1), ("h2", 2), ("h3", 0)], "host string, severity int")
    got = rows(fleet.fleet_health(checks), "host", "overall", "n_warnings", "n_errors")
    assert got == [("h1", "warning", 1, 0), ("h2", "error", 0, 1), ("h3", "healthy", 0, 0)]


def test_checks_from_every_source_roll_up(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    containers = fleet.classify_status(spark.createDataFrame(
        [("h1", t, "Up 1 minute (healthy)"), ("h2", t, "Up 1 minute (healthy)"), ("h3", t, "Up 1 minute (healthy)")],
        "host string, snapshot_ts timestamp_ntz, status string"))
    fresh = spark.createDataFrame([("h1", t, "ok"), ("h2", None, "no_backups"), ("h3", t, "ok")],
                                  "host string, mtime timestamp_ntz, status string")
    logs = spark.createDataFrame([("h3", t)], "host string, ts timestamp_ntz")
    dbs = spark.createDataFrame([("h1", t, "postgres", False), ("h3", t, "redis", True)],
                                "host string, ts timestamp_ntz, component string, ok boolean")
    checks = fleet.build_checks(containers, freshness=fresh, log_errors=logs, databases=dbs)
    got = rows(fleet.fleet_health(checks), "host", "overall", "n_errors", "n_warnings")
    assert got == [("h1", "error", 1, 0), ("h2", "warning", 0, 1), ("h3", "warning", 0, 1)]

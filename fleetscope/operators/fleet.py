"""Fleet-health operators: FL6, FL12, FL13, JN4, JN6, JN7, AG9."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import version_key

# Severity levels used by every check.
OK, WARNING, ERROR = 0, 1, 2


def classify_status(snap: DataFrame, status: str = "status") -> DataFrame:
    """FL12: ``missing / not_running / unhealthy / healthy / pending`` from docker status text.

    ``(unhealthy)`` is tested before ``(healthy)``; a running container
    without a health check, or still starting, is ``pending``.  The exit code
    comes from ``Exited (143) ...``.
    """
    s = F.col(status)
    state = (F.when(s.isNull() | (F.trim(s) == ""), "missing")
             .when(~s.startswith("Up"), "not_running")
             .when(s.contains("(unhealthy)"), "unhealthy")
             .when(s.contains("(healthy)"), "healthy")
             .otherwise("pending"))
    code = F.nullif(F.regexp_extract(s, r"^Exited \((\d+)\)", 1), F.lit("")).try_cast("int")
    return snap.withColumns({"state": state, "exit_code": code}).withColumn(
        "severity", F.when(F.col("state") == "healthy", OK).when(F.col("state") == "pending", WARNING).otherwise(ERROR))


def project_containers(snap: DataFrame, project: str, by: str = "name", labels: str = "labels",
                       name: str = "host") -> DataFrame:
    """FL6: containers of one compose project, by name prefix (``<project>-...`` or ``<project>_...``) or project label."""
    if by == "label":
        return snap.filter(F.try_element_at(F.col(labels), F.lit("com.docker.compose.project")) == project)
    return snap.filter((F.col(name) == project) | F.col(name).startswith(f"{project}-") | F.col(name).startswith(f"{project}_"))


# Accepted HTTP codes and the severity of a failed probe per component.
ACCEPTED_CODES = {"web": [200, 301, 302], "object_store": [200, 403], "analytics": [200]}
FAILURE_SEVERITY = {"web": ERROR, "object_store": WARNING, "analytics": WARNING}


def classify_endpoint(probes: DataFrame, accepted: Mapping[str, Sequence[int]] = ACCEPTED_CODES,
                      failure_severity: Mapping[str, int] = FAILURE_SEVERITY, component: str = "component",
                      code: str = "http_code") -> DataFrame:
    """FL13: HTTP code in the accepted set of the component; no answer is a failure.

    The accepted sets are a literal map, so this is a projection, not a join.
    """
    codes = F.create_map(*[x for k, v in accepted.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    sev = F.create_map(*[x for k, v in failure_severity.items() for x in (F.lit(k), F.lit(v))])
    ok = F.coalesce(F.array_contains(F.try_element_at(codes, F.col(component)), F.col(code)), F.lit(False))
    outcome = F.when(F.col(code).isNull(), "no_answer").when(ok, "ok").otherwise("failed")
    severity = F.when(ok, OK).otherwise(F.coalesce(F.try_element_at(sev, F.col(component)), F.lit(ERROR)))
    return probes.withColumns({"accepted": ok, "outcome": outcome, "severity": severity})


def missing_expected(expected: Sequence[str], observed: DataFrame, host: str = "host", name: str = "name",
                     hosts: DataFrame | None = None) -> DataFrame:
    """JN4: per host, each expected name with no observed row.

    The expected list is a literal array exploded per host (no join), then a
    left-anti join on (host, name) against the distinct observations.
    """
    h = (hosts if hosts is not None else observed).select(host).distinct()
    want = h.select(host, F.explode(F.array(*[F.lit(x) for x in expected])).alias(name))
    seen = observed.select(host, name).distinct()  # reduced map-side before the shuffle
    return want.join(seen, [host, name], "left_anti")


def version_drift(pinned: DataFrame, other: DataFrame, key: str = "service", pinned_col: str = "pinned",
                  other_col: str = "newest", mode: str = "version") -> DataFrame:
    """JN6: ``latest / update_available / ahead / unknown`` per pinned service.

    Versions compare part by part as int arrays, missing parts as 0; ``-suffix`` is dropped and a
    non-numeric version (``latest``, dated tags) gives ``unknown``.
    ``mode='string'`` keeps the plain "differs means update" rule.
    """
    j = pinned.select(key, pinned_col).join(other.select(key, other_col), key, "left")
    p, o = F.col(pinned_col), F.col(other_col)
    if mode == "string":
        status = F.when(o.isNull(), "unknown").when(p == o, "latest").otherwise("update_available")
    else:
        pv, ov = version_key(p), version_key(o)
        status = (F.when(o.isNull() | pv.isNull() | ov.isNull(), "unknown").when(pv == ov, "latest")
                  .when(pv < ov, "update_available").otherwise("ahead"))
    return j.withColumn("status", status)


def latest_state(classified: DataFrame, key: str | Sequence[str] = "host", ts: str = "snapshot_ts",
                 keep: Sequence[str] = ("state",)) -> DataFrame:
    """The newest row per key, e.g. per (host, container); ``max(struct)`` is partially aggregated."""
    keys = [key] if isinstance(key, str) else list(key)
    g = classified.groupBy(*keys).agg(F.max(F.struct(ts, *keep)).alias("_m"))
    return g.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*keep, ts)])


def ready_services(deps: DataFrame, status: DataFrame, service: str = "service", dep: str = "depends_on",
                   key: str = "host", state: str = "state") -> DataFrame:
    """JN7: a service may start when every dependency is healthy (one hop)."""
    s = status.select(F.col(key).alias(dep), F.col(state).alias("_dep_state"))
    j = deps.join(s, dep, "left")
    healthy = F.coalesce(F.col("_dep_state") == "healthy", F.lit(False))
    g = j.groupBy(service).agg(F.count(F.lit(1)).alias("n_deps"), F.count_if(healthy).alias("n_healthy"),
                               F.bool_and(healthy).alias("ready"))
    return g


# Severity of the other checks when they fail.
BACKUP_SEVERITY = WARNING       # stale or missing backups only warn
LOG_ERRORS_SEVERITY = WARNING   # recent error lines only warn
DATABASE_SEVERITY = ERROR       # a database that does not answer is an error


def build_checks(containers: DataFrame | None = None, endpoints: DataFrame | None = None,
                 freshness: DataFrame | None = None, log_errors: DataFrame | None = None,
                 databases: DataFrame | None = None, missing: DataFrame | None = None, host: str = "host") -> DataFrame:
    """The ``checks`` table: host, ts, component, check_name, severity.

    * ``containers``: output of ``classify_status`` (state and severity per snapshot);
    * ``endpoints``: output of ``classify_endpoint``;
    * ``freshness``: output of ``catalog.backup_freshness`` (``warn`` / ``no_backups`` warn);
    * ``log_errors``: error lines with ``host`` and ``ts`` (each host with any is a warning);
    * ``databases``: probe rows ``host, ts, component, ok`` (a failed probe is an error);
    * ``missing``: output of ``missing_expected`` (an expected container that is not there is an error).
    Give the newest row per component (``latest_state``), so that an old failure does not count for ever.
    Every check is evaluated and kept; the roll-up comes after.
    """
    parts = []
    if containers is not None:
        parts.append(containers.select(host, F.col("snapshot_ts").alias("ts"), F.lit("container").alias("component"),
                                       F.col("state").alias("check_name"), "severity"))
    if endpoints is not None:
        parts.append(endpoints.select(host, "ts", "component", F.col("outcome").alias("check_name"), "severity"))
    if freshness is not None:
        parts.append(freshness.select(host, F.col("mtime").alias("ts"), F.lit("backup").alias("component"),
                                      F.col("status").alias("check_name"),
                                      F.when(F.col("status") == "ok", OK).otherwise(BACKUP_SEVERITY).alias("severity")))
    if log_errors is not None:
        g = log_errors.groupBy(host).agg(F.max("ts").alias("ts"))
        parts.append(g.select(host, "ts", F.lit("logs").alias("component"), F.lit("errors_found").alias("check_name"),
                              F.lit(LOG_ERRORS_SEVERITY).alias("severity")))
    if databases is not None:
        parts.append(databases.select(host, "ts", "component",
                                      F.when(F.col("ok"), "ok").otherwise("failed").alias("check_name"),
                                      F.when(F.col("ok"), OK).otherwise(DATABASE_SEVERITY).alias("severity")))
    if missing is not None:
        parts.append(missing.select(host, F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("container").alias("component"),
                                    F.lit("missing").alias("check_name"), F.lit(ERROR).alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fleet_health(checks: DataFrame, host: str = "host") -> DataFrame:
    """AG9: overall state per host is the worst severity; counts per level."""
    g = checks.groupBy(host).agg(
        F.max("severity").alias("worst"), F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("severity") == ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"))
    overall = F.when(F.col("worst") >= ERROR, "error").when(F.col("worst") == WARNING, "warning").otherwise("healthy")
    return g.withColumn("overall", overall)

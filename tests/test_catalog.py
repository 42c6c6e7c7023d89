"""Backup catalog: pruning boundary, latest rules, mirror diff with exclusions, parity, retention."""

import datetime as dt

from fleetscope.operators import catalog
from tests.conftest import rows

AS_OF = dt.datetime(2024, 2, 15)


def _files(spark, items):
    return spark.createDataFrame(items, "host string, name string, size_bytes long, mtime timestamp_ntz, is_link boolean")


def test_prune_removes_from_31_whole_days(spark):
    f = _files(spark, [("h", f"backup-{d}.tar.gz", 1, AS_OF - dt.timedelta(days=d, seconds=1), False)
                       for d in (29, 30, 31)] + [("h", "backup-latest.tar.gz", 1, AS_OF - dt.timedelta(days=40), True)])
    got = rows(catalog.prune(f, AS_OF, 30), "name", "age_days")
    assert got == [("backup-31.tar.gz", 31)]
    # a one-hour leeway keeps more: 31 days + 1 s - 1 h is 30 whole days
    assert catalog.prune(f, AS_OF, 30, leeway=3600).count() == 0
    assert rows(catalog.prune(f, AS_OF, 28, prefix="backup-3"), "name") == [("backup-30.tar.gz",), ("backup-31.tar.gz",)]


def test_latest_by_mtime_and_by_name(spark):
    f = _files(spark, [("h", "backup-2024-01-02_02-00-00.tar.gz", 1, dt.datetime(2024, 1, 2, 2), False),
                       ("h", "backup-manual-2023-12-01_10-00-00.tar.gz", 1, dt.datetime(2023, 12, 1, 10), False),
                       ("h", "backup-latest.tar.gz", 1, dt.datetime(2024, 1, 3), True)])
    assert catalog.latest_backup(f, "mtime").collect()[0].name == "backup-2024-01-02_02-00-00.tar.gz"
    assert catalog.latest_backup(f, "name").collect()[0].name == "backup-manual-2023-12-01_10-00-00.tar.gz"


def test_mirror_diff_actions_and_exclusions(spark):
    t = dt.datetime(2024, 1, 1)
    p = _files(spark, [("h", "a.tar.gz", 1, t, False), ("h", "b.tar.gz", 1, t, False), ("h", "c.tar.gz", 1, t, False),
                       ("h", "sync.log", 1, t, False)])
    r = _files(spark, [("h", "b.tar.gz", 2, t, False), ("h", "c.tar.gz", 1, t, False), ("h", "d.tar.gz", 1, t, False),
                       ("h", "report.log", 1, t, False)])
    got = dict(rows(catalog.mirror_diff(p, r, exclude=catalog.DEFAULT_EXCLUDES), "name", "action"))
    assert got == {"a.tar.gz": "copy", "b.tar.gz": "update", "c.tar.gz": "same", "d.tar.gz": "delete"}


def test_count_parity_ignores_links(spark):
    t = dt.datetime(2024, 1, 1)
    p = _files(spark, [("h", "a", 1, t, False), ("h", "latest", 1, t, True)])
    r = _files(spark, [("h", "a", 1, t, False)])
    assert rows(catalog.count_parity(p, r), "host", "n_primary", "n_replica", "counts_match") == [("h", 1, 1, True)]


def test_match_names_globs(spark):
    t = dt.datetime(2024, 1, 1)
    f = _files(spark, [("h", n, 1, t, False) for n in ["backup-1.tar.gz", "backup-1.tar.gz.log", ".DS_Store",
                                                       "other-1.tar.gz", "backupx1.tar.gz"]])
    assert rows(catalog.match_names(f, prefix="backup"), "name") == [("backup-1.tar.gz",)]


def test_freshness_and_missed_runs(spark):
    f = _files(spark, [("h1", "x", 1, dt.datetime(2024, 1, 30, 0, 0, 1), False),
                       ("h2", "y", 1, dt.datetime(2024, 1, 28, 23), False)])
    hosts = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "host string")
    got = rows(catalog.backup_freshness(f, hosts, "2024-01-31 00:00:00"), "host", "age_hours", "status")
    assert got == [("h1", 23, "ok"), ("h2", 49, "warn"), ("h3", None, "no_backups")]
    miss = rows(catalog.missed_runs(f, "2024-01-28", "2024-01-30", hosts=hosts), "host", "day")
    assert len(miss) == 2 + 2 + 3


def test_tiered_retention_keeps_newest_per_period(spark):
    items = [("h", f"b{d:02d}-{hh}", 1, dt.datetime(2024, 1, d, hh), False) for d in range(1, 31) for hh in (2, 14)]
    f = _files(spark, items)
    out = catalog.tiered_retention(f, dt.datetime(2024, 1, 31), daily=7, weekly=4, monthly=12)
    kept = {r.name for r in out.filter("keep").collect()}
    # newest of each of the last 7 days (Jan 25-30 have data)
    assert {f"b{d:02d}-14" for d in range(25, 31)} <= kept
    # weekly: newest of weeks starting Jan 8, 15, 22, 29
    assert {"b14-14", "b21-14", "b28-14"} <= kept
    assert "b01-02" not in kept and "b10-14" not in kept


def test_rpo_gaps(spark):
    t = dt.datetime(2024, 1, 1)
    f = _files(spark, [("h", "a", 1, t, False), ("h", "b", 1, t + dt.timedelta(hours=24), False),
                       ("h", "c", 1, t + dt.timedelta(hours=50), False)])
    got = rows(catalog.rpo_gaps(f, 24), "prev_name", "name", "gap_seconds")
    assert got == [("b", "c", 26 * 3600)]


def test_list_backups_without_a_limit_numbers_everything(spark):
    f = _files_of_days(spark, 5)
    for by in ("mtime", "name"):
        assert [r.number for r in catalog.list_backups(f, None, by).orderBy("number").collect()] == [1, 2, 3, 4, 5]
        assert catalog.list_backups(f, 2, by).count() == 2


def _files_of_days(spark, n):
    rows_ = [("h", f"backup-{d:02d}.tar.gz", 10, dt.datetime(2024, 1, d)) for d in range(1, n + 1)]
    return spark.createDataFrame(rows_, "host string, name string, size_bytes long, mtime timestamp_ntz")


def test_growth_is_per_day_and_newer_files_are_kept(spark):
    gib = 1024 ** 3
    f = spark.createDataFrame([("h", "a", gib, dt.datetime(2024, 1, 1)), ("h", "b", 4 * gib, dt.datetime(2024, 1, 11)),
                               ("h", "c", 6 * gib, dt.datetime(2024, 1, 12))],
                              "host string, name string, size_bytes long, mtime timestamp_ntz")
    assert [r.over_limit for r in catalog.storage_growth(f).orderBy("day").collect()] == [False, False, True]
    kept = {r.name: r.keep for r in catalog.tiered_retention(f, dt.datetime(2024, 1, 11, 12)).collect()}
    assert kept == {"a": False, "b": True, "c": True} or kept["c"] is True


def test_prune_only_plans_archives(spark):
    f = spark.createDataFrame([("h", "notes.txt", 1, dt.datetime(2020, 1, 1)), ("h", "backup-1.tar.gz", 1, dt.datetime(2020, 1, 1))],
                              "host string, name string, size_bytes long, mtime timestamp_ntz")
    assert [r.name for r in catalog.prune(f, "2024-02-15 00:00:00", 30).collect()] == ["backup-1.tar.gz"]

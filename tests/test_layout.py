"""Where rows and files go: export layout, folder listings, numbering by name, mirror defaults."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fleetscope.operators import catalog, fleet
from fleetscope.sources import export_batch, list_files
from tests.conftest import rows


def _parts(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_export_gathers_small_days_and_cuts_large_files(spark, tmp_path):
    df = spark.range(0, 5000, 1, 16).select("id", F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("day"))
    export_batch(df, str(tmp_path))
    assert {d: len(_parts(tmp_path / "exports" / d)) for d in os.listdir(tmp_path / "exports") if "=" in d} == {f"day=d{i}": 1 for i in range(4)}
    export_batch(df.filter("day = 'd1'"), str(tmp_path), rows_per_file=500)  # 1250 rows
    assert len(_parts(tmp_path / "exports" / "day=d1")) == 3 and len(_parts(tmp_path / "exports" / "day=d2")) == 1
    assert spark.read.parquet(str(tmp_path / "exports")).count() == 5000


def test_folders_are_listed_with_links(spark, tmp_path):
    for host in ("h1", "h2/deep"):
        (tmp_path / host).mkdir(parents=True)
        for name in ("backup-1.tar.gz", "backup-2.tar.gz", "notes.txt"):
            (tmp_path / host / name).write_bytes(b"x" * 10)
    os.symlink("backup-2.tar.gz", tmp_path / "h1" / "current.tar.gz")  # fits no glob for links
    os.symlink("missing.tar.gz", tmp_path / "h1" / "dead.tar.gz")
    os.symlink(tmp_path / "h2", tmp_path / "h1" / "folder-link")
    os.utime(tmp_path / "h1" / "backup-1.tar.gz", (1704067200, 1704067200))
    os.chmod(tmp_path / "h1" / "backup-1.tar.gz", 0)  # contents are never read
    df = list_files(spark, str(tmp_path))
    got = rows(df, "host", "name", "is_link")
    assert got == [("deep", "backup-1.tar.gz", False), ("deep", "backup-2.tar.gz", False), ("h1", "backup-1.tar.gz", False),
                   ("h1", "backup-2.tar.gz", False), ("h1", "current.tar.gz", True), ("h1", "dead.tar.gz", True)]
    assert df.rdd.getNumPartitions() == 4  # the root, h1, h2 and h2/deep
    one = df.filter("host = 'h1' and name = 'backup-1.tar.gz'").collect()[0]
    assert (one.size_bytes, one.mtime) == (10, dt.datetime(2024, 1, 1))
    pushed = df.filter(F.col("name").startswith("backup-") & F.col("name").endswith("2.tar.gz") & ~F.col("is_link"))
    assert rows(pushed, "host") == [("deep",), ("h1",)]
    assert rows(list_files(spark, f"{tmp_path}/h*", glob="*.txt"), "name") == [("notes.txt",)] * 2
    assert list_files(spark, f"{tmp_path}/none").count() == 0
    assert rows(catalog.latest_backup(list_files(spark, str(tmp_path / "h2"), host="x"), "name"), "host", "name") == [("x", "backup-2.tar.gz")]


def test_numbering_by_name_divides_a_hot_host(spark):
    base = dt.datetime(2024, 1, 1)
    files = [("hot", f"backup-2024-01-01_00-00-00-same-prefix-{i:05d}.tar.gz", 1, base) for i in range(2000)] + [("cold", "a", 1, base), ("cold", "b", 1, base)]
    df = spark.createDataFrame(files, "host string, name string, size_bytes long, mtime timestamp_ntz")
    got = {(r.host, r.name): r.number for r in catalog.list_backups(df, None, "name").collect()}
    assert got == {("hot", f[1]): 2000 - i for i, f in enumerate(files[:2000])} | {("cold", "b"): 1, ("cold", "a"): 2}
    bounds = catalog._name_ranges(df, 64)
    names = sorted(f[1] for f in files)
    sizes = [sum(lo <= n < hi for n in names) for lo, hi in zip(["", *bounds], [*bounds, "~"])]
    assert len(bounds) == 63 and max(sizes) < 100
    assert catalog.list_backups(df.limit(0), None, "name").count() == 0


def test_mirror_leaves_lock_files_alone(spark):
    f = lambda *names: spark.createDataFrame([("h", n, 1, dt.datetime(2024, 1, 1)) for n in names],
                                             "host string, name string, size_bytes long, mtime timestamp_ntz")
    got = rows(catalog.mirror_diff(f("a", "x.log"), f("a", "b", ".sync-lock", ".DS_Store")), "name", "action")
    assert got == [("a", "same"), ("b", "delete")]
    assert ("x.log", "copy") in rows(catalog.mirror_diff(f("x.log"), f("a"), exclude=()), "name", "action")


def test_growth_of_written_files(spark):
    day = lambda i: dt.datetime(2024, 1, 1 + i)
    df = spark.createDataFrame([("h", day(i), 2 << 30) for i in range(5)] + [("k", day(0), 1 << 30)], "host string, mtime timestamp_ntz, size_bytes long")
    got = catalog.storage_growth(df, added=True).orderBy("host", "day").collect()
    assert [(r.host, r.bytes, r.growth, r.over_limit) for r in got] == [("h", (i + 1) * (2 << 30), 2 << 30, True) for i in range(5)] + [("k", 1 << 30, 1 << 30, False)]


def test_a_project_is_not_a_prefix_of_another(spark):
    snap = spark.createDataFrame([("shop-web",), ("shop2-web",), ("shop_db",), ("shop",), ("workshop-web",)], "host string")
    assert rows(fleet.project_containers(snap, "shop")) == [("shop",), ("shop-web",), ("shop_db",)]

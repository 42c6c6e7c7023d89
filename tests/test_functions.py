"""Scalar expressions SF1-SF15 on literal values."""

import datetime as dt

from pyspark.sql import functions as F

from fleetscope import functions as fn


def _one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).collect()[0].y


def test_paths_stamps_and_ages(spark):
    assert _one(spark, fn.base_name, "/a/b/backup-1.tar.gz") == "backup-1.tar.gz"
    assert _one(spark, fn.stamp_from_name, "app-2025-01-31_02-00-00.tar.gz") == dt.datetime(2025, 1, 31, 2)
    assert _one(spark, fn.stamp_from_name, "app-manual-latest.tar.gz") is None
    assert _one(spark, fn.relative_age_seconds, "7 hours ago") == 7 * 3600
    assert _one(spark, fn.relative_age_seconds, "About an hour ago") == 3600
    assert _one(spark, fn.relative_age_seconds, "Up 26 minutes") is None


def test_versions_images_ids(spark):
    assert _one(spark, fn.version_parts, "v3.98.0") == [3, 98, 0]
    assert _one(spark, fn.version_parts, "15.7-alpine") == [15, 7]
    assert _one(spark, fn.version_parts, "RELEASE.2024-01-01") is None
    assert _one(spark, fn.tag_version, "v1.2.0") == "1.2.0"
    img = _one(spark, fn.image_parts, "ghcr.io/org/tool:1.2")
    assert (img.registry, img.repository, img.tag) == ("ghcr.io", "org/tool", "1.2")
    img = _one(spark, fn.image_parts, "postgres")
    assert (img.registry, img.repository, img.tag) == (None, "postgres", "latest")
    assert _one(spark, fn.id_hex, "ABC") == "0" * 29 + "abc"


def test_ports_sizes_text_settings(spark):
    ports = _one(spark, fn.port_rows, "0.0.0.0:7473-7474->7473-7474/tcp, 7687/tcp, 53/udp")
    assert [(p.port, p.protocol) for p in ports] == [(7473, "tcp"), (7474, "tcp"), (7687, "tcp"), (53, "udp")]
    assert _one(spark, fn.port_rows, "") == []
    assert _one(spark, fn.human_size_bytes, "1.5G") == int(1.5 * 1024 ** 3)
    assert _one(spark, fn.human_size_bytes, "512 bytes") == 512
    assert _one(spark, fn.human_size_bytes, "20 MB") == 20 * 1024 ** 2
    assert _one(spark, fn.strip_tags, "<!-- 0 -->Features ") == "Features"
    assert _one(spark, fn.upper_first, "add page") == "Add page"
    assert _one(spark, lambda c: fn.setting_value(c, "bool"), "true") is True
    assert _one(spark, fn.setting_value, "7") == 7 and _one(spark, fn.setting_value, "7d") is None
    assert fn.glob_to_regex("backup-*.tar.gz") == r"^backup-[^/]*\.tar\.gz$"

"""SRC7 (event landing), SRC8 (archive catalog), SRC9 (config files), SRC10 (commit log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import base_name, glob_to_regex
from ..operators.config import parse_config_lines
from . import quarantine

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                             T.StructField("type", T.StringType()), T.StructField("trace_id", T.StringType()),
                             T.StructField("body", T.StringType())])


def read_event_rows(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = EVENT_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC7 with what could not be parsed: see ``quarantine.good_rows``, ``dead_letters`` and ``streaming.sinks.write_split``."""
    lines = quarantine.read_text(spark, f"{path.rstrip('/')}/events/", stream=stream, max_files_per_trigger=max_files_per_trigger)
    return quarantine.parsed(lines, schema, file="file")


def read_event_landing(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType = EVENT_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC7: raw event JSON under the ``events/`` prefix of an object store (batch or stream).

    A broken line is no event; ``read_event_rows`` also gives the dead letters.
    """
    return quarantine.good_rows(read_event_rows(spark, path, stream, schema, max_files_per_trigger))


def read_file_catalog(spark: SparkSession, path: str, glob: str = "*.tar.gz", host: str | None = None,
                      link_glob: str = "*-latest.tar.gz") -> DataFrame:
    """SRC8: path, name, size and mtime of archive files; contents are never read.

    Selecting only ``path, length, modificationTime`` keeps ``content`` out of
    the read schema.  A symlink cannot be told apart by the file source, so
    names matching ``link_glob`` (the conventional link name) are flagged.
    """
    f = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
         .load(path).select("path", "length", "modificationTime"))
    name = base_name("path")
    return f.select(F.lit(host).cast("string").alias("host") if host else
                    F.element_at(F.split("path", "/"), -2).alias("host"),
                    F.lit(path).alias("location"), "path", name.alias("name"),
                    F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
                    name.rlike(glob_to_regex(link_glob)).alias("is_link"))


def read_config_kv(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: ``KEY=VALUE`` files -> file, line_no, key, value, is_comment.

    Configuration files are small, so each is read whole to keep exact line
    numbers.
    """
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("_pos", "line")).select(
        "file", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line").filter(F.trim("line") != "")
    return parse_config_lines(lines)


COMMIT_SCHEMA = T.StructType([T.StructField("sha", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                              T.StructField("message", T.StringType()), T.StructField("body", T.StringType()),
                              T.StructField("tag", T.StringType())])


def read_commit_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC10 (JSON lines) with what could not be parsed."""
    return quarantine.parsed(quarantine.read_text(spark, path), COMMIT_SCHEMA, file="file")


def read_commits(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC10: commit log rows (sha, ts, message, body, tag); a broken line is no commit (see ``read_commit_rows``)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return quarantine.good_rows(read_commit_rows(spark, path))

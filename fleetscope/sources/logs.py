"""SRC1 (service log files) and SRC2 (bracketed log lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name

BRACKETED = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (INFO|WARN|ERROR): (.*)$"


def read_service_logs(spark: SparkSession, path: str, service_from: str = "parent") -> DataFrame:
    """SRC1: one row per log line with its service (both output streams already merged in the file).

    The service is the parent folder of the file (``'parent'``) or the file's
    base name without extension (``'file'``).  ``line_id`` is unique, and
    increases with the position inside a file split.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    return parse_service_lines(raw, service_from).withColumn("line_id", F.monotonically_increasing_id())


#: A time at the start of a log line, in brackets or not.
STAMPED = r"^\[?(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})"


def parse_service_lines(raw: DataFrame, service_from: str = "parent") -> DataFrame:
    """SRC1, parsing half: (value, path) -> service, message, path, ts (null where a line has no time)."""
    parts = F.split("path", "/")
    service = (F.element_at(parts, -2) if service_from == "parent"
               else F.regexp_replace(base_name("path"), r"\.[^.]*$", ""))
    stamp = F.concat_ws(" ", F.regexp_extract("value", STAMPED, 1), F.regexp_extract("value", STAMPED, 2))
    ts = F.when(F.col("value").rlike(STAMPED), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    return raw.select(service.alias("service"), F.col("value").alias("message"), "path", ts.alias("ts"))


def parse_bracketed_logs(df: DataFrame, line: str = "message") -> DataFrame:
    """SRC2: ``[yyyy-MM-dd HH:mm:ss] LEVEL: msg`` -> ts, level, text.

    Lines that do not match (``[Step 3/10] ...``, rules of ``=``) keep
    ``level = null`` and their whole text.
    """
    ok = F.col(line).rlike(BRACKETED)
    ts = F.try_to_timestamp(F.regexp_extract(line, BRACKETED, 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return df.select("*", F.when(ok, ts).alias("ts"), F.when(ok, F.regexp_extract(line, BRACKETED, 2)).alias("level"),
                     F.when(ok, F.regexp_extract(line, BRACKETED, 3)).otherwise(F.col(line)).alias("text"))

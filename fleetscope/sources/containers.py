"""SRC3: fixed-width container listings (``docker ps -a`` output) from many snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import human_size_bytes

# Header names of the listing, in order, and our column names.
HEADERS = [("CONTAINER ID", "container_id"), ("IMAGE", "image"), ("COMMAND", "command"), ("CREATED", "created"),
           ("STATUS", "status"), ("PORTS", "ports"), ("NAMES", "name")]


def read_container_snapshots(spark: SparkSession, path: str, host_from: str = "parent") -> DataFrame:
    """One row per container per snapshot file; column offsets come from each file's header.

    Each file is one snapshot (small, read whole); the snapshot time is the
    file's modification time and the host its parent folder.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("snapshot_ts"))
    return parse_container_listings(files, host_from)


def parse_container_listings(files: DataFrame, host_from: str = "parent") -> DataFrame:
    """Listings as text (value, path, snapshot_ts) -> one row per container."""
    lines = files.select("path", "snapshot_ts", F.split(F.col("value"), "\n").alias("_l"))
    header = F.element_at("_l", 1)
    starts = [F.instr(header, h) for h, _ in HEADERS]
    rows = lines.select("path", "snapshot_ts", header.alias("_h"), *[s.alias(f"_s{i}") for i, s in enumerate(starts)],
                        F.posexplode("_l").alias("_pos", "_line")).filter((F.col("_pos") > 0) & (F.trim("_line") != ""))
    cols = []
    for i, (_, name) in enumerate(HEADERS):
        start = F.col(f"_s{i}")
        if i + 1 < len(HEADERS):
            piece = F.substring(F.col("_line"), start, F.col(f"_s{i + 1}") - start)
        else:
            piece = F.expr(f"substring(_line, _s{i})")
        cols.append(F.nullif(F.trim(piece), F.lit("")).alias(name))
    host = F.element_at(F.split("path", "/"), -2) if host_from == "parent" else F.lit(None).cast("string")
    return rows.select(F.col("snapshot_ts"), host.alias("host"), *cols)


def parse_container_stats(df: DataFrame, cpu: str = "cpu_text", mem: str = "mem_text") -> DataFrame:
    """Container statistics text (``12.5%`` and ``1.2GiB / 4GiB``) -> cpu_pct, mem_used_bytes, mem_limit_bytes."""
    sides = F.split(F.col(mem), r"\s*/\s*")
    return df.withColumns({
        "cpu_pct": F.regexp_extract(cpu, r"^\s*([0-9.]+)\s*%", 1).try_cast("double"),
        "mem_used_bytes": human_size_bytes(F.get(sides, F.lit(0))),
        "mem_limit_bytes": human_size_bytes(F.get(sides, F.lit(1)))})

"""SNK1 (dated batch export) and SNK2 (report tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_batch(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("day",),
                 mode: str = "overwrite", rows_per_file: int = 5_000_000) -> str:
    """SNK1: write under ``<path>/exports/``, partitioned by ``by`` (e.g. the day).

    Partition columns become folders, so later reads prune by date.  Overwriting
    replaces only the partitions in ``df``, so a second run of a day does not
    double it.  Rows are gathered by folder before they are written (REBALANCE),
    so a small day is one file instead of one per task; a large day is dealt to
    several tasks by its size, and no file has more than ``rows_per_file`` rows.
    """
    target = f"{path.rstrip('/')}/exports"
    (df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).partitionBy(*by).format(fmt).save(target))
    return target


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """SNK2: write a report table (file list, volume list, service states)."""
    df.write.mode(mode).format(fmt).save(path)
    return path

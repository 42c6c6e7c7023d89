"""Streaming sinks: a clean table written in micro-batches (SS3's write interval).

``write_stream_table`` uses the file sink, which commits each micro-batch
atomically through its checkpoint.  ``write_once`` also survives what a
checkpoint does not see: a batch that is run again after its checkpoint was
lost, and a repeated id that arrives after its watermark.  One writer per table;
no lock file is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.quarantine import dead_letters, good_rows


def _started(writer, checkpoint: str, interval: str | None, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def write_stream_table(df: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds",
                       available_now: bool = False, fmt: str = "parquet",
                       partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Start appending ``df`` to ``path``; ``interval`` is the write interval, ``available_now`` drains and stops."""
    w = df.writeStream.format(fmt).option("path", path).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return _started(w, checkpoint, interval, available_now)


def _replace(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the partitions of ``df`` in place of what they held."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def once(path: str, key: str = "event_id", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """What ``write_once`` does with a micro-batch: ``path/day=.../batch=.../``.

    A batch replaces its own partitions, so running it again changes nothing.
    Ids that the other batches of the same days hold are left out: a repeated
    event has the same time, so only the days in the batch are read, and of them
    only the id column.  Inside a batch the earliest row of an id stays.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"day": F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date")), "batch": F.lit(number)}).persist()
        try:
            rest = [c for c in rows.columns if c != key]
            first = rows.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in (ts, *[x for x in rest if x != ts])])).alias("_f"))
            first = first.select(*[F.col(c) if c == key else F.col(f"_f.{c}").alias(c) for c in rows.columns])
            days = [r[0] for r in rows.select("day").distinct().collect()]  # a few days a batch
            if not days:
                return
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
                held = spark.read.schema(rows.schema).parquet(path).filter(F.col("day").isin(days) & (F.col("batch") != number))
                first = first.join(held.select(key), key, "left_anti")
            _replace(first, path, ["day", "batch"])
        finally:
            rows.unpersist()

    return write


def write_once(df: DataFrame, path: str, checkpoint: str, key: str = "event_id", ts: str = "ts",
               interval: str | None = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """SS3: append events of which each id is written once, whatever is replayed or repeated (see ``once``)."""
    return _started(df.writeStream.foreachBatch(once(path, key, ts)), checkpoint, interval, available_now)


def write_split(df: DataFrame, good_path: str, dead_path: str, checkpoint: str, interval: str | None = "5 seconds",
                available_now: bool = False) -> StreamingQuery:
    """Rows as read by ``sources.quarantine``: good ones to one table, broken ones to a dead-letter table.

    The source is read once a batch; both tables hold a folder per batch, replaced when it is run again.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number)).persist()
        try:
            _replace(good_rows(rows), good_path, ["batch"])
            _replace(dead_letters(rows, "batch"), dead_path, ["batch"])
        finally:
            rows.unpersist()

    return _started(df.writeStream.foreachBatch(write), checkpoint, interval, available_now)

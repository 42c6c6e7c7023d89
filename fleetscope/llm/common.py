"""Helpers shared by the corpus operators: tables, stored intermediates, text expressions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a source folder (else install it on the cluster)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none (local tests), the warehouse folder is used: it
    is the one other place that a driver and its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back (cuts lineage).

    Most of what is stored are hashes, which do not compress; many small
    compressed files would each hold native buffers in the executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What modules keep in a reused Python worker, as functions that drop it.
KEPT: list = []


def release() -> None:
    """Drop what earlier stages kept in this Python worker and give freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    for forget in KEPT:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run):
    """The Arrow function ``run`` with a worker's memory released before and after it.

    Spark reuses Python workers, so what one stage leaves behind would add to the next one's peak.
    """
    def wrapped(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; ``lower`` is the cheap equal of it for text without other characters."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def bucket_of(df: DataFrame, col: str, splitters: list, out: str) -> DataFrame:
    """Add ``out``: how many of the ascending ``splitters`` are <= ``col`` (binary search in the JVM).

    Null values get bucket 0.  Equal values always share a bucket.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = sorted({float(s) for s in splitters if s is not None})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    as_double = f"__{out}_double"
    df = df.withColumn(as_double, F.coalesce(F.col(col).cast("double"), F.lit(float("-inf"))))
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=as_double, outputCol=out)
    return cutter.transform(df).withColumn(out, F.col(out).cast("int")).drop(as_double)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_join(df: DataFrame, keys: DataFrame, on: str, max_broadcast: int, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join with distinct ``keys``, broadcast only when counted as at most ``max_broadcast`` rows."""
    few = keys.limit(max_broadcast + 1).count() <= max_broadcast
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), on, how)

"""Session construction and cluster-safe settings.

Everything here is ordinary SparkSession configuration.  The engine never
reads the wall clock and never relies on a machine-local folder when running
on a cluster: lineage is cut with ``checkpoint()`` into the shared folder the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Settings sized for a large cluster reading ``input_bytes``.

    Scans split at ``target_partition_bytes``.  Shuffles start with enough
    partitions for the whole input at that size (at least 3 waves of the
    cluster's cores), and AQE coalesces small ones back toward the advisory
    size, so no reducer has to hold more than a few hundred MiB before
    spilling.  A partition 5x the median and above 1 GiB counts as skewed and
    is split.
    """
    cores = executors * cores_per_executor
    initial = max(3 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 ** 3),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
    }


def build_session(master: str | None = None, app: str = "fleetscope",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with UTC time, AQE and skew handling switched on.

    On a cluster pass ``extra=cluster_conf(input_bytes)``; tests use a few
    shuffle partitions on ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` always wins.  A fallback is only
    installed when the setting is unset (local tests), never on top of it.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
    os.makedirs(fallback, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback

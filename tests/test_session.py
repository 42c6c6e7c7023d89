"""Session helpers: cluster sizing and the shared checkpoint folder."""

from fleetscope.session import checkpoint_dir, cluster_conf


def test_cluster_conf_sizes_partitions_for_the_input():
    c = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)
    small = cluster_conf(1024 ** 3, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 3 * 40  # at least three waves of cores


def test_checkpoint_folder_comes_from_the_session(spark):
    current = checkpoint_dir(spark)
    assert current
    df = spark.range(10).checkpoint()
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir().startswith(("file:", "/"))

"""SRC11: the three small database checks over JDBC.

No database runs in this repository's test environment, so this source is
not exercised by the tests; it is plain ``spark.read.jdbc``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The checks (database size, user tables, open connections).
CHECK_QUERIES = {
    "database_size_bytes": "select pg_database_size(current_database()) as v",
    "open_connections": "select count(*) as v from pg_stat_activity",
    "user_tables": "select count(*) as v from system.tables where database != 'system'",
}


def read_jdbc_checks(spark: SparkSession, url: str, properties: dict, checks: dict | None = None) -> DataFrame:
    """One row per check: name and numeric value (each query runs on the database side)."""
    out = None
    for name, q in (checks or CHECK_QUERIES).items():
        df = spark.read.jdbc(url, f"({q}) as t", properties=properties).select(
            F.lit(name).alias("check_name"), F.col("v").cast("double").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out

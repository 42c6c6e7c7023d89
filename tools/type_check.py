"""Compare column types of every Spark query with its DuckDB oracle (names sorted)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from fleetscope.plans.fixtures import TABLES  # noqa: E402
from fleetscope.plans.registry import ORACLES, QUERIES  # noqa: E402
from fleetscope.session import build_session  # noqa: E402


def spark_type(t):
    return {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
            T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
            T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.FloatType: "FLOAT", T.ShortType: "SMALLINT"}.get(
        type(t), f"DECIMAL({t.precision},{t.scale})" if isinstance(t, T.DecimalType) else t.simpleString())


sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = build_session("local[4]", shuffle_partitions=4)
con = duckdb.connect()
for t in TABLES:
    con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
names = sys.argv[2:] or list(ORACLES)
for n in names:
    df = QUERIES[n](spark, sf)
    st = {f.name: spark_type(f.dataType) for f in df.schema.fields}
    rel = con.sql(ORACLES[n])
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diffs = [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)]
    print(("DIFF " if diffs else "SAME ") + n + ("" if not diffs else " " + str(diffs)))

"""Property test: on random series (null keys, gaps, any chunk length) the chunked helpers
equal plain windows."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.plans.ordered import lag_in_series, ordered_index, running_sum, time_chunk
from tests.conftest import rows

BASE = dt.datetime(2024, 1, 1)

series = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 10 * 86400), st.integers(-100, 100)),
                  min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=series, chunk=st.sampled_from([60, 3600, 86400, 7 * 86400]))
def test_helpers_equal_plain_windows(spark, data, chunk):
    df = spark.createDataFrame([(i, k, BASE + dt.timedelta(seconds=s), v) for i, (k, s, v) in enumerate(data)],
                               "id long, k string, ts timestamp_ntz, v long")
    w = Window.partitionBy("k").orderBy("ts")
    want = rows(df.select("id", F.lag("v").over(w), F.sum("v").over(w), F.row_number().over(w)))
    lag = lag_in_series(df, ["k"], ["ts"], ["v"], chunk_seconds=chunk).select("id", "prev_v")
    rs = running_sum(df, ["k"], ["ts"], "v", "rs", chunk_seconds=chunk).select("id", "rs")
    rn = ordered_index(df, ["k"], [F.col("ts")], "rn", chunk=time_chunk("ts", chunk)).select("id", "rn")
    got = rows(lag.join(rs, "id").join(rn, "id").select("id", "prev_v", "rs", "rn"))
    assert got == want

"""Single-node yardstick: seconds per oracle query in DuckDB (median of 3) at a scale factor."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetscope.plans.fixtures import TABLES  # noqa: E402
from fleetscope.plans.registry import ORACLES  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
con = duckdb.connect()
con.execute("set threads to 8")
for t in TABLES:
    con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
out = {}
for name, sql in ORACLES.items():
    ts = []
    for _ in range(3):
        t0 = time.perf_counter()
        con.execute(sql).fetchall()
        ts.append(time.perf_counter() - t0)
    out[name] = round(statistics.median(ts), 3)
print(json.dumps({"total": round(sum(out.values()), 3), "queries": out}))

"""Every registered query against its DuckDB oracle on the supplied tables.

Runs at ``$ORACLE_SF_DIR`` (default sf0.001 to keep the suite quick; the
driver's gate uses sf0.01, which ``tools/oracle_check.py`` also runs).
"""

import os

import duckdb
import pytest

from fleetscope.plans.fixtures import TABLES
from fleetscope.plans.registry import ORACLES, QUERIES
from tools.oracle_check import rows_of

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle_or_a_reason():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())

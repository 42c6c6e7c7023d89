"""The registered queries: ``QUERIES[name](spark, sf_dir)`` and ``ORACLES[name]`` (DuckDB SQL over the base tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT.  Cast every call so types agree."""
    out, i = [], 0
    while True:
        j = sql.find("count_if(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
            if depth == 0:
                break
        out.append(sql[i:j] + "cast(" + sql[j:k] + " as bigint)")
        i = k


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _bigint_count_if(sql)
        return fn
    return deco


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Doubles rounded for the comparison with the oracle; operators themselves do not round."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})

"""Service-log operators: FL1, FL2, WN2, TK2, ST1."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_of_literal

# What counts as an error line (case-insensitive, anywhere in the line).
ERROR_PATTERN = "(?i)error|fatal|panic|exception"


def error_lines(logs: DataFrame, message: str = "message", pattern: str = ERROR_PATTERN) -> DataFrame:
    """FL1: lines whose message matches the error pattern."""
    return logs.filter(F.col(message).rlike(pattern))


def since(df: DataFrame, ts: str, as_of, seconds: int) -> DataFrame:
    """FL2: rows with ``as_of - seconds < ts <= as_of``.

    Both bounds are constants, so the filter reaches the parquet scan.
    """
    hi = as_of_literal(df, ts, as_of)
    lo = hi - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return df.filter((F.col(ts) > lo) & (F.col(ts) <= hi))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 3,
            out: str = "rn") -> DataFrame:
    """WN2: first ``n`` rows per key, numbered from 1.

    ``row_number() <= n`` is planned as a WindowGroupLimit, which also runs
    before the shuffle, so a hot key sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= n)


def tail_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """TK2: the last ``n`` rows by ``order`` (oldest of them first).

    ``orderBy(desc).limit`` plans TakeOrderedAndProject: each task keeps n rows.
    """
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return last.orderBy(*order)


def merge_logs(*dfs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """ST1: all streams in one (``2>&1``), optionally ordered by time."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return merged.orderBy(*order) if order else merged

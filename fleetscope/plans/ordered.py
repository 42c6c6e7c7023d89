"""Order-dependent window work that stays bounded when one series is hot.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends every row of a series
to one task.  If a single series holds a third of the data that task holds a
third of the data.  The helpers below split each series into time chunks
(``floor(epoch / chunk_seconds)``) and run the window per (series, chunk).
What crosses a chunk boundary is carried by a small per-chunk summary:

* ``lag_in_series``   - the last row of the previous non-empty chunk;
* ``running_sum``     - the sum of all earlier chunks;
* ``ordered_index``   - the row count of all earlier chunks.

The summaries have one row per (series, chunk), are built with partial
aggregation (map-side combine), and their own window runs over chunks, not
rows.  The join back is on one struct key ``(series, chunk)``, the same key
the row-level window partitions by, so the big side is shuffled once.  The
input is read twice (once narrowed, for the summaries); an expensive derived
input should be written to a table first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def epoch_seconds(col: str | Column) -> Column:
    """Whole seconds since the epoch; time-zone free for ``timestamp_ntz``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_timestamp(c)


def time_chunk(ts: str | Column, chunk_seconds: int) -> Column:
    """A chunk number that never decreases as ``ts`` grows."""
    return F.floor(epoch_seconds(ts) / F.lit(int(chunk_seconds)))


SKEY = "_sk"


def _series_chunk_key(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add ``_sk = struct(keys..., chunk)``.

    One struct column is both the join key and the window partition key, so
    the join's shuffle already satisfies the window and the big side is
    shuffled once.  Struct equality matches null fields, so null keys form a
    series of their own (as ``partitionBy`` does).
    """
    return df.withColumn(SKEY, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                                        chunk.alias("c")))


def _key_cols(keys: Sequence[str]):
    return [F.col(f"{SKEY}.k{i}") for i in range(len(keys))]


def lag_in_series(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  cols: Sequence[str], chunk_seconds: int = 86400,
                  prefix: str = "prev_", chunk: Column | None = None) -> DataFrame:
    """Add ``prev_<c>`` (and ``prev_<order>``) from the previous row of each series.

    ``order[0]`` must be a timestamp unless ``chunk`` is given; ``chunk`` must
    never decrease along ``order``.  ``order`` should be unique inside a series.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    carried = order + [c for c in cols if c not in order]
    rec = F.struct(*[F.col(c) for c in carried])
    d = _series_chunk_key(df, keys, chunk if chunk is not None else time_chunk(order[0], chunk_seconds))
    if len(order) == 1:
        # max / max_by keep fixed-width buffers for numeric and time columns, so Spark can hash-aggregate
        # (a struct buffer forces a sort-based aggregate, i.e. a sort of every map task's input)
        o = order[0]
        parts = [F.max(o).alias(o)] + [F.max_by(c, o).alias(c) for c in carried[1:]]
        last = d.groupBy(SKEY).agg(*parts).select(SKEY, F.struct(*carried).alias("_last"))
    else:
        last = d.groupBy(SKEY).agg(F.max(rec).alias("_last"))
    over_chunks = Window.partitionBy(*_key_cols(keys)).orderBy(F.col(f"{SKEY}.c"))
    carry = last.select(SKEY, F.lag("_last").over(over_chunks).alias("_carry"))
    joined = d.join(carry, SKEY, "left")
    w = Window.partitionBy(SKEY).orderBy(*order)
    out = joined.withColumn("_prev", F.coalesce(F.lag(rec).over(w), F.col("_carry")))
    keep = [c for c in df.columns]
    return out.select(*keep, *[F.col("_prev")[c].alias(prefix + c) for c in carried])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                value: str | Column, out: str, chunk_seconds: int = 3600,
                chunk: Column | None = None) -> DataFrame:
    """``sum(value) over (partition by keys order by order)`` (default RANGE frame)."""
    return running_sums(df, keys, order, {out: value}, chunk_seconds, chunk)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str | Column],
                 chunk_seconds: int = 3600, chunk: Column | None = None) -> DataFrame:
    """``running_sum`` of several values (new column -> value) in one pass."""
    keys, order = list(keys), list(order)
    d = df.withColumns({f"_v_{out}": F.col(v) if isinstance(v, str) else v for out, v in values.items()})
    d = _series_chunk_key(d, keys, chunk if chunk is not None else time_chunk(order[0], chunk_seconds))
    totals = d.groupBy(SKEY).agg(*[F.sum(f"_v_{out}").alias(f"_tot_{out}") for out in values])
    before = (Window.partitionBy(*_key_cols(keys)).orderBy(F.col(f"{SKEY}.c"))
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(SKEY, *[F.sum(f"_tot_{out}").over(before).alias(f"_off_{out}") for out in values])
    joined = d.join(offsets, SKEY, "left")
    w = (Window.partitionBy(SKEY).orderBy(*order)
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    res = joined.withColumns({out: F.coalesce(F.col(f"_off_{out}"), F.lit(0)) + F.sum(f"_v_{out}").over(w) for out in values})
    return res.drop(SKEY, *[f"_v_{out}" for out in values], *[f"_off_{out}" for out in values])


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  out: str, chunk: Column, descending_chunks: bool = False) -> DataFrame:
    """1-based ``row_number()`` within ``keys`` along ``order``.

    ``chunk`` must be monotone along ``order`` (non-decreasing, or
    non-increasing when ``descending_chunks``); ``order`` should be unique.
    """
    keys = list(keys)
    d = _series_chunk_key(df, keys, chunk)
    counts = d.groupBy(SKEY).agg(F.count(F.lit(1)).alias("_n"))
    c = F.col(f"{SKEY}.c")
    before = (Window.partitionBy(*_key_cols(keys)).orderBy(c.desc() if descending_chunks else c.asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(SKEY, F.sum("_n").over(before).alias("_off"))
    joined = d.join(offsets, SKEY, "left")
    w = Window.partitionBy(SKEY).orderBy(*order)
    res = joined.withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.row_number().over(w)).cast("bigint"))
    return res.drop("_off", SKEY)

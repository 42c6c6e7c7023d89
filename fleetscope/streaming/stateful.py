"""Custom stateful streaming operators (SS5 stream form, SS6).

Both are ``transformWithState`` processors: each key has typed state variables
of its own, and an event-time timer that clears them ``ttl_ms`` after the
largest event time the key has seen, so state does not grow without bound.  A
row with a null event time has no place on the time line and takes no part.

``transformWithState`` needs the RocksDB state store; ``use_state_store`` sets
it for a session that names no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.traces import loop_traces
from .batch_forms import event_time

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB: on disk beside the executor, with every change in the checkpoint folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, STATE_STORE)


class _Expiring(StatefulProcessor):
    """Keeps ``last``, the largest event time (ms) of a key, and one timer ``ttl_ms`` after it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_ms", "ms long")

    def see(self, newest_ms: int, now) -> None:
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None and newest_ms <= known:
            return
        if known is not None:
            self.handle.deleteTimer(known + self.ttl_ms)
        self.last.update((newest_ms,))
        # A timer must lie after the watermark.
        self.handle.registerTimer(max(newest_ms, now.getCurrentWatermarkInMs() - self.ttl_ms + 1) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else 0
        if known + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.clear()
            self.last.clear()
        return iter(())

    def clear(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ms(times: pd.Series) -> int:
    return int(times.max().value) // 1_000_000


LOOP_OUTPUT = "trace_id string, n_spans long"


class LoopAlerts(_Expiring):
    """SS6: counts a trace's spans and says once that they passed ``limit``."""

    def __init__(self, limit: int, ttl_ms: int):
        super().__init__(ttl_ms)
        self.limit = limit

    def init(self, handle) -> None:
        super().init(handle)
        self.count = handle.getValueState("n_spans", "n long")
        self.alerted = handle.getValueState("alerted", "fired boolean")

    def clear(self) -> None:
        self.count.clear()
        self.alerted.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        newest = None
        for pdf in rows:  # only a count and the largest time are kept of each chunk
            n += len(pdf)
            newest = _ms(pdf["ts"]) if newest is None else max(newest, _ms(pdf["ts"]))
        self.count.update((n,))
        self.see(newest, timerValues)
        if n > self.limit and not self.alerted.exists():
            self.alerted.update((True,))
            yield pd.DataFrame({"trace_id": [key[0]], "n_spans": [self.limit + 1]})


def loop_alerts(spans: DataFrame, name: str = "memory_search", limit: int = 10, watermark: str = "1 hour",
                ttl_ms: int = 24 * 3600 * 1000, trace_id: str = "trace_id", name_col: str = "name",
                ts: str = "start_ts") -> DataFrame:
    """SS6: one alert per trace when it passes ``limit`` spans named ``name``.

    The alert's ``n_spans`` is the count at the crossing, ``limit + 1``, however
    the rows were batched.  The flag is part of the committed state, so a
    replayed micro-batch does not alert again; a trace that was silent for
    ``ttl_ms`` starts anew.  On a batch the same rows come from ``loop_traces``.
    """
    if not spans.isStreaming:
        return loop_traces(spans, name, limit, "exact", name_col, trace_id).select(
            F.col(trace_id).alias("trace_id"), F.lit(limit + 1).cast("bigint").alias("n_spans"))
    use_state_store(spans.sparkSession)
    df = event_time(spans, ts, watermark).filter((F.col(name_col) == name) & F.col(ts).isNotNull()).select(
        F.col(trace_id).alias("trace_id"), F.col(ts).alias("ts"))
    return df.groupBy("trace_id").transformWithStateInPandas(
        LoopAlerts(limit, ttl_ms), LOOP_OUTPUT, "append", "eventTime")


MERGE_OUTPUT = "trace_id string, meta_key string, meta_value string, updated_ts timestamp, version long"


class TraceUpdates(_Expiring):
    """SS5: the newest value of every metadata key of a trace, as a map of state entries."""

    def init(self, handle) -> None:
        super().init(handle)
        self.newest = handle.getMapState("newest", "k string", "ts_us long, seq long, value string, version long")

    def clear(self) -> None:
        self.newest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best: dict = {}
        last = None
        for pdf in rows:
            # One row a key is kept of each chunk: the greatest time, then the greatest number, null numbers first.
            order = pdf.sort_values(["ts", "seq"], kind="stable", na_position="first").groupby("k", dropna=False, sort=False).tail(1)
            for k, v, ts, seq in order[["k", "v", "ts", "seq"]].itertuples(index=False):
                stamp = (int(ts.value) // 1000, _NO_SEQ if pd.isna(seq) else int(seq))
                if k not in best or stamp > best[k][0]:
                    best[k] = (stamp, None if pd.isna(v) else v)
            last = _ms(pdf["ts"]) if last is None else max(last, _ms(pdf["ts"]))
        changed = []
        for k, (stamp, v) in best.items():
            known = self.newest.getValue((k,)) if self.newest.containsKey((k,)) else None
            if known is None or stamp > (known[0], known[1]):
                version = (known[3] if known else 0) + 1
                self.newest.updateValue((k,), (*stamp, v, version))
                changed.append((key[0], k, v, pd.Timestamp(stamp[0], unit="us"), version))
        self.see(last, timerValues)
        if changed:
            yield pd.DataFrame(changed, columns=["trace_id", "meta_key", "meta_value", "updated_ts", "version"])


#: Stands for a null sequence number: before every other.
_NO_SEQ = -(1 << 63)


def merge_trace_updates_stream(updates: DataFrame, watermark: str = "1 hour", ttl_ms: int = 7 * 24 * 3600 * 1000,
                               trace_id: str = "trace_id", key: str = "meta_key", value: str = "meta_value",
                               ts: str = "ts", seq: str = "seq") -> DataFrame:
    """SS5 (stream): the newest value of each (trace, key); last write wins by (ts, seq).

    A trace is one key of state, its metadata a map whose entries are read and
    written one by one.  Emits, in update mode, each pair that a micro-batch
    changed, with a version that grows with every change of the pair.  Rows
    without a key, a time or a trace take no part, as in the batch form.
    """
    use_state_store(updates.sparkSession)
    df = event_time(updates, ts, watermark).select(
        F.col(trace_id).alias("trace_id"), F.col(key).alias("k"), F.col(value).alias("v"),
        F.col(ts).alias("ts"), F.col(seq).cast("bigint").alias("seq")).filter("trace_id is not null and k is not null and ts is not null")
    return df.groupBy("trace_id").transformWithStateInPandas(TraceUpdates(ttl_ms), MERGE_OUTPUT, "update", "eventTime")

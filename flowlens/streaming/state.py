"""Keyed state with timers (ST2, ST3): ``transformWithState`` processors.

``flush_counts`` counts the rows of each key and emits a statistics row after every ``every`` of
them, then starts again at zero; a processing-time timer emits what a quiet key holds after
``idle_ms``.  ``newest`` keeps the newest ``keep`` rows of each key and emits the list whenever
it changes.  State lives in the checkpoint (RocksDB), so a restarted query goes on counting.

A key's state is bounded: three counters, or ``keep`` rows.  The rows of a key are taken in
event order within a micro-batch; across micro-batches they count as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowlens.session import ensure_python_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSH_EVERY = 100      # rows
IDLE_MS = 60_000
KEEP_ALERTS = 1_000
FLUSHED = "key string, flush long, total long, attacks long, complete boolean"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class FlushCounts(StatefulProcessor):
    """(total, attacks) since the last flush, and the number of flushes."""

    def __init__(self, every: int, idle_ms: int):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = StructType([StructField(c, LongType()) for c in ("total", "attacks", "flushes")])
        self.counters = handle.getValueState("counters", longs)

    def _row(self, key, flush, total, attacks, complete) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "flush": [flush], "total": [total], "attacks": [attacks], "complete": [complete]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, attacks, flushes = self.counters.get() if self.counters.exists() else (0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        flags, at = batch["flag"].astype("int64").to_numpy(), 0
        while len(flags) - at >= self.every - total:
            upto = at + self.every - total
            flushes += 1
            yield self._row(key, flushes, self.every, int(attacks + flags[at:upto].sum()), True)
            at, total, attacks = upto, 0, 0
        total, attacks = total + len(flags) - at, attacks + int(flags[at:].sum())
        self.counters.update((int(total), int(attacks), int(flushes)))
        if self.idle_ms:  # one timer a key: from its last rows on
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if total:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, attacks, flushes = self.counters.get() if self.counters.exists() else (0, 0, 0)
        if total:
            self.counters.update((0, 0, int(flushes) + 1))
            yield self._row(key, flushes + 1, total, attacks, False)

    def close(self) -> None:
        pass


def flush_counts(scored: DataFrame, key: str, id_col: str, every: int = FLUSH_EVERY, idle_ms: int = IDLE_MS,
                 flag_col: str = "is_attack", ts_col: str = "ts") -> DataFrame:
    """ST3: (key, flush, total, attacks, complete): a row per ``every`` rows of a key; a row with
    ``complete`` false holds fewer, flushed by the timer.

    ``idle_ms=0`` sets no timers: for runs over what is available, which timers would keep
    alive for ever.
    """
    ensure_python_package(scored.sparkSession)
    rows = scored.select(F.col(key).cast("string").alias("key"), F.col(ts_col).alias("ts"), F.col(id_col).alias("id"),
                         F.coalesce(F.col(flag_col).cast("int"), F.lit(0)).alias("flag"))
    timers = "processingTime" if idle_ms else "none"
    return rows.groupBy("key").transformWithStateInPandas(FlushCounts(every, idle_ms), FLUSHED, "append", timers)


class Newest(StatefulProcessor):
    """The newest rows of a key: (time in microseconds, id, the row as JSON)."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", StructType([
            StructField("micros", LongType()), StructField("id", LongType()), StructField("row", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) if self.rows.exists() else []
        best = {(m, i): r for m, i, r in held}
        for chunk in rows:
            best.update({(int(m), int(i)): r for m, i, r in zip(chunk["micros"], chunk["id"], chunk["row"])})
            if len(best) > 4 * self.keep:
                best = {k: best[k] for k in sorted(best, reverse=True)[:self.keep]}
        newest = sorted(best, reverse=True)[:self.keep]
        self.rows.put([(m, i, best[m, i]) for m, i in newest])
        yield pd.DataFrame({"key": [key[0]] * len(newest), "rank": range(1, len(newest) + 1),
                            "id": [i for _, i in newest], "row": [best[k] for k in newest]})

    def close(self) -> None:
        pass


def newest(alerts: DataFrame, key: str, id_col: str, keep: int = KEEP_ALERTS, ts_col: str = "ts") -> DataFrame:
    """ST2: (key, rank, id, row): for each key that got rows, its newest ``keep`` rows (JSON) from
    the newest on, ties by id.  In a sink the last micro-batch of a key holds its list."""
    ensure_python_package(alerts.sparkSession)
    rows = alerts.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("micros"),
                         F.col(id_col).cast("long").alias("id"), F.to_json(F.struct(*alerts.columns)).alias("row"))
    return rows.groupBy("key").transformWithStateInPandas(
        Newest(keep), "key string, rank int, id long, row string", "update", "none")


def current_lists(spark: SparkSession, path: str) -> DataFrame:
    """The list of every key from the micro-batch that wrote it last."""
    parts = spark.read.parquet(path)
    last = parts.groupBy("key").agg(F.max("batch_id").alias("batch_id"))
    return parts.join(last, ["key", "batch_id"]).drop("batch_id")

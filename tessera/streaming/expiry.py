"""State with a time to live: what is opened or renewed by a stream of events and expires by event time.

Result sets live a day, tokens five minutes (RESULT_SECONDS, TOKEN_SECONDS). An event opens an item or renews it; when the
watermark has passed its time, a timer fires, the item's life is told, and its state is gone, so state is bounded by what is
alive. A gap that is already known when events arrive, be it in one batch, ends a life just as a timer does, so the lives
told don't depend on how the stream is cut into batches. Times are rounded to milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.joins import micros

RESULT_SECONDS = 24 * 3600
TOKEN_SECONDS = 300
#: State with timers and maps is kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Lives(StatefulProcessor):
    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "opened long, last long, n long")

    def _told(self, key, life) -> tuple:
        opened, last, n = life
        return key[0], opened, last + self.ttl, n

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "opened", "expired", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in rows for t in b["at_ms"].tolist())
        life, before, out = self.life.get(), None, []
        before = life[1] if life else None
        for t in times:
            if life is None:
                life = (t, t, 1)
            elif t > life[1] + self.ttl:
                out.append(self._told(key, life))
                life = (t, t, 1)
            else:
                life = (min(life[0], t), max(life[1], t), life[2] + 1)
        if before is not None:
            self.handle.deleteTimer(before + self.ttl)
        self.life.update(life)
        # An event before the watermark would be late; a timer is always ahead of it, or fires at once.
        self.handle.registerTimer(life[1] + self.ttl)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life = self.life.get()
        out = []
        if life and life[1] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._told(key, life))
            self.life.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def lives(events: DataFrame, key: str, ts: str, ttl_seconds: int, watermark: str) -> DataFrame:
    """key, opened_at, expired_at and n (events) of every life that has ended, of a stream with timestamps; lives still open come later."""
    with_store(events.sparkSession)
    at_ms = F.round(micros(ts) / 1000).cast("long")  # as of timers and watermark; truncated ones would let a life end early
    rows = events.withColumn("at_ms", at_ms).withColumn(ts, F.timestamp_millis("at_ms")).withWatermark(ts, watermark).select(key, ts, "at_ms")
    kind = rows.schema[key].dataType.simpleString()
    told = rows.groupBy(key).transformWithStateInPandas(_Lives(key, ttl_seconds * 1000), f"{key} {kind}, opened long, expired long, n long", "Append", "EventTime")
    at = lambda c: F.timestamp_millis(F.col(c)).alias(f"{c}_at")
    return told.select(key, at("opened"), at("expired"), "n")

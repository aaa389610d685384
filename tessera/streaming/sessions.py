"""Structured Streaming over the event log: incremental batches, sessions, windows.

A file source read with `availableNow` takes in what is there and stops, so a stream's result can be held against a batch's.
Watermarks are this library's addition: late rows beyond them are dropped, which a batch never does.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.catalog import shared_root
from tessera.operators.events import WINDOW_S, as_dicts, assign
from tessera.operators.joins import micros


def event_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def session_counts(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Per key the sessions that end after a gap; batch or stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, watermark) if watermark else rows
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def window_counts(events: DataFrame, key: str, ts: str, width: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts by tumbling (or sliding) window and key; batch or stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, watermark) if watermark else rows
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), key, "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available through the stream, written as Parquet and read again."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """A complete-mode aggregate: each micro-batch replaces the table, the last one is the result."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def consume(stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Batches prepared in parallel and committed in order; a batch that ran already replaces itself, by its id."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of the shared checkpoint place."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def paired(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, reach: str, watermark: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams with equal keys of which the right comes within `reach` after the left. Watermarks bound both sides' state.

    how: left_outer adds the lefts without a partner, once the watermark has passed the time in which one could have come.

    Columns of the two must differ in name but for the key.
    """
    a = left.withColumn(left_ts, F.col(left_ts).cast("timestamp")).withWatermark(left_ts, watermark)
    b = right.withColumn(right_ts, F.col(right_ts).cast("timestamp")).withColumnRenamed(key, "__key").withWatermark(right_ts, watermark)
    near = F.expr(f"`{key}` = __key AND {right_ts} >= {left_ts} AND {right_ts} <= {left_ts} + INTERVAL {reach}")
    return a.join(b, near, how).drop("__key")


def once(stream: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """The stream without what is delivered again within the watermark's delay; the state holds the keys of that time only."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def assigned_online(observations: DataFrame, keep_seconds: float = 2 * WINDOW_S) -> DataFrame:
    """scope_id, obs_id, event_id and score of a stream of observations, the open events of each scope being its state.

    A late observation is never dropped: it is held against the events that the state still has, which are those that began
    within keep_seconds of the newest observation so far.
    """
    columns = ["scope_id", "obs_id", "t", "location", "visual_place", "kind", "activity", "objects", "people", "gps", "vector"]
    kind = lambda c: observations.schema[c].dataType.simpleString()
    rows = observations.withColumn("t", micros("ts") / 1e6).filter("t IS NOT NULL").select(*columns)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = pickle.loads(state.get[0]) if state.exists else []
        arrived = pd.concat(list(batches), ignore_index=True).sort_values(["t", "obs_id"], kind="stable")
        found = [(key[0], *x) for x in assign(as_dicts(arrived), opened=opened, keep_seconds=keep_seconds)]
        state.update((pickle.dumps(opened),))
        yield pd.DataFrame(found, columns=["scope_id", "obs_id", "event_id", "score"])

    out = f"scope_id {kind('scope_id')}, obs_id {kind('obs_id')}, event_id string, score double"
    return rows.groupBy("scope_id").applyInPandasWithState(run, out, "events binary", "append", GroupStateTimeout.NoTimeout)

"""Structured Streaming twins of the custody jobs.

Deployment reads Kafka or a landing folder; tests and the local queries read Parquet files with
`availableNow`. Checkpoints live beside the output, so a lost driver or executor resumes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 16) -> DataFrame:
    """Files in the order they landed, a bounded number per micro-batch; `arrived_at` is when the file landed.

    Without a number a micro-batch takes whatever has landed, as when one poll, of any number of files, is drained before the next.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def land(rows: DataFrame, path: str, *keys: str, records: int = 1_000_000) -> None:
    """Append one poll as files of bounded size: dealt by a hash of `keys`, so its tasks are as many as its bytes need."""
    rows.repartition(*keys).write.mode("append").option("maxRecordsPerFile", records).parquet(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append every tick as received, once per micro-batch: a replayed micro-batch overwrites its own folder."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("received_at", F.current_timestamp()).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/micro_batch={batch_id}")
    drain(stream, write, checkpoint)


def deduplicated(stream: DataFrame, identity: list[str], delay: str) -> DataFrame:
    """Overlapping polls reduced to one tick.

    The watermark follows arrival, not the tick's own time: files are read as they landed, so no tick is ever late, however old
    it is. State of a tick is dropped once its copies can no longer arrive.
    """
    return stream.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(identity)


def split_by_origin(stream: DataFrame, out: str, checkpoint: str, origin: str, time: str = "ts") -> None:
    """Ticks before the origin go to `rejected`, all others to `accepted`; none is lost."""
    def write(rows: DataFrame, batch_id: int) -> None:
        early = F.coalesce(F.col(time) < F.lit(origin).cast("timestamp"), F.lit(True))
        rows.withColumn("status", F.when(early, "rejected").otherwise("accepted")).withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("status").parquet(f"{out}/part={batch_id}")
    drain(stream, write, checkpoint)


def split_late(stream: DataFrame, out: str, checkpoint: str, delay: str, time: str = "ts") -> None:
    """Ticks more than `delay` older than the newest one of earlier micro-batches go to `rejected`, all others to `accepted`.

    The newest time is read from the written micro-batches, so a replay decides alike.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark, newest = rows.sparkSession, None
        if batch_id:
            newest = spark.read.parquet(f"{out}/newest").where(F.col("micro_batch") < batch_id).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.col(time) < F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        rows.withColumn("status", F.when(late, "rejected").otherwise("accepted")).write.mode("overwrite").partitionBy("status").parquet(f"{out}/ticks/micro_batch={batch_id}")
        rows.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/micro_batch={batch_id}")
    drain(stream, write, checkpoint)


def heartbeat_sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions of uninterrupted heartbeats; the space between two of a key is an absence. Late beats are split off before."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("beats")).select(
        key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "beats")


EPISODE_OUTPUT = "symbol string, episode long, children long, batches long, closed_batch long"
EPISODE_COLUMNS = ["symbol", "episode", "children", "batches", "closed_batch"]
EPISODE_STATE = "episode long, children long, batches long"


def episodes(stream: DataFrame, open_above: float, close_at: float) -> DataFrame:
    """Recovery episodes with state that survives restarts: a row when the closing batch arrives, and one for an episode still open
    at the end of a micro-batch. Counters only grow, so `episode_table` keeps the last state of each.

    The input is the batch ledger (one row per poll and symbol) in order of batches; what is sorted is one symbol's part of one
    micro-batch, bounded by the files of a trigger.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((int(batch), float(lag)) for frame in frames for batch, lag in zip(frame["batch"], frame["lag_seconds"]))
        episode, children, batches = state.get if state.exists else (-1, 0, 0)
        out = []
        for batch, lag in rows:
            if episode < 0 and lag > open_above:
                episode, children, batches = batch, 0, 0
            if episode >= 0:
                batches += 1
                children += int(lag > open_above)
                if lag <= close_at:
                    out.append((key[0], episode, children, batches, batch))
                    episode, children, batches = -1, 0, 0
        if episode >= 0:
            out.append((key[0], episode, children, batches, None))
        state.update((episode, children, batches))
        if out:
            yield pd.DataFrame(out, columns=EPISODE_COLUMNS).astype({"closed_batch": "Int64"})
    return stream.groupBy("symbol").applyInPandasWithState(step, EPISODE_OUTPUT, EPISODE_STATE, "append", GroupStateTimeout.NoTimeout)


def episode_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "episode").agg(*[F.max(c).alias(c) for c in EPISODE_COLUMNS[2:]])


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what is available into Parquet in append mode."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()

"""Streaming forms: files to chunks, sessions with watermarks, per-key state with expiry, log export, telemetry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.chunks import chunk, streaming_chunks


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder whose names fit the pattern; where that names a folder itself, as of a table in parts, its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(s.isDirectory() for s in fs.globStatus(path) or []):
        # a glob that ends in / * names the files, so that no base path is looked for
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{pattern}/*")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def file_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of a stream (or table) of documents."""
    return chunk(docs, lambda t: streaming_chunks(t, size, overlap))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value): sessions that close when a user is idle; later rows than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return timed.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def recall_state(recalls: DataFrame, cooldown_ms: int = 300_000, ttl_ms: int = 1_800_000) -> DataFrame:
    """(id, at_ms, auto_recalls, strength, inhibited) of recalls (id, at_ms): a recall counts once a cooldown, state expires by event time."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, strength, last = state.get if state.exists else (0, 1.0, -(2**62))
        out = []
        for at in sorted(x for f in frames for x in f["at_ms"]):
            inhibited = at - last < cooldown_ms
            if not inhibited:
                n, strength, last = n + 1, min(5.0, strength + 0.05), at
            out.append((key[0], at, n, strength, inhibited))
        state.update((n, strength, last))
        if state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "at_ms", "auto_recalls", "strength", "inhibited"])

    timed = recalls.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "1 hour")
    return timed.groupBy("id").applyInPandasWithState(update, "id long, at_ms long, auto_recalls int, strength double, inhibited boolean", "n int, strength double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off everything that is there, batch by batch, with a checkpoint; for exports, side effects and tests."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def export_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Copy a log's new events; a batch that is repeated after a failure overwrites its own folder."""
    run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)


class TrainThenFlush:
    """A foreachBatch sink that collects rows until there are enough to train an index, then keeps adding to it."""

    def __init__(self, path: str, least: int, train: Callable[[DataFrame], object], flush: Callable[[object, DataFrame], None]):
        self.path, self.least, self.train, self.flush, self.model = path, max(256, least), train, flush, None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.model is None:
            batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
            waiting = batch.sparkSession.read.parquet(self.path).drop("batch")
            if waiting.count() >= self.least:
                self.model = self.train(waiting)
                self.flush(self.model, waiting)
        else:
            self.flush(self.model, batch)


class Telemetry(StreamingQueryListener):
    """Query progress as rows, pushed to subscribers; a subscriber's failure concerns it alone."""

    def __init__(self) -> None:
        self.subscribers: list[Callable[[dict], None]] = []
        self.failures = 0

    def publish(self, row: dict) -> None:
        for subscriber in list(self.subscribers):
            try:
                subscriber(row)
            except Exception:  # other subscribers still get the row
                self.failures += 1

    def onQueryStarted(self, event) -> None:
        self.publish({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self.publish({"event": "progress", "id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.publish({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.publish({"event": "terminated", "id": str(event.id)})

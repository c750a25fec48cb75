"""Incremental indexing by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store, latest

DEBOUNCE = "500 milliseconds"
#: (file_path, op: upsert or delete, at): file sources don't report deletions, so they come as rows of a change log.
CHANGES = "file_path string, op string, at timestamp, content string"


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHANGES).json(folder)


def apply_changes(store: Store, to_chunks: Callable[[DataFrame], DataFrame]):
    """For foreachBatch: of each path the last change counts. A batch is one commit, and only its files are read and written; a batch that
    runs again gives the same index."""

    def run(batch: DataFrame, _: int) -> None:
        last = latest(batch, "file_path", "at").persist()
        gone, changed = last.where("op = 'delete'"), last.where("op = 'upsert'")
        kinds = {r["op"] for r in last.select("op").distinct().collect()}  # two at most
        if kinds:
            store.apply(to_chunks(changed.select("file_path", "content")) if "upsert" in kinds else None, last.select("file_path") if "upsert" in kinds else gone.select("file_path"))
        last.unpersist()

    return run


def watch(changes: DataFrame, store: Store, to_chunks: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start indexing a change stream; a trigger interval is the debounce. `once`: stop when what is there has been indexed."""
    writer = changes.writeStream.foreachBatch(apply_changes(store, to_chunks)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def debounced(events: DataFrame, key: str, ts: str, gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n): bursts of events with no pause of `gap`; works on streams (with a watermark) and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return out.drop("burst")

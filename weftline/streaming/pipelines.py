"""Continuous forms of the batch operators. The reference semantics have no event time; these are additions.

Every micro-batch runs the batch operator, which is idempotent (``Engine.ingest`` passes over chunks that are there),
so a replay after a failure does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.engine import Engine


def ingest_stream(docs: DataFrame, engine: Engine, checkpoint: str, **trigger) -> StreamingQuery:
    """Documents of a stream to the engine's chunks."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answer_stream(requests: DataFrame, engine: Engine, out: str, checkpoint: str, as_of: Callable[[], Column], **trigger) -> StreamingQuery:
    """Requests of a stream to answers, a folder for each batch, written over on a replay."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.run_batch(batch, as_of()).select("request_id", "answer", "sources", "ok", "low_confidence").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(events: DataFrame, late: str = "1 hour", window: str = "1 day", ts: str = "ts") -> DataFrame:
    """(start, event_type, events, users about): counts by window; events later than ``late`` are dropped from a stream."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    counted = marked.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "events", "users")

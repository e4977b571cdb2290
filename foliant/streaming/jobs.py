"""Change-driven jobs: inbox, webhook, deferred re-embedding, session expiry.

Sinks write one directory per micro-batch, so a repeated batch replaces its own
output. Tables built this way equal those of the batch operators for any split
of the input into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from foliant.operators.maintenance import new_inbox_documents
from foliant.sources.documents import has_tag
from foliant.streaming.webhook import reindex_requests, webhook_events

Handler = Callable[[DataFrame], None]


def _batch_dir(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a log; empty when none has been written."""
    from foliant.sources.store import _files

    fs, root = _files(spark, path)
    if not fs.exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _once(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; an outside scheduler starts it again."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_inbox(
    docs: DataFrame, tracking_path: str, checkpoint: str, inbox_tag: int | None, submit: Handler | None = None
) -> StreamingQuery:
    """Tracks inbox documents once and hands the new ones to ``submit``.

    Tracking is written before submission, so a document is analysed at most
    once. A repeated batch leaves its own earlier output out of the check.
    """
    picked = docs if inbox_tag is None else docs.where(has_tag(inbox_tag))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = read_log(spark, tracking_path, "document_id long, first_seen_at timestamp, batch int")
        earlier = seen.where(F.col("batch") < batch_id)
        fresh = new_inbox_documents(batch, earlier, F.current_timestamp())
        fresh.write.mode("overwrite").parquet(_batch_dir(tracking_path, batch_id))
        if submit:
            submit(spark.read.parquet(_batch_dir(tracking_path, batch_id)))

    return _once(picked.select("document_id").writeStream.foreachBatch(handle), checkpoint)


def webhook_stream(
    bodies: DataFrame, requests_path: str, quarantine_path: str, checkpoint: str, watermark: str = "1 hour"
) -> StreamingQuery:
    """Payloads (body, ts) to re-index requests; unusable ones go to quarantine with the reason."""
    parsed = webhook_events(bodies.withWatermark("ts", watermark))

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good = batch.where(F.col("reason").isNull())
        reindex_requests(good).write.mode("overwrite").parquet(_batch_dir(requests_path, batch_id))
        bad = batch.where(F.col("reason").isNotNull()).select("body", "ts", "reason")
        bad.write.mode("overwrite").parquet(_batch_dir(quarantine_path, batch_id))
        batch.unpersist()

    return _once(parsed.writeStream.foreachBatch(handle), checkpoint)


def pending_requests(spark: SparkSession, requests_path: str) -> DataFrame:
    """Requests of all batches, one per document with the latest event."""
    return reindex_requests(read_log(spark, requests_path, "document_id long, ts timestamp"))


def dirty_stream(events: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """First change of each document per batch, for ``maintenance.mark_dirty``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("document_id").agg(F.min("ts").alias("ts"))
        first.write.mode("overwrite").parquet(_batch_dir(log_path, batch_id))

    return _once(events.select("document_id", "ts").writeStream.foreachBatch(handle), checkpoint)


def enqueue_stream(suggestions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """New suggestions once per id, within the watermark; ids are content-derived, so repeats are equal."""
    return (
        suggestions.withWatermark("created_at", watermark)
        .dropDuplicatesWithinWatermark(["id"])
        .withColumn("status", F.lit("pending"))
    )


def expiring_sessions(turns: DataFrame, hours: int = 24, watermark: str = "0 seconds") -> DataFrame:
    """Sessions that went quiet: emitted once the watermark is ``hours`` past their last turn."""
    return (
        turns.withWatermark("ts", watermark)
        .groupBy("session_id", F.session_window("ts", f"{hours} hours"))
        .agg(F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("turns"))
        .drop("session_window")
    )

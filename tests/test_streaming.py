import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import maintenance
from foliant.plans import derive as D
from foliant.streaming import jobs, webhook


def split(df, path, parts, seed):
    """The rows of ``df`` in random files, so that each micro-batch sees one of them."""
    rng = random.Random(seed)
    rows = df.collect()
    for n in range(parts):
        mine = [r for r in rows if rng.randrange(parts) == 0 or n == parts - 1]
        rows = [r for r in rows if r not in mine]
        if mine:
            df.sparkSession.createDataFrame(mine, df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture()
def changes(spark, sf):
    e = D.table(spark, sf, "events").limit(300)
    return e.select((F.col("event_id") % 90 + 1).alias("document_id"), F.col("ts").cast("timestamp").alias("ts"))


def test_inbox_once(spark, sf, tmp_path):
    docs = D.document(spark, sf).select("document_id", "tag_ids")
    again = docs.unionByName(docs)  # every document arrives twice
    stream = split(again, str(tmp_path / "in"), 4, 1)
    submitted = []
    for _ in range(2):  # a second run finds nothing new
        query = jobs.poll_inbox(
            stream, str(tmp_path / "tracking"), str(tmp_path / "cp"), D.INBOX,
            lambda new: submitted.extend(r.document_id for r in new.collect()),
        )
        query.awaitTermination()
    want = {r.document_id for r in docs.where(F.array_contains("tag_ids", D.INBOX)).collect()}
    assert sorted(submitted) == sorted(want)
    tracked = jobs.read_log(spark, str(tmp_path / "tracking"), "document_id long, first_seen_at timestamp, batch int")
    assert {r.document_id for r in tracked.collect()} == want


def test_webhook_stream_equals_batch(spark, sf, tmp_path):
    bodies = D.webhook_body(spark, sf).limit(200).select("body", F.col("ts").cast("timestamp").alias("ts"))
    stream = split(bodies, str(tmp_path / "in"), 3, 2)
    requests, quarantine = str(tmp_path / "req"), str(tmp_path / "bad")
    jobs.webhook_stream(stream, requests, quarantine, str(tmp_path / "cp")).awaitTermination()
    parsed = webhook.webhook_events(bodies)
    assert set(jobs.pending_requests(spark, requests).collect()) == set(webhook.reindex_requests(parsed).collect())
    bad = parsed.where("reason IS NOT NULL").select("body", "reason")
    assert sorted(spark.read.parquet(quarantine).select("body", "reason").collect()) == sorted(bad.collect())


def test_dirty_stream_equals_batch(spark, changes, tmp_path):
    tracking = spark.range(1, 60).selectExpr(
        "id document_id", "CASE WHEN id % 5 = 0 THEN timestamp'2024-01-01 00:00:01' END reembed_dirty_since"
    )
    log = str(tmp_path / "log")
    jobs.dirty_stream(split(changes, str(tmp_path / "in"), 5, 3), log, str(tmp_path / "cp")).awaitTermination()
    streamed = maintenance.mark_dirty(tracking, jobs.read_log(spark, log, "document_id long, ts timestamp"))
    assert set(streamed.collect()) == set(maintenance.mark_dirty(tracking, changes).collect())


def test_sessions_expire(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 20:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-04 00:00:00")]
    turns = spark.createDataFrame(rows, "session_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(4, "2024-01-04 10:00:00")], "session_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        jobs.expiring_sessions(stream).writeStream.format("memory").queryName("gone").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {(r.session_id, r.turns) for r in spark.table("gone").collect()} == {(1, 2), (2, 1)}


def test_enqueue_stream_drops_repeats(spark, tmp_path):
    s = spark.sql("SELECT id % 20 AS id, timestamp'2024-01-01 00:00:00' created_at FROM range(60)")
    stream = split(s.distinct(), str(tmp_path / "in"), 3, 4)
    query = jobs.enqueue_stream(stream).writeStream.format("memory").queryName("queued").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.id for r in spark.table("queued").collect()) == list(range(20))

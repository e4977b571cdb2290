import csv
import pathlib

import pytest
from pyspark.sql import functions as F

from foliant.operators import audit as H
from foliant.plans import derive as D
from foliant.plans.queue_queries import audit_export
from foliant.sources import store


def chunks(spark, rows):
    return spark.createDataFrame(rows, "document_id long, chunk_index long, passage string")


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    assert store.read_current(spark, path) is None
    store.write_version(chunks(spark, [(d, 0, f"old {d}") for d in range(1, 40)]), path)
    before = {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    touched = spark.createDataFrame([(1,), (2,), (99,)], "document_id long")
    for _ in range(2):  # a repeat changes nothing
        store.upsert_buckets(spark, path, chunks(spark, [(1, 0, "new 1"), (1, 1, "more"), (99, 0, "x")]), touched, staging)
        got = {(r.document_id, r.chunk_index): r.passage for r in store.read_current(spark, path).collect()}
        want = {(d, 0): f"old {d}" for d in range(3, 40)} | {(1, 0): "new 1", (1, 1): "more", (99, 0): "x"}
        assert got == want
    same = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len(same) >= 30
    store.write_version(chunks(spark, [(5, 0, "v2")]), path)
    assert store.versions(spark, path) == [1, 2]
    assert [r.passage for r in store.read_current(spark, path).collect()] == ["v2"]


def test_uncommitted_version_is_invisible(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_version(chunks(spark, [(1, 0, "a")]), path)
    store.write_version(chunks(spark, [(1, 0, "b")]), path)
    (tmp_path / "t" / "v=2" / "_SUCCESS").unlink()
    assert [r.passage for r in store.read_current(spark, path).collect()] == ["a"]


def test_readers_see_the_table_before_or_after_an_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda df: sorted((r.document_id, r.passage) for r in df.collect())
    ids = lambda *d: spark.createDataFrame([(i,) for i in d], "document_id long")
    store.write_version(chunks(spark, [(d, 0, f"old {d}") for d in range(1, 40)]), path, buckets=8)
    files = {p: p.read_bytes() for p in pathlib.Path(path).rglob("*.parquet")}
    before = store.read_current(spark, path)
    store.upsert_buckets(spark, path, chunks(spark, [(1, 0, "new 1")]), ids(1, 2))
    first = store.read_current(spark, path)
    store.upsert_buckets(spark, path, chunks(spark, [(1, 0, "newer 1"), (50, 0, "x")]), ids(1, 50))
    old = [(d, f"old {d}") for d in range(3, 40)]
    assert rows(before) == sorted([(1, "old 1"), (2, "old 2"), *old])
    assert rows(first) == sorted([(1, "new 1"), *old])
    want = sorted([(1, "newer 1"), (50, "x"), *old])
    assert rows(store.read_current(spark, path)) == want
    assert all(p.read_bytes() == data for p, data in files.items())
    # An upsert that has not committed does not count, and the next one takes its place.
    store.upsert_buckets(spark, path, chunks(spark, []), ids(3))
    (tmp_path / "t" / "v=1.3" / "_SUCCESS").unlink()
    assert rows(store.read_current(spark, path)) == want
    store.upsert_buckets(spark, path, chunks(spark, []), ids(4))
    want = [r for r in want if r[0] != 4]
    located = store.read_located(spark, path)
    assert rows(located) == want and store.buckets_of(located) == 8
    pruned = located.where(F.col("bucket") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in pruned


def test_expired_snapshots_go_and_the_kept_ones_stay_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda: sorted((r.document_id, r.passage) for r in store.read_current(spark, path).collect())
    store.write_version(chunks(spark, [(0, 0, "of an older version")]), path)
    store.write_version(chunks(spark, [(d, 0, f"old {d}") for d in range(1, 30)]), path, buckets=4)
    for d in range(1, 6):
        store.upsert_buckets(spark, path, chunks(spark, [(d, 0, f"new {d}")]), spark.createDataFrame([(d,)], "document_id long"))
    want, size = rows(), len(list(pathlib.Path(path).rglob("*.parquet")))
    for _ in range(2):  # a repeat changes nothing
        store.expire(spark, path)
        assert rows() == want
    left = list(pathlib.Path(path).rglob("*.parquet"))
    assert len(left) < size and not (tmp_path / "t" / "v=1").exists()
    gone = spark.range(1, 30).withColumnRenamed("id", "document_id")
    store.upsert_buckets(spark, path, chunks(spark, []), gone)
    store.expire(spark, path)
    assert rows() == [] and store.read_current(spark, path).columns[-1] == "bucket"
    assert store.write_version(chunks(spark, [(7, 0, "a")]), path) == 3 and rows() == [(7, "a")]
    with pytest.raises(ValueError):
        store.expire(spark, path, 0)


def test_migration_outcomes(spark):
    empty = spark.createDataFrame([], "vector array<float>")
    full = spark.createDataFrame([([1.0],)], "vector array<float>")
    assert store.migrate(None, None) == (None, store.REINDEX)
    assert store.migrate(full, None, layouts_match=False) == (None, store.REINDEX)
    assert store.migrate(full, None) == (None, store.REINDEX)  # none of the columns a layout has
    assert store.migrate(empty, None) == (None, store.DONE)
    assert store.migrate(full, full) == (None, store.DONE)
    assert store.migration(full, full).first()[1:3] == (1, 1)
    assert store.migrate_memories(full, full) is None


def test_compact(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", True)], "k long, ver long, v string, gone boolean")
    log.write.parquet(str(tmp_path / "log"))
    store.compact(spark, str(tmp_path / "log"), str(tmp_path / "out"), ["k"], ["ver"])
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in kept.select("k", "v", "gone").collect()) == [(1, "b", False), (2, "c", True)]
    assert [r.k for r in store.current(kept, ["k"], ["ver"], "gone").collect()] == [1]


def test_audit_export(spark, sf, tmp_path):
    audit = D.audit(spark, sf)
    H.export(audit, str(tmp_path / "csv"), limit=20)
    (file,) = (tmp_path / "csv").glob("*.csv")
    rows = list(csv.DictReader(file.open()))
    assert len(rows) == 20 and tuple(rows[0]) == H.EXPORT_COLUMNS
    assert any(r["session_id"] == "" for r in rows)
    assert rows == sorted(rows, key=lambda r: (r["changed_at"], int(r["id"])), reverse=True)
    H.export(audit, str(tmp_path / "json"), "json", limit=5)
    assert spark.read.json(str(tmp_path / "json")).count() == 5


def test_audit_export_query_holds_the_limit_of_its_sql(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    more = events.limit(50).withColumn("event_id", F.col("event_id") + 10_000_000)
    events.unionByName(more).write.parquet(str(tmp_path / "events.parquet"))
    rows = audit_export(spark, str(tmp_path))
    assert rows.count() == 100_000
    newest = D.audit(spark, str(tmp_path)).orderBy(F.desc("changed_at"), F.desc("id")).select("id").limit(100_000)
    assert rows.select("id").exceptAll(newest).count() == 0


def test_audit_bounds(spark, sf):
    with pytest.raises(ValueError):
        H.retain(D.audit(spark, sf), F.current_timestamp(), 29)
    pushed = H.query(D.table(spark, sf, "events").withColumnRenamed("ts", "changed_at"), date_from=D.ntz("2024-01-05 00:00:00"))
    assert "GreaterThanOrEqual(ts" in pushed._jdf.queryExecution().executedPlan().toString()


def test_payload_is_fetched_by_location(spark, tmp_path):
    from foliant.operators import retrieval

    chunks = spark.range(400).selectExpr("id div 2 + 1 as document_id", "id % 2 as chunk_index", "concat('p', id) as passage")
    store.write_version(chunks, str(tmp_path / "t"), buckets=8)
    located = store.read_located(spark, str(tmp_path / "t"))
    assert store.buckets_of(located.where("chunk_index = 0")) == 8 and store.buckets_of(chunks) is None
    hits = spark.createDataFrame([(1, 5, 0), (2, 5, 1), (2, 77, 1), (3, 9999, 0)], "query_id long, document_id long, chunk_index long")
    found = retrieval.with_payload(hits, located, "passage")
    assert sorted(map(tuple, found.collect())) == [(1, 5, 0, "p8"), (2, 5, 1, "p9"), (2, 77, 1, "p153")]
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "In(document_id" in plan.replace("INSET", "In")  or "document_id IN" in plan
    assert sorted(map(tuple, retrieval.with_payload(hits, chunks, "passage").collect())) == sorted(map(tuple, found.collect()))


def test_a_large_bucket_is_split_over_tasks(spark, tmp_path):
    """Documents of one chunk each: the chunk number alone would put a bucket into one task."""
    rows = spark.range(20_000).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.sha2(F.col("id").cast("string"), 256).alias("passage"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100k")
    try:
        store.write_version(rows.repartition(8), f"{tmp_path}/t", buckets=1)
    finally:
        spark.conf.set(size, before)
    assert len(list(tmp_path.glob("t/v=1/bucket=0/*.parquet"))) > 4
    assert store.read_current(spark, f"{tmp_path}/t").drop("bucket").exceptAll(rows).isEmpty()

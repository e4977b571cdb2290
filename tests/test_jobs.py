import datetime
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant.operators import scan
from foliant.plans import derive as D
from foliant.plans import jobs
from foliant.sources import store

# The stand-in models below travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


class Hash:
    """Deterministic embedder; texts that say so fail."""

    name, max_batch = "sha256", 16

    def embed(self, texts):
        import hashlib

        return [None if "UNREADABLE" in t else [b / 255 - 0.5 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


class Model:
    name = "canned"

    def complete(self, prompts, max_tokens):
        return [None if len(p) % 5 == 0 else '{"title": "New", "tags": ["QUALITY", "unknown"], "correspondent": "nobody"}' for p in prompts]


def small(spark, sf):
    docs = D.document(spark, sf).where("document_id <= 60")
    return docs, D.entity(spark, sf), D.custom_field(spark, sf)


def test_index_refresh_and_ask(spark, sf, tmp_path):
    docs, entities, fields = small(spark, sf)
    docs = docs.withColumn(
        "content", F.when(F.col("document_id") == 3, F.lit("UNREADABLE")).otherwise(F.col("content"))
    )
    path = str(tmp_path / "index")
    p = jobs.IndexParams(inbox_tag=D.INBOX)
    stamps, audit, failed = jobs.build_index(docs, entities, fields, Hash, path, now(), p)
    chunks = store.read_current(spark, path).drop("bucket")
    want = {r.document_id for r in docs.where("content <> '' AND NOT array_contains(tag_ids, 100) AND document_id <> 3").collect()}
    assert {r.document_id for r in chunks.select("document_id").distinct().collect()} == want
    assert {r.document_id for r in stamps.collect()} == want == {r.document_id for r in audit.collect()}
    assert [r.document_id for r in failed.collect()] == [3]
    assert {r.document_id for r in jobs.incomplete(docs, chunks, D.INBOX).collect()} == {3}

    changed = docs.where("document_id <> 5").withColumn(
        "content", F.when(F.col("document_id") == 2, F.lit("short now")).otherwise(F.col("content"))
    )
    wanted = spark.createDataFrame([(2,), (3,), (5,)], "document_id long")
    jobs.refresh_index(spark, changed, entities, fields, wanted, Hash, path, str(tmp_path / "stage"), "drift", now())
    after = {r.document_id: r.passage for r in store.read_current(spark, path).where("chunk_index = 0").collect()}
    assert after[2] == "short now" and 5 not in after and set(after) == want - {5}

    index = store.read_current(spark, path).drop("bucket")
    one = index.where("document_id = 2").first()
    prefix = f"Title: {one.title}\nType: {one.document_type}\nFrom: {one.correspondent}\n"
    fields_text = "".join(f"{k}: {v}\n" for k, v in one.custom_fields.items())
    tags = f"Tags: {', '.join(one.tags)}\n" if one.tags else ""
    question = prefix + tags + fields_text + "\nshort now"
    questions = spark.createDataFrame([(1, 1, question), (2, 2, "?"), (3, 3, "x")], "query_id long, session_id long, question string")
    rewrites = spark.createDataFrame([(2, f'"{question}"'), (3, "y" * 301)], "query_id long, rewrite string")
    turns = spark.createDataFrame([(1, 0, "user", "before")], "session_id long, turn_no long, role string, content string")
    summaries = spark.createDataFrame([(1, "sum")], "session_id long, summary string")
    memories = spark.createDataFrame([(1, "fact", [1.0] * 32)], "memory_id long, text string, vector array<double>")
    messages, sources = jobs.ask(
        index, questions, rewrites, turns, summaries, memories, Hash, "P.", "http://h", top_n=1, min_score=0.99
    )
    by_query = {r.query_id: r.messages for r in messages.collect()}
    assert set(by_query) == {1, 2}
    assert [m.role for m in by_query[1]] == ["system", "user", "user"] and "sum" in by_query[1][0].content
    assert by_query[2][1].content.startswith("Documents:\n[1] ")
    assert {(r.query_id, r.citation, r.document_id, r.score) for r in sources.collect()} == {(1, 1, 2, 1.0), (2, 1, 2, 1.0)}


def test_suggest(spark, sf):
    docs, entities, fields = small(spark, sf)
    chunks = D.chunk_vec(spark, sf)
    vectors = chunks.where("chunk_index = 0").select("document_id", "vector")
    described = spark.createDataFrame([(1, "title", "be brief")], "position long, key string, description string")
    made, failed = jobs.suggest(
        docs, chunks, vectors, entities, fields, described, Model, "T {content}", now(), 12_000, existing_only={"tag": True, "correspondent": True}
    )
    rows = made.collect()
    assert {r.truncated for r in rows} <= {True, False} and None not in {r.truncated for r in rows}
    assert rows and all(r.tags == ["QUALITY"] and r.correspondent is None and r.title == "New" for r in rows)
    assert len(rows) + failed.count() == docs.count()


def test_scan_job_and_auto_apply(spark, sf):
    state = D.entity_vec(spark, sf).selectExpr(
        "*", "false excluded", "true embedding_stored", "CAST(NULL AS TIMESTAMP_NTZ) last_scanned_at", "CAST(NULL AS TIMESTAMP_NTZ) description_updated_at"
    )
    p = scan.ScanParams(top_k=500, add=0.60, remove=0.50, min_chunks=1, max_suggestions=20)
    none = D.suggestion(spark, sf).limit(0)
    docs = D.archive(spark, sf)
    made, summary = jobs.run_scan(
        D.chunk_vec(spark, sf), state, docs, D.scan_name(spark, sf), D.dismissal(spark, sf).limit(0), none, p, now(), "m", None, D.tracking(spark, sf)
    )
    s = summary.first()
    assert made.count() == 20 and s.capped > 0 and s.skipped_pending == 0
    assert s.added + s.removed + s.replaced + s.review == made.select(F.explode("evidence.actions")).count()
    queued = made.withColumn("actions", F.col("evidence.actions"))
    assert jobs.auto_apply(queued, False, now()).outcomes.count() == 0
    done = jobs.auto_apply(queued, True, now())
    assert {r.outcome for r in done.outcomes.collect()} == {"approved"}
    assert done.audit.where("change_source = 'automation'").count() == 20


def test_retention_drops_days(spark, sf, tmp_path):
    audit = D.audit(spark, sf).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    path = str(tmp_path / "audit")
    store.append_days(audit, path)
    cutoff = datetime.datetime(2024, 1, 10, 12, 0, 0)
    for _ in range(2):
        store.drop_before(spark, path, cutoff, str(tmp_path / "stage"))
    want = audit.where(F.col("changed_at") >= F.lit(cutoff)).count()
    assert spark.read.parquet(path).count() == want < audit.count()

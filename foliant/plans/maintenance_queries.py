"""Store, re-embedding, webhook and limiter queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import chunking, retrieval
from foliant.operators import maintenance as M
from foliant.operators import queue as G
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query
from foliant.session import ensure_checkpoint_dir
from foliant.sources import documents as S
from foliant.sources import store
from foliant.streaming import webhook as WH

NOW = "2024-06-01 00:00:00"


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


# --- chunk table -----------------------------------------------------------------------

_OLD = """SELECT document_id, i AS chunk_index, substring(content, i*800+1, 1000) AS passage FROM (
  SELECT document_id, content, unnest(CASE WHEN length(content)=0 THEN []::BIGINT[] WHEN length(content)<=1000 THEN [0::BIGINT]
    ELSE range(0,(length(content)-1)//800+1) END) AS i FROM {docs})"""
UPSERT = dict(
    edited="""SELECT document_id, CASE WHEN document_id%14=0 THEN '' ELSE 'new ' || content END AS content FROM document WHERE document_type_id=1 OR document_id%7=0""",
    old_chunks=_OLD.format(docs="document"),
    new_chunks=_OLD.format(docs="edited"),
)
UPSERT_SQL = """SELECT document_id, chunk_index, length(passage) AS chars, md5(passage) AS digest FROM old_chunks WHERE document_id NOT IN (SELECT document_id FROM edited)
  UNION ALL SELECT document_id, chunk_index, length(passage), md5(passage) FROM new_chunks"""


def _texts(spark, sf):
    docs = D.document(spark, sf).select("document_id", "document_type_id", "content")
    edited = docs.where((F.col("document_type_id") == 1) | (F.col("document_id") % 7 == 0)).withColumn(
        "content", F.when(F.col("document_id") % 14 == 0, "").otherwise(F.concat(F.lit("new "), "content"))
    )
    return docs.drop("document_type_id"), edited.drop("document_type_id")


def _digest(chunks):
    return chunks.select("document_id", "chunk_index", F.length("passage").cast("long").alias("chars"), F.md5("passage").alias("digest"))


@query("chunk_upsert", with_(UPSERT_SQL, **UPSERT))
def chunk_upsert(spark, sf):
    docs, edited = _texts(spark, sf)
    return _digest(store.upsert(chunking.chunk(docs), chunking.chunk(edited), edited))


@query("chunk_upsert_table", with_(UPSERT_SQL, **UPSERT))
def chunk_upsert_table(spark, sf):
    """The same through the durable table: full version, then a bucketed upsert."""
    docs, edited = _texts(spark, sf)
    path = scratch(spark)
    store.write_version(chunking.chunk(docs), path)
    store.upsert_buckets(spark, path, chunking.chunk(edited), edited)
    return _digest(store.read_current(spark, path))


@query("chunk_reindex", with_("SELECT document_id, chunk_index, length(passage) AS chars, md5(passage) AS digest FROM new_chunks", **UPSERT))
def chunk_reindex(spark, sf):
    docs, edited = _texts(spark, sf)
    path = scratch(spark)
    store.write_version(chunking.chunk(docs), path)
    store.write_version(chunking.chunk(edited), path)
    return _digest(store.read_current(spark, path))


def _legacy(spark, sf):
    c = D.chunk_vec(spark, sf)
    broken = F.col("document_id") % 20 == 0
    return c.select(
        F.col("chunk_id").alias("id"), "vector", F.col("passage").alias("document"), "document_id", "title",
        F.when(broken, F.lit("[not json")).otherwise(F.to_json("tags")).alias("tags_json"),
        F.when(broken, F.lit(None).cast("string")).otherwise(F.to_json("tag_ids")).alias("tag_ids_json"),
        "correspondent", "document_type", F.to_json("custom_fields").alias("custom_fields_json"), "chunk_index", "total_chunks",
    )


@query(
    "vector_migrate",
    with_(
        """SELECT chunk_id, document_id, chunk_index, total_chunks, CASE WHEN document_id%20=0 THEN '' ELSE array_to_string(tags,',') END AS tags,
        CASE WHEN document_id%20=0 THEN '' ELSE array_to_string(tag_ids,',') END AS tag_ids, cf_batch AS batch, len(vector) AS dims, length(passage) AS chars FROM chunk_vec"""
    ),
)
def vector_migrate(spark, sf):
    rows, _ = store.migrate(_legacy(spark, sf), None)
    return rows.select(
        "chunk_id", "document_id", "chunk_index", "total_chunks", F.array_join("tags", ",").alias("tags"),
        F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tag_ids"), F.try_element_at("custom_fields", F.lit("batch")).alias("batch"),
        F.size("vector").cast("long").alias("dims"), F.length("passage").cast("long").alias("chars"),
    )


@query(
    "migrate_sparse_terms",
    with_(
        r"""SELECT document_id, chunk_index, term, count(*) AS tf FROM (
        SELECT document_id, chunk_index, unnest(regexp_split_to_array(lower(trim(passage, E' \n\t\r')), '\s+')) AS term FROM chunk_vec) WHERE term<>'' GROUP BY ALL"""
    ),
)
def migrate_sparse_terms(spark, sf):
    rows, _ = store.migrate(_legacy(spark, sf), None)
    return chunking.sparse_terms(rows, list(retrieval.POINT))


@query(
    "memory_migrate",
    with_("SELECT memory_id, text, round(list_sum(vector),6) AS total FROM memory_vec WHERE memory_id%10<>0"),
)
def memory_migrate(spark, sf):
    source = D.memory_vec(spark, sf).withColumn("vector", F.when(F.col("memory_id") % 10 != 0, F.col("vector")))
    moved = store.migrate_memories(source, None)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return moved.select("memory_id", "text", F.round(total, 6).alias("total"))


@query(
    "log_current",
    with_(
        """SELECT document_id, arg_max(new_value, (changed_at, id)) AS value FROM audit GROUP BY document_id HAVING arg_max(action_type, (changed_at, id))<>'error'"""
    ),
)
def log_current(spark, sf):
    log = D.audit(spark, sf).select(
        "document_id", "changed_at", "id", F.col("new_value").alias("value"), (F.col("action_type") == "error").alias("deleted")
    )
    return store.current(log, ["document_id"], ["changed_at", "id"], "deleted").select("document_id", "value")


# --- inbox and re-embedding -------------------------------------------------------------------


@query(
    "new_inbox_docs",
    with_("SELECT document_id FROM document WHERE list_contains(tag_ids,100) AND document_id NOT IN (SELECT document_id FROM tracking)"),
)
def new_inbox_docs(spark, sf):
    inbox = S.inbox(D.document(spark, sf), D.INBOX)
    return M.new_inbox_documents(inbox, D.tracking(spark, sf), D.ntz(NOW)).select("document_id")


@query(
    "unanalyzed_batches",
    with_(
        """SELECT document_id, (row_number() OVER (ORDER BY document_id)-1)//10 AS batch_no FROM document
        WHERE document_id NOT IN (SELECT document_id FROM tracking WHERE last_analyzed_at IS NOT NULL)"""
    ),
)
def unanalyzed_batches(spark, sf):
    return M.unanalysed_batches(S.inbox(D.document(spark, sf), None), D.tracking(spark, sf), 10)


@query(
    "mark_analyzed",
    with_(
        """SELECT document_id, CASE WHEN document_id%4=0 THEN '2024-06-01 00:00:00' ELSE strftime(last_analyzed_at, '%Y-%m-%d %H:%M:%S') END AS last_analyzed_at FROM tracking"""
    ),
)
def mark_analyzed(spark, sf):
    t = D.tracking(spark, sf)
    results = t.where(F.col("document_id") % 2 == 0).select("document_id", F.when(F.col("document_id") % 4 != 0, F.lit("timeout")).alias("error"))
    return M.mark_analysed(t, results, D.ntz(NOW)).select("document_id", D.stamp("last_analyzed_at").alias("last_analyzed_at"))


@query(
    "auto_apply",
    with_(
        """SELECT document_id, suggestion_id, change_source, new_value FROM (
        SELECT document_id, id AS suggestion_id, 'automation' AS change_source, CASE WHEN r=1 THEN 'suggestion:' || id ELSE 'superseded_by:' || first END AS new_value FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS r, min(id) OVER (PARTITION BY document_id) AS first FROM suggestion WHERE status='pending'))"""
    ),
)
def auto_apply(spark, sf):
    s = D.suggestion(spark, sf).where(F.col("status") == "pending")
    decided = G.decide(s, M.automatic_decisions(s, True, D.ntz(NOW)))
    return decided.audit.select("document_id", "suggestion_id", "change_source", "new_value")


@query(
    "mark_dirty",
    with_(
        """SELECT document_id, strftime(coalesce(reembed_dirty_since, first), '%Y-%m-%d %H:%M:%S') AS reembed_dirty_since FROM tracking
        LEFT JOIN (SELECT event_id%500+1 AS document_id, min(ts) AS first FROM events WHERE event_type='view' GROUP BY 1) USING (document_id)"""
    ),
)
def mark_dirty(spark, sf):
    changes = D.table(spark, sf, "events").where(F.col("event_type") == "view").select((F.col("event_id") % 500 + 1).alias("document_id"), "ts")
    out = M.mark_dirty(D.tracking(spark, sf), changes)
    return out.select("document_id", D.stamp("reembed_dirty_since").alias("reembed_dirty_since"))


PLAN = """SELECT t.document_id, CASE WHEN t.document_id%9=0 THEN 'keep' WHEN d.document_id IS NULL THEN 'purge' WHEN d.content='' THEN 'keep' ELSE 'reembed' END AS step
  FROM tracking t LEFT JOIN document d USING (document_id) WHERE reembed_dirty_since IS NOT NULL"""


def _plan(spark, sf):
    t = D.tracking(spark, sf)
    return M.flush_plan(t, D.document(spark, sf), t.where(F.col("document_id") % 9 == 0))


@query("flush_dirty", with_("SELECT * FROM flush_plan", flush_plan=PLAN))
def flush_dirty(spark, sf):
    return _plan(spark, sf)


@query(
    "flush_apply",
    with_(
        """SELECT document_id, CASE WHEN step IS DISTINCT FROM 'reembed' THEN strftime(reembed_dirty_since, '%Y-%m-%d %H:%M:%S') END AS reembed_dirty_since,
        CASE WHEN step='reembed' THEN '2024-06-01 00:00:00' ELSE strftime(last_embedded_at, '%Y-%m-%d %H:%M:%S') END AS last_embedded_at
        FROM tracking LEFT JOIN flush_plan USING (document_id) WHERE step IS DISTINCT FROM 'purge'""",
        flush_plan=PLAN,
    ),
)
def flush_apply(spark, sf):
    out = M.apply_flush(D.tracking(spark, sf), _plan(spark, sf), D.ntz(NOW))
    return out.select("document_id", D.stamp("reembed_dirty_since").alias("reembed_dirty_since"), D.stamp("last_embedded_at").alias("last_embedded_at"))


@query(
    "pending_reembeds",
    with_("SELECT count(reembed_dirty_since) AS pending, strftime(min(reembed_dirty_since), '%Y-%m-%d %H:%M:%S') AS oldest_dirty_since FROM tracking"),
)
def pending_reembeds(spark, sf):
    return M.pending_reembeds(D.tracking(spark, sf)).withColumn("oldest_dirty_since", D.stamp("oldest_dirty_since"))


@query(
    "content_drift",
    with_(
        """SELECT d.document_id FROM document d LEFT JOIN tracking t USING (document_id) WHERE modified::DATE >= DATE '2024-02-10' - 22
        AND content<>'' AND NOT coalesce(last_embedded_at >= modified, false)"""
    ),
)
def content_drift(spark, sf):
    return M.content_drift(D.document(spark, sf), D.tracking(spark, sf), D.ntz("2024-02-10 13:00:00"), 21)


@query(
    "record_embed",
    with_(
        """SELECT document_id, title AS document_title, '_event' AS field_name, 'document embedded (drift)' AS new_value, 'drift' AS change_source, 'embedded' AS action_type FROM document"""
    ),
)
def record_embed(spark, sf):
    return M.record_embed(D.document(spark, sf), "drift", D.ntz(NOW))[1].drop("changed_at")


@query(
    "record_embed_tracking",
    with_(
        """SELECT document_id, strftime(coalesce(t.first_seen_at, TIMESTAMP '2024-06-01'), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
        CASE WHEN d.document_id IS NOT NULL THEN '2024-06-01 00:00:00' ELSE strftime(t.last_embedded_at, '%Y-%m-%d %H:%M:%S') END AS last_embedded_at
        FROM tracking t FULL JOIN document d USING (document_id)"""
    ),
)
def record_embed_tracking(spark, sf):
    stamps, _ = M.record_embed(D.document(spark, sf), "drift", D.ntz(NOW))
    out = M.upsert_tracking(D.tracking(spark, sf), stamps, D.ntz(NOW))
    return out.select("document_id", D.stamp("first_seen_at").alias("first_seen_at"), D.stamp("last_embedded_at").alias("last_embedded_at"))


# --- webhook -----------------------------------------------------------------------------------

WEBHOOK = """SELECT event_id, ts, CASE WHEN k IN (0,1,2,3,8) AND t>0 THEN t END AS document_id,
  CASE WHEN k=4 THEN 'invalid_json' WHEN k=5 THEN 'unexpected_type' WHEN k IN (6,7) OR t=0 THEN 'no_document_id' END AS reason
  FROM (SELECT event_id, ts, event_id%9 AS k, event_id%1000 AS t FROM events)"""


@query("webhook_events", with_("SELECT event_id, document_id, reason FROM hooks", hooks=WEBHOOK))
def webhook_events(spark, sf):
    return WH.webhook_events(D.webhook_body(spark, sf)).select("event_id", "document_id", "reason")


@query(
    "webhook_reindex",
    with_(
        """SELECT h.document_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, any_value(d.title) AS title, any_value(length(d.content)) AS chars
        FROM hooks h JOIN document d ON d.document_id=h.document_id AND d.content<>'' GROUP BY h.document_id""",
        hooks=WEBHOOK,
    ),
)
def webhook_reindex(spark, sf):
    asked = WH.reindex_requests(WH.webhook_events(D.webhook_body(spark, sf)))
    docs = D.document(spark, sf).where(F.length("content") > 0)
    return asked.join(docs, "document_id").select("document_id", D.stamp("ts").alias("ts"), "title", F.length("content").cast("long").alias("chars"))


@query(
    "webhook_form",
    """SELECT event_id, CASE WHEN event_id%1000>0 AND event_id%6<5 THEN event_id%1000 END AS document_id,
      CASE WHEN NOT (event_id%1000>0 AND event_id%6<5) THEN 'no_document_id' END AS reason FROM events""",
)
def webhook_form(spark, sf):
    e = D.table(spark, sf, "events")
    k, t = F.col("event_id") % 6, (F.col("event_id") % 1000).cast("string")
    nested = lambda key: F.concat(F.lit('{"' + key + '": '), t, F.lit("}"))
    fields = (
        F.when(k == 0, F.create_map(F.lit("document_id"), t))
        .when(k == 1, F.create_map(F.lit("id"), t))
        .when(k == 2, F.create_map(F.lit("pk"), F.concat(F.lit(" "), t)))
        .when(k == 3, F.create_map(F.lit("document"), nested("id")))
        .when(k == 4, F.create_map(F.lit("document"), nested("document_id")))
        .otherwise(F.create_map(F.lit("document"), F.lit("oops")))
    )
    return WH.form_events(e.select("event_id", fields.alias("fields"))).select("event_id", "document_id", "reason")

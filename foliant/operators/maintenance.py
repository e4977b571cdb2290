"""Incremental jobs: inbox polling, analysis batches, re-embedding, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ranking import blocked_row_number, id_blocks


def new_inbox_documents(inbox: DataFrame, tracking: DataFrame, at: Column) -> DataFrame:
    """Tracking rows for inbox documents not seen before; append them before analysing."""
    return (
        inbox.select("document_id")
        .distinct()
        .join(tracking.select("document_id"), "document_id", "left_anti")
        .withColumn("first_seen_at", at)
    )


def unanalysed_batches(inbox: DataFrame, tracking: DataFrame, size: int) -> DataFrame:
    """(document_id, batch_no): untracked or unanalysed documents in batches of ``size`` by id."""
    done = tracking.where(F.col("last_analyzed_at").isNotNull()).select("document_id")
    open_ = inbox.select("document_id").distinct().join(done, "document_id", "left_anti")
    coarse, fine = id_blocks("document_id")
    numbered = blocked_row_number(open_, [], coarse, fine, [F.col("document_id")], "_n")
    return numbered.select("document_id", F.floor((F.col("_n") - 1) / max(1, size)).cast("long").alias("batch_no"))


def mark_analysed(tracking: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Stamps documents whose analysis succeeded; failed ones stay open for the next run."""
    good = results.where(F.col("error").isNull()).select("document_id").distinct().withColumn("_ok", F.lit(True))
    stamped = tracking.join(good, "document_id", "left").withColumn(
        "last_analyzed_at", F.when(F.col("_ok"), at).otherwise(F.col("last_analyzed_at"))
    )
    return stamped.drop("_ok")


def automatic_decisions(new: DataFrame, auto_apply: bool, at: Column) -> DataFrame:
    """Approvals by the automation for freshly queued suggestions; none unless switched on."""
    rows = new if auto_apply else new.limit(0)
    return rows.select(
        F.col("id").alias("decision_id"),
        F.col("id").alias("suggestion_id"),
        F.lit("approve").alias("verdict"),
        F.lit("automation").alias("change_source"),
        at.alias("decided_at"),
    )


# --- re-embedding -------------------------------------------------------------------------------


def mark_dirty(tracking: DataFrame, events: DataFrame) -> DataFrame:
    """Sets ``reembed_dirty_since`` to the first event of a tracked document; an earlier mark wins."""
    first = events.groupBy("document_id").agg(F.min("ts").alias("_first"))
    marked = tracking.join(first, "document_id", "left")
    return marked.withColumn("reembed_dirty_since", F.coalesce("reembed_dirty_since", "_first")).drop("_first")


def flush_plan(tracking: DataFrame, docs: DataFrame, unreachable: DataFrame | None = None) -> DataFrame:
    """(document_id, step) for marked documents: reembed, purge (gone from the source) or keep.

    A document without content, or one the source could not serve, keeps its mark.
    """
    dirty = tracking.where(F.col("reembed_dirty_since").isNotNull()).select("document_id")
    joined = dirty.join(docs.select("document_id", (F.length("content") > 0).alias("_text")), "document_id", "left")
    failed = F.lit(False)
    if unreachable is not None:
        joined = joined.join(
            unreachable.select("document_id").distinct().withColumn("_failed", F.lit(True)), "document_id", "left"
        )
        failed = F.coalesce("_failed", F.lit(False))
    step = F.when(failed, "keep").when(F.col("_text").isNull(), "purge").when(F.col("_text"), "reembed").otherwise("keep")
    return joined.select("document_id", step.alias("step"))


def apply_flush(tracking: DataFrame, plan: DataFrame, at: Column) -> DataFrame:
    """Tracking after a flush: marks of re-embedded documents cleared, purged rows gone."""
    joined = tracking.join(plan, "document_id", "left").where(~F.coalesce(F.col("step") == "purge", F.lit(False)))
    done = F.coalesce(F.col("step") == "reembed", F.lit(False))
    return joined.withColumns(
        {
            "reembed_dirty_since": F.when(~done, F.col("reembed_dirty_since")),
            "last_embedded_at": F.when(done, at).otherwise(F.col("last_embedded_at")),
        }
    ).drop("step")


def pending_reembeds(tracking: DataFrame) -> DataFrame:
    return tracking.agg(
        F.count("reembed_dirty_since").alias("pending"), F.min("reembed_dirty_since").alias("oldest_dirty_since")
    )


def content_drift(docs: DataFrame, tracking: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Ids of documents whose text may be newer than their vector.

    Looks one day further back than ``days``; a document counts unless its last
    embedding is at or after its modification. A missing stamp on either side
    counts as stale, empty content does not.
    """
    start = F.date_trunc("DAY", as_of - F.make_dt_interval(days=F.lit(days + 1)))
    window = docs.where((F.col("modified") >= start) & (F.length("content") > 0))
    joined = window.select("document_id", "modified").join(
        tracking.select("document_id", "last_embedded_at"), "document_id", "left"
    )
    fresh = F.coalesce(F.col("last_embedded_at") >= F.col("modified"), F.lit(False))
    return joined.where(~fresh).select("document_id")


def record_embed(embedded: DataFrame, source: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(tracking rows to upsert, audit rows) for documents that were just embedded."""
    tracking = embedded.select("document_id", at.alias("last_embedded_at"))
    audit = embedded.select(
        "document_id",
        F.nullif(F.col("title"), F.lit("")).alias("document_title"),
        F.lit("_event").alias("field_name"),
        F.lit(f"document embedded ({source})").alias("new_value"),
        F.lit(source).alias("change_source"),
        F.lit("embedded").alias("action_type"),
        at.alias("changed_at"),
    )
    return tracking, audit


def upsert_tracking(tracking: DataFrame, embedded: DataFrame, at: Column) -> DataFrame:
    """Tracking with new embedding stamps; a document first seen here gets a row."""
    joined = tracking.join(embedded.select("document_id", F.col("last_embedded_at").alias("_new")), "document_id", "full_outer")
    return joined.withColumns(
        {
            "first_seen_at": F.coalesce("first_seen_at", at),
            "last_embedded_at": F.coalesce("_new", "last_embedded_at"),
        }
    ).drop("_new")

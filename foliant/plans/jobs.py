"""Whole jobs composed from the operators: index, refresh, search, ask, suggest, scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.plugins import CompleterFactory, EmbedderFactory
from foliant.operators import analysis, chunking, converse, maintenance, queue, retrieval, scan
from foliant.session import cut
from foliant.sources import documents, store


@dataclass(frozen=True)
class IndexParams:
    chunk_size: int = chunking.CHUNK_SIZE
    chunk_overlap: int = chunking.CHUNK_OVERLAP
    strategy: str = "char"
    batch_size: int = 32
    inbox_tag: int | None = None


CHUNK_COLUMNS = (
    "document_id", "chunk_index", "total_chunks", "chunk_id", "passage", "title", "tags", "tag_ids",
    "correspondent", "document_type", "custom_fields", "vector",
)


def embedded_chunks(
    docs: DataFrame, entities: DataFrame, definitions: DataFrame, embedder: EmbedderFactory, p: IndexParams
) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, documents none of whose chunks could be embedded).

    The embedded rows are cut: a model call is not to be repeated because two
    branches read its result.
    """
    named = documents.resolve_names(docs, entities, definitions)
    chunks = chunking.with_embed_text(chunking.chunk(named, p.chunk_size, p.chunk_overlap, p.strategy))
    embedded = cut(chunking.embed(chunks, embedder, p.batch_size).drop("embed_text"))
    stored, failed = chunking.split_failed(embedded)
    return stored.select(*CHUNK_COLUMNS), failed


def build_index(
    docs: DataFrame,
    entities: DataFrame,
    definitions: DataFrame,
    embedder: EmbedderFactory,
    path: str,
    at: Column,
    params: IndexParams = IndexParams(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexes everything outside the inbox into a new version: (tracking stamps, audit rows, failed)."""
    none = docs.select("document_id").limit(0)
    picked = documents.to_index(docs, none, params.inbox_tag)
    rows, failed = embedded_chunks(picked, entities, definitions, embedder, params)
    store.write_version(rows, path)
    done = rows.where(F.col("chunk_index") >= 0).groupBy("document_id").agg(F.first("title").alias("title"))
    return (*maintenance.record_embed(done, "system:index", at), failed)


def refresh_index(
    spark: SparkSession,
    docs: DataFrame,
    entities: DataFrame,
    definitions: DataFrame,
    wanted: DataFrame,
    embedder: EmbedderFactory,
    path: str,
    staging: str,
    source: str,
    at: Column,
    params: IndexParams = IndexParams(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-embeds the ``wanted`` documents and upserts their buckets; documents gone from the source are purged.

    Documents none of whose chunks could be embedded keep their old chunks.
    """
    picked = docs.join(wanted.select("document_id").distinct(), "document_id", "left_semi").where(F.length("content") > 0)
    rows, failed = embedded_chunks(picked, entities, definitions, embedder, params)
    touched = wanted.select("document_id").distinct().join(failed, "document_id", "left_anti")
    store.upsert_buckets(spark, path, rows, touched, staging)
    done = rows.groupBy("document_id").agg(F.first("title").alias("title"))
    return (*maintenance.record_embed(done, source, at), failed)


def incomplete(docs: DataFrame, chunks: DataFrame, inbox_tag: int | None) -> DataFrame:
    """Documents a start-up run still has to index."""
    return documents.to_index(docs, retrieval.completeness(chunks).where("complete"), inbox_tag).select("document_id")


def embed_queries(queries: DataFrame, embedder: EmbedderFactory, column: str = "question") -> DataFrame:
    """(query_id, ..., vector); cut, since ranking and payload both read it."""
    return cut(chunking.embed(queries, embedder, column=column).drop("embed_model"))


def ask(
    chunks: DataFrame,
    questions: DataFrame,
    rewrites: DataFrame,
    turns: DataFrame,
    summaries: DataFrame,
    memories: DataFrame,
    embedder: EmbedderFactory,
    prompt: str,
    base_url: str,
    top_n: int = 5,
    min_score: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """(messages, sources) for a batch of questions (query_id, session_id, question).

    ``rewrites`` holds (query_id, rewrite) for questions that may need one;
    they are searched only where the question itself finds nothing. Questions
    without any hit are left out of the messages.
    """
    asked = embed_queries(questions, embedder)
    again = embed_queries(converse.accepted_rewrites(rewrites), embedder, "rewrite").select("query_id", "vector")
    hits = converse.search_with_fallback(chunks, asked, again, top_n, min_score)
    cited = cut(converse.citations(hits, chunks, top_n))
    answerable = questions.join(cited.select("query_id").distinct(), "query_id", "left_semi")
    messages = converse.chat_messages(
        answerable,
        converse.context(cited),
        converse.valid_history(turns),
        summaries,
        converse.retrieve_memories(memories, asked),
        prompt,
    )
    return messages, converse.sources(cited, base_url)


def suggest(
    docs: DataFrame,
    chunks: DataFrame,
    doc_vectors: DataFrame,
    entities: DataFrame,
    definitions: DataFrame,
    descriptions: DataFrame,
    completer: CompleterFactory,
    template: str,
    at: Column,
    max_chars: int | None,
    similar_docs: int = 5,
    fallback_n: int = 20,
    inbox_tag: int | None = None,
    existing_only: dict[str, bool] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(suggestions, failed): shortlist, prompt, model, parsing, creation policy.

    ``max_chars`` is what the model's window leaves for a text, None for whole texts;
    suggestions tell in ``truncated`` whose text was cut.
    """
    named = documents.resolve_names(docs, entities, definitions).withColumn(
        "current_tags", F.col("tags")
    )
    similar = retrieval.similar_entities(
        chunks, doc_vectors.withColumnRenamed("document_id", "query_id"), similar_docs, inbox_tag
    ).withColumnRenamed("query_id", "document_id")
    listed = analysis.entity_shortlist(named, similar, entities, fallback_n)
    described = analysis.entity_context(listed, entities, definitions, inbox_tag)
    instructions = analysis.field_instructions(descriptions, definitions).scalar()
    fitted = analysis.fit_content(described, max_chars).withColumn("_instructions", instructions)
    prompts = fitted.select(
        "document_id",
        analysis.build_prompt(F.lit(template), F.col("content"), F.col("entity_context"), F.col("_instructions")).alias("prompt"),
    )
    made, failed = analysis.analyse(prompts, completer, "plugin", "plugin", at)
    made = made.join(fitted.select("document_id", "truncated"), "document_id", "left")
    policy = existing_only or {}
    return analysis.creation_policy(cut(made), entities, policy), failed


def run_scan(
    chunks: DataFrame,
    state: DataFrame,
    docs: DataFrame,
    entities: DataFrame,
    dismissals: DataFrame,
    suggestions: DataFrame,
    params: scan.ScanParams,
    at: Column,
    model: str,
    inbox_tag: int | None = None,
    tracking: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new suggestions, summary) of a mismatch scan; with ``tracking`` only entities due for a rescan."""
    chosen = scan.eligible(state, inbox_tag)
    if tracking is not None:
        chosen = scan.needs_rescan(chosen, tracking)
    pending = suggestions.where(F.col("status") == "pending")
    found = scan.scan_candidates(chunks, chosen, docs, scan.active_dismissals(dismissals, at), pending, params)
    applied = scan.apply_actions(scan.cap_documents(scan.kept(found), params.max_suggestions), docs, entities)
    return scan.build_suggestions(applied, at, "plugin", model), scan.scan_summary(found, applied, params.max_suggestions)


def auto_apply(new: DataFrame, enabled: bool, at: Column) -> queue.Decided:
    """Approves freshly queued suggestions as the automation when switched on."""
    return queue.decide(new, maintenance.automatic_decisions(new, enabled, at))

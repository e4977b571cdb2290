"""From documents to chunk rows: splitting, embedding input, embedding, sparse terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.functions.plugins import CompleterFactory, EmbedderFactory, in_calls
from foliant.session import spread

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200


def chunk(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    strategy: str = "char",
    column: str = "content",
) -> DataFrame:
    """One row per chunk: all other document columns, chunk_index, total_chunks, chunk_id, passage.

    Any strategy other than ``sentence`` splits by characters. A pure map: no
    shuffle, and every expression stays in the JVM.
    """
    keep = [c for c in docs.columns if c != column]
    split = X.sentence_chunks if strategy == "sentence" else X.char_chunks
    wide = spread(docs) if strategy == "sentence" else docs
    # The text itself is not carried through the explode, only its chunks; and
    # the chunk array is used once, so that it is built once.
    numbered = F.get(
        F.transform(
            F.array(split(F.col(column), size, overlap)),
            lambda parts: F.transform(
                parts,
                lambda part, i: F.struct(i.alias("_pos"), F.size(parts).alias("_total"), part.alias("passage")),
            ),
        ),
        F.lit(0),
    )
    rows = wide.select(*keep, F.explode(numbered).alias("_c")).select(*keep, "_c.*")
    return rows.select(
        *keep,
        F.col("_pos").cast("long").alias("chunk_index"),
        F.col("_total").cast("long").alias("total_chunks"),
        F.concat_ws("_", "document_id", "_pos").alias("chunk_id"),
        "passage",
    )


def prefix_column() -> Column:
    """Embedding header from the resolved name columns of a document or chunk row."""
    return X.embed_prefix(
        F.col("title"), F.col("document_type"), F.col("correspondent"), F.col("tags"), F.col("custom_fields")
    )


def with_embed_text(chunks: DataFrame) -> DataFrame:
    """Adds ``embed_text``, the header followed by the passage."""
    return chunks.withColumn("embed_text", F.concat(prefix_column(), "passage"))


def embed(
    rows: DataFrame, embedder: EmbedderFactory, batch_size: int = 32, column: str = "embed_text"
) -> DataFrame:
    """Adds ``vector`` and ``embed_model`` by calling a plug-in embedder in Arrow batches.

    Calls carry min(batch_size, the model's own limit) texts. A text that fails
    gets a NULL vector; its row is kept for ``split_failed``.
    """
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("embed_model", T.StringType())]
    )

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        step = max(1, min(batch_size, model.max_batch))
        for batch in batches:
            texts = batch.column(column).to_pylist()
            vectors, _ = in_calls(model.embed, texts, step)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([None if v is None else [float(x) for x in v] for v in vectors], pa.list_(pa.float32())),
                    pa.array([model.name] * len(texts), pa.string()),
                ],
                names=[*batch.schema.names, "vector", "embed_model"],
            )

    return rows.mapInArrow(task, schema)


def split_failed(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, documents with no vector at all).

    Failed chunks are dropped as long as the document kept another one.
    """
    stored = embedded.where(F.col("vector").isNotNull())
    failed = (
        embedded.groupBy("document_id")
        .agg(F.count("vector").alias("_stored"), F.count(F.lit(1)).alias("chunks"))
        .where(F.col("_stored") == 0)
        .drop("_stored")
    )
    return stored, failed


def sparse_terms(rows: DataFrame, keys: list[str], column: str = "passage") -> DataFrame:
    """(keys, term, tf): lower-cased white-space tokens with counts.

    Texts are clustered by key before they are taken apart: they are shuffled once, their terms not at all.
    Every space becomes a plain one first, which is split without a pattern; empty pieces go.
    """
    tokens = F.split(F.translate(F.lower(column), X.SPACES, " " * len(X.SPACES)), " ")
    return (
        rows.select(*keys, column).repartition(*keys).select(*keys, F.explode(tokens).alias("term"))
        .where(F.col("term") != "")
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def truncate(docs: DataFrame, max_chars: int, column: str = "content") -> DataFrame:
    """Prefix that fits the model's window, and whether anything was cut."""
    return docs.withColumns(
        {
            "truncated": F.length(column) > max_chars,
            column: F.substring(F.col(column), F.lit(1), F.lit(max_chars)),
        }
    )


def page_batches(pages: DataFrame, pages_per_call: int = 10) -> DataFrame:
    """Numbers the model calls of a document: pages 1..N, N per call (at least one)."""
    step = max(1, pages_per_call)
    return pages.withColumn("call_no", F.floor((F.col("page_no") - 1) / step).cast("long"))


def assemble_transcript(calls: DataFrame) -> DataFrame:
    """(document_id, content): call texts stripped, blanks dropped, joined in page order."""
    kept = calls.withColumn("text", X.strip("text")).where(F.length("text") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("call_no", "text")))
    return kept.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("content")
    )


def complete(
    rows: DataFrame,
    completer: CompleterFactory,
    prompt: str = "prompt",
    out: str = "response",
    max_tokens: int = 1024,
    call_size: int = 16,
) -> DataFrame:
    """Adds ``out`` (NULL on failure), ``error`` and ``model`` from a plug-in text model, ``call_size`` prompts a call."""
    extra = [T.StructField(c, T.StringType()) for c in (out, "error", "model")]
    schema = T.StructType([*rows.schema.fields, *extra])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = completer()
        # A few calls at a time: prompts and answers of a whole batch are never held at once.
        step = 16 * call_size
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            prompts = batch.column(prompt).to_pylist()
            answers, errors = in_calls(lambda some: model.complete(some, max_tokens), prompts, call_size)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(answers, pa.string()),
                    pa.array(errors, pa.string()),
                    pa.array([model.name] * len(prompts), pa.string()),
                ],
                names=[*batch.schema.names, out, "error", "model"],
            )

    return rows.mapInArrow(task, schema)

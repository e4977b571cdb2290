"""Search over the chunk table for batches of queries.

Chunk input: the columns of ``schemas.CHUNK``. Query input: (query_id, vector).
Scores are (1 + cosine) / 2. Ties are broken by document_id, chunk_index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.plugins import Scorer, ScorerFactory
from foliant.functions.ranking import SALTS, salted_top_n
from foliant.functions.vectors import TopN, cosine, in_parts, on_grid, score_blocks, score_within, unit_score
from foliant.session import broadcast_if_small, cut
from foliant.sources.store import bucket, buckets_of

OVERFETCH = 5
POINT = ("document_id", "chunk_index")


def candidate_count(top_n: int, overfetch: int = OVERFETCH, rerank_top_k: int | None = None) -> int:
    """Chunks to fetch for ``top_n`` documents; a reranker fetches its own depth instead."""
    return max(rerank_top_k, top_n) if rerank_top_k else top_n * overfetch


def filter_chunks(
    chunks: DataFrame,
    tag_id: int | None = None,
    correspondent: str | None = None,
    document_type: str | None = None,
    exclude_tag: int | None = None,
) -> DataFrame:
    """Metadata filter applied before ranking; all given conditions must hold."""
    out = chunks
    if tag_id is not None:
        out = out.where(F.array_contains("tag_ids", F.lit(tag_id).cast("long")))
    if correspondent is not None:
        out = out.where(F.col("correspondent") == correspondent)
    if document_type is not None:
        out = out.where(F.col("document_type") == document_type)
    if exclude_tag is not None:
        carries = F.array_contains("tag_ids", F.lit(exclude_tag).cast("long"))
        out = out.where(~F.coalesce(carries, F.lit(False)))
    return out


def nearest(
    chunks: DataFrame, queries: DataFrame, n: int, keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """(keys, document_id, chunk_index, score, rank): the n best chunks per query.

    The scan reads only ids and vectors. Each task keeps n candidates per
    query, so the ranking shuffle carries n rows per query and task. Many queries bring n rows
    for each part of the chunks instead and are ranked in one step.
    """
    scored = score_blocks(chunks, queries, TopN(n), POINT, keys).withColumn("score", unit_score("cosine"))
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    return salted_top_n(scored, keys, order, n, POINT, salts=1 if in_parts(scored) else SALTS).select(*keys, *POINT, "score", "rank")


#: Documents whose ids are sent to the scan of a located table as a filter.
FETCHED_IDS = 1000


def with_payload(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Fetches payload columns for the ranked hits.

    The hits are materialised first: a count then proves them small enough to be
    broadcast, and no passage is shuffled; more of them join by shuffle. From a table with
    locations (``store.read_located``) only the buckets of the hits are read, by
    partition filters that the join makes at run time, and with few documents only row groups that may hold them.
    """
    cut_hits = cut(hits)
    known = broadcast_if_small(cut_hits, 100_000)
    buckets = buckets_of(chunks)
    if not buckets:
        return chunks.select(*POINT, *columns).join(known, list(POINT)).select(*hits.columns, *columns)
    source = chunks
    few = [r[0] for r in cut_hits.select("document_id").distinct().limit(FETCHED_IDS + 1).collect()]
    if len(few) <= FETCHED_IDS:
        source = source.where(F.col("document_id").isin(few))
    wanted = known.withColumn("bucket", bucket("document_id", buckets)).where(F.col("bucket") >= 0)
    return source.select("bucket", *POINT, *columns).join(wanted, ["bucket", *POINT]).select(*hits.columns, *columns)


def search_chunks(chunks: DataFrame, queries: DataFrame, n: int, **filters) -> DataFrame:
    """Top-n chunks per query with title and passage, after the metadata filter."""
    kept = filter_chunks(chunks, **filters)
    return with_payload(nearest(kept, queries, n), kept, "chunk_id", "title", "passage")


def nearest_native(chunks: DataFrame, query_vector: Column, n: int) -> DataFrame:
    """Top-n for one query given as an array column, in built-in expressions only.

    One literal vector needs no join: the planner runs it as a bounded top-k.
    """
    asked = chunks.where(F.col("vector").isNotNull()).withColumn("_q", query_vector)
    scored = asked.withColumn("_cos", on_grid(cosine("vector", "_q")))
    top = scored.orderBy(F.desc("_cos"), *POINT).limit(n)
    return top.withColumn("score", unit_score("_cos")).drop("_cos", "_q", "vector")


def _best_chunk(hits: DataFrame, by: str = "rank") -> DataFrame:
    """One row per (query, document): the best score, earliest candidate on ties."""
    best = F.max_by(F.struct(*POINT, "score"), F.struct(F.col("score"), -F.col(by)))
    return hits.groupBy("query_id", "document_id").agg(best.alias("_b")).select("query_id", "_b.*")


def group_documents(hits: DataFrame, top_n: int, min_score: float = 0.0) -> DataFrame:
    """Best chunk per document, minimum score, then the top documents per query."""
    docs = _best_chunk(hits.where(F.col("document_id") != 0)).where(F.col("score") >= min_score)
    # At most the candidate count per query arrives here, so a plain window is enough.
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return (
        docs.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= top_n)
    )


def search_documents(
    chunks: DataFrame,
    queries: DataFrame,
    top_n: int,
    min_score: float = 0.0,
    overfetch: int = OVERFETCH,
    base_url: str = "http://localhost:8000",
    rerank_scores: DataFrame | None = None,
    rerank_top_k: int | None = None,
    **filters,
) -> DataFrame:
    """Search grouped by document; ``rerank_scores`` (query_id, point, score) replaces the similarity."""
    kept = filter_chunks(chunks, **filters)
    hits = nearest(kept, queries, candidate_count(top_n, overfetch, rerank_top_k))
    if rerank_scores is not None:
        hits = apply_rerank(hits, rerank_scores)
    docs = group_documents(hits, top_n, min_score)
    return with_payload(docs, kept, "title", "passage").select(
        "query_id",
        "document_id",
        F.col("title").alias("document_title"),
        "passage",
        "score",
        X.deeplink(base_url, "document_id").alias("deeplink_url"),
        "rank",
    )


def filter_results(hits: DataFrame, min_score: float, reranked: bool = False) -> DataFrame:
    """Ungrouped results above ``min_score``; renumbered by score only when reranked."""
    kept = hits.where(F.col("score") >= min_score)
    order = [F.desc("score"), F.col("rank")] if reranked else [F.col("rank")]
    window = Window.partitionBy("query_id").orderBy(*order)
    return kept.withColumn("position", F.row_number().over(window).cast("long"))


def similar_entities(
    chunks: DataFrame, queries: DataFrame, top_n: int, exclude_tag: int | None = None, overfetch: int = OVERFETCH
) -> DataFrame:
    """(query_id, kind, name): metadata names used by the first ``top_n`` documents of each query.

    ``kind`` is tag, correspondent, document_type or ``field:<name>``.
    """
    kept = filter_chunks(chunks, exclude_tag=exclude_tag)
    hits = nearest(kept, queries, top_n * overfetch)
    first = hits.groupBy("query_id", "document_id").agg(
        F.min_by(F.struct(*POINT), "rank").alias("_p"), F.min("rank").alias("rank")
    )
    window = Window.partitionBy("query_id").orderBy("rank")
    picked = (
        first.withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= top_n)
        .select("query_id", "_p.*")
    )
    meta = with_payload(picked, kept, "tags", "correspondent", "document_type", "custom_fields")
    pair = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    names = F.concat(
        F.transform("tags", lambda t: pair(F.lit("tag"), t)),
        F.array(
            pair(F.lit("correspondent"), F.col("correspondent")),
            pair(F.lit("document_type"), F.col("document_type")),
        ),
        F.transform(
            F.map_entries("custom_fields"),
            lambda e: pair(F.concat(F.lit("field:"), e["key"]), e["value"]),
        ),
    )
    found = meta.select("query_id", F.explode(names).alias("_n")).select("query_id", "_n.*")
    return found.where(~X.blank("name")).distinct()


# --- sparse and hybrid ---------------------------------------------------------


def idf(terms: DataFrame, total: DataFrame) -> DataFrame:
    """(term, idf) from a term table; ``total`` is a one-row count of indexed chunks."""
    n = total.select(F.first("total")).scalar()
    weight = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("idf"))


def sparse_scores(terms: DataFrame, query_terms: DataFrame, total: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index, score): dot product with IDF-weighted terms.

    Query terms are cut down to those in the index first, and document
    frequencies are counted for those terms only. The index terms are clustered
    by chunk and the weights of the queries broadcast when a count proves them
    small, so that sums per (query, chunk) need no exchange of their own; more
    weights join by term instead.
    """
    wanted = terms.join(query_terms.select("term").distinct(), "term", "left_semi")
    weights = query_terms.join(idf(wanted, total), "term").select(
        "query_id", "term", (F.col("tf") * F.col("idf")).alias("_w")
    )
    return (
        wanted.repartition(*POINT)
        .join(broadcast_if_small(cut(weights), 200_000), "term")
        .groupBy("query_id", *POINT)
        .agg(F.sum(F.col("tf") * F.col("_w")).alias("score"))
    )


def nearest_sparse(terms: DataFrame, query_terms: DataFrame, total: DataFrame, n: int) -> DataFrame:
    scored = sparse_scores(terms, query_terms, total).withColumn("_s", F.round("score", 9))
    order = [F.desc("_s"), *[F.col(k) for k in POINT]]
    return salted_top_n(scored, ["query_id"], order, n, POINT).drop("_s")


def fuse_rrf(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 2, rank_base: int = 0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: sum of 1 / (k + rank)."""
    part = lambda df: df.select("query_id", *POINT, (F.lit(1.0) / (F.col("rank") - 1 + rank_base + k)).alias("_r"))
    fused = part(dense).unionByName(part(sparse)).groupBy("query_id", *POINT).agg(F.sum("_r").alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), *POINT)
    return fused.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= limit)


def minmax(hits: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] per query; all 1.0 when they hardly differ."""
    bounds = hits.groupBy("query_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span < 1e-9, F.lit(1.0)).otherwise((F.col("score") - F.col("_lo")) / span)
    return hits.join(bounds, "query_id").withColumn("score", scaled).drop("_lo", "_hi")


# --- reranking -----------------------------------------------------------------


def normalise_ten(score: Column) -> Column:
    """A 0..10 judgement in [0, 1]; a missing one counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) / 10))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def normalise_scores(raw: DataFrame, kind: str) -> DataFrame:
    """Raw scorer output (``raw_score``) on the common [0, 1] scale."""
    rule = {
        "ten": normalise_ten(F.col("raw_score")),
        "logit": sigmoid(F.col("raw_score")),
        "unit": F.coalesce(F.col("raw_score"), F.lit(0.0)),
    }[kind]
    return raw.withColumn("score", rule)


def apply_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Replaces candidate scores; a query whose scorer failed (no rows) gets 0.5 throughout."""
    s = scores.select("query_id", *POINT, F.col("score").alias("_new"))
    answered = scores.select("query_id").distinct().withColumn("_ok", F.lit(True))
    joined = hits.join(s, ["query_id", *POINT], "left").join(answered, "query_id", "left")
    score = F.when(F.col("_ok"), F.coalesce("_new", F.lit(0.0))).otherwise(F.lit(0.5))
    return joined.withColumn("score", score).drop("_new", "_ok")


def rerank(
    hits: DataFrame, query_texts: DataFrame, scorer: ScorerFactory, passage_chars: int | None = None
) -> DataFrame:
    """Scores the candidates of each query with a plug-in scorer, in candidate order.

    ``hits`` carries ``passage`` and at most the candidate count per query.
    ``passage_chars`` bounds the text sent to a prompt-based scorer. Rows are
    clustered by query; a task makes one scorer and holds one query's rows.
    """

    def one_query(model: Scorer, frame: pd.DataFrame) -> pd.DataFrame:
        passages = [p[:passage_chars] if passage_chars else p for p in frame["passage"]]
        try:
            raw = [float(s) for s in model.score(frame["query_text"].iloc[0], passages)]
            raw = (raw + [0.0] * len(passages))[: len(passages)]
            if model.kind == "ten":
                score = np.clip(np.array(raw) / 10, 0, 1)
            elif model.kind == "logit":
                score = 1 / (1 + np.exp(-np.clip(np.array(raw), -700, 700)))
            else:
                score = np.array(raw)
        except Exception:  # a failed call keeps the vector order
            score = np.full(len(passages), 0.5)
        return frame[["query_id", *POINT, "rank"]].assign(score=score)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = scorer(), None
        for frame in frames:
            if frame.empty:
                continue
            frame = frame if held is None else pd.concat([held, frame])
            open_ = frame["query_id"] == frame["query_id"].iloc[-1]
            held = frame[open_]
            for _, rows in frame[~open_].groupby("query_id", sort=False):
                yield one_query(model, rows)
        if held is not None:
            yield one_query(model, held)

    rows = hits.join(query_texts.select("query_id", "query_text"), "query_id").select(
        "query_id", "query_text", *POINT, "rank", "passage"
    )
    id_type = hits.schema["query_id"].dataType.simpleString()
    clustered = rows.repartition("query_id").sortWithinPartitions("query_id", "rank")
    return clustered.mapInPandas(task, f"query_id {id_type}, document_id long, chunk_index long, rank long, score double")


# --- approximate search ----------------------------------------------------------


def _int8(matrix: np.ndarray) -> np.ndarray:
    top = np.abs(matrix).max(axis=1, keepdims=True)
    return np.rint(np.divide(matrix, top, out=np.zeros_like(matrix), where=top > 0) * 127)


def quantised_nearest(chunks: DataFrame, queries: DataFrame, n: int, oversample: int = 2) -> DataFrame:
    """Approximate top-n: rank by int8 vectors, then rescore exactly.

    Candidates are the ``n * oversample`` best by the cosine of the codes; only
    their full vectors are read again. Codes of one bit a dimension are stored in
    an index (``sources.vector_index``) and searched there.
    """

    def to_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            codes = _int8(flat.reshape(batch.num_rows, -1)).astype(np.float32)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * codes.shape[1])
            vector = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[c for c, name in zip(batch.columns, batch.schema.names) if name != "vector"], vector],
                names=[*[name for name in batch.schema.names if name != "vector"], "vector"],
            )

    points = chunks.select(*POINT, "vector").where(F.col("vector").isNotNull())
    wanted = queries.select("query_id", "vector")
    codes = points.mapInArrow(to_codes, "document_id long, chunk_index long, vector array<float>")
    query_codes = wanted.mapInArrow(
        to_codes, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<float>"
    )
    candidates = nearest(codes, query_codes, n * oversample).select("query_id", *POINT)
    return rescore(candidates, points, wanted, n)


def rescore(candidates: DataFrame, points: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Exact top-n among candidate (query, chunk) pairs."""
    pairs = candidates.join(points.select(*POINT, "vector"), list(POINT)).join(
        queries.select("query_id", F.col("vector").alias("_q")), "query_id"
    )
    scored = pairs.select("query_id", *POINT, on_grid(cosine("vector", "_q")).alias("cosine"))
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    return (
        salted_top_n(scored, ["query_id"], order, n, POINT)
        .withColumn("score", unit_score("cosine"))
        .drop("cosine")
    )


def train_cells(chunks: DataFrame, cells: int, seed: int = 7, share: float = 1.0, iterations: int = 10) -> DataFrame:
    """(cell, vector): k-means centroids of unit vectors, trained on all of them or a ``share`` the caller sets.

    Only the centroids depend on it; every chunk is assigned to a cell and stays searchable.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = chunks.where(F.col("vector").isNotNull()).select(_unit("vector").alias("unit"))
    unit = unit if share >= 1 else unit.sample(share, seed=seed)
    unit = cut(unit).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, featuresCol="features").fit(unit)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return chunks.sparkSession.createDataFrame(rows, "cell long, vector array<double>")


def _unit(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def assign_cells(points: DataFrame, cells: DataFrame, keys: tuple[str, ...], probes: int = 1) -> DataFrame:
    """(keys, vector, cell): the ``probes`` nearest cells of each point. The centroid table is small by construction."""
    table = cells.orderBy("cell").toArrow()
    centroids = np.array(table.column("vector").to_pylist(), dtype=np.float64)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-30)
    ids = table.column("cell").to_numpy()
    width = min(probes, len(ids))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            near = np.argsort(-(flat.reshape(batch.num_rows, -1) @ centroids.T), axis=1, kind="stable")[:, :width]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), width))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(rows) for c in batch.columns], pa.array(ids[near.ravel()])],
                names=[*batch.schema.names, "cell"],
            )

    chosen = points.select(*keys, "vector")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema) + ", cell long"
    return chosen.mapInArrow(task, schema)


def cell_nearest(chunks: DataFrame, queries: DataFrame, cells: DataFrame, n: int, probes: int = 4) -> DataFrame:
    """Approximate top-n through an inverted cell index; scores are exact.

    Queries meet chunks by an equi-join on the cell, so the cost grows with
    probes / cells of the table. Inside a cell, packed chunk blocks are
    multiplied with the cell's queries; a cell that holds many copies has many
    blocks, which are salted over the tasks.
    """
    points = chunks.where(F.col("vector").isNotNull())
    home = assign_cells(points, cells, POINT).withColumnRenamed("cell", "block")
    probe = assign_cells(queries, cells, ("query_id",), probes).withColumnRenamed("cell", "block")
    scored = score_within(home, probe, TopN(n), POINT, ("query_id",))
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    return (
        salted_top_n(scored, ["query_id"], order, n, POINT)
        .withColumn("score", unit_score("cosine"))
        .drop("cosine")
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-n that an approximate search returned, over all queries."""
    hit = exact.join(found.select("query_id", *POINT).withColumn("_hit", F.lit(1)), ["query_id", *POINT], "left")
    return hit.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("found"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"),
    )


# --- index state -----------------------------------------------------------------


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Stored and expected number of chunks per document."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("stored"),
        F.max_by("total_chunks", "chunk_index").alias("expected"),
    )


def completeness(chunks: DataFrame) -> DataFrame:
    """Adds ``complete``: stored >= expected, where an unknown expectation is the count itself."""
    counts = chunk_counts(chunks)
    return counts.withColumn("complete", F.col("stored") >= F.coalesce("expected", "stored"))


def dim_check(chunks: DataFrame, model_dim: int) -> DataFrame:
    """Histogram of stored dimensions, each marked when it forces a full re-index."""
    return (
        chunks.where(F.col("vector").isNotNull())
        .groupBy(F.size("vector").cast("long").alias("dim"))
        .agg(F.count(F.lit(1)).alias("chunks"))
        .withColumn("needs_reindex", F.col("dim") != model_dim)
    )


def reindex_reason(manifests: DataFrame) -> DataFrame:
    """What a configuration change costs, one row per index.

    Input: old_* and new_* of backend, model, chunk_size, strategy, and has_store.
    A backend switch migrates vectors unless the model changed too or nothing
    is stored; a chunking change asks for a re-index on its own.
    """
    changed = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    backend, model = changed("backend"), changed("model")
    chunking = changed("chunk_size") | changed("strategy")
    reason = (
        F.when(backend & model, "embed_changed_with_backend")
        .when(model, "embed_changed")
        .when(backend & ~F.col("has_store"), "no_store_to_migrate")
        .when(chunking, "chunk_changed")
        .when(backend, "migrate")
        .otherwise("none")
    )
    return manifests.select(
        "index_id",
        reason.alias("reason"),
        (~reason.isin("none", "migrate")).alias("reindex_required"),
        (backend & ~model & F.col("has_store")).alias("can_migrate"),
    )

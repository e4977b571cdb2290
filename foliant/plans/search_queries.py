"""Retrieval queries: every embedding is a query against the whole chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.vectors import cosine
from foliant.operators import chunking, retrieval
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query
from foliant.plans.text_queries import HASH_SQL
from foliant.session import cut, spread
from foliant.sources import posting_index, vector_index

SCORED = """
SELECT query_id, document_id, chunk_index, tag_ids, correspondent, document_type,
  round(list_cosine_similarity(q.vector, c.vector), 12) AS cos FROM query_vec q, chunk_vec c"""
RANKED = """
SELECT *, (1+cos)/2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank
FROM scored"""
HITS25 = "SELECT * FROM ranked WHERE rank <= 25"


def sql(body: str, **extra: str) -> str:
    return with_(body, scored=SCORED, ranked=RANKED, hits25=HITS25, **extra)


def inputs(spark, sf):
    """The stored chunk table and the queries."""
    return D.chunk_store(spark, sf), D.query_vec(spark, sf)


def index(spark, sf, build: bool = False):
    """The vector index of the chunk table: built by the first query that needs it, then read."""
    path = D.shared_path(spark, sf, "vectors")
    if build or not vector_index.exists(spark, path):
        return vector_index.build(D.chunk_store(spark, sf), path)
    return vector_index.opened(spark, path)


@query(
    "cosine",
    with_(
        """SELECT c.chunk_id, round(list_cosine_similarity(c.vector, q.vector), 6) AS cosine
        FROM chunk_vec c JOIN chunk_vec q ON q.document_id=c.document_id AND q.chunk_index=1-c.chunk_index"""
    ),
)
def cosine_query(spark, sf):
    c = D.chunk_vec(spark, sf)
    other = c.select("document_id", (1 - F.col("chunk_index")).alias("chunk_index"), F.col("vector").alias("w"))
    return c.join(other, ["document_id", "chunk_index"]).select("chunk_id", F.round(cosine("vector", "w"), 6).alias("cosine"))


@query(
    "knn_chunks",
    sql("SELECT query_id, document_id, chunk_index, round(score,6) AS score, rank FROM ranked WHERE rank<=10"),
)
def knn_chunks(spark, sf):
    hits = retrieval.nearest(*inputs(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "knn_single",
    with_(
        """SELECT chunk_id, title, round((1+cos)/2,6) AS score FROM (
        SELECT chunk_id, document_id, chunk_index, title,
          round(list_cosine_similarity(vector, (SELECT vector FROM entity_mean ORDER BY label LIMIT 1)), 12) AS cos
        FROM chunk_vec ORDER BY cos DESC, document_id, chunk_index LIMIT 20)"""
    ),
)
def knn_single(spark, sf):
    entities = D.entity_vec(spark, sf).where(F.col("entity_type") == "tag")
    vector = entities.agg(F.min_by("vector", "entity_id")).scalar()
    top = retrieval.nearest_native(D.chunk_vec(spark, sf), vector, 20)
    return top.select("chunk_id", "title", F.round("score", 6).alias("score"))


@query(
    "knn_by_vector",
    with_(
        """SELECT query_id, chunk_id, title, round((1+cos)/2,6) AS score, rank FROM (
        SELECT query_id, chunk_id, title, cos,
          row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM (
        SELECT query_id, document_id, chunk_index, chunk_id, title, round(list_cosine_similarity(q.vector, c.vector), 12) AS cos
        FROM query_vec q, chunk_vec c WHERE list_contains(c.tag_ids, 12) AND c.document_type='t1')) WHERE rank<=8"""
    ),
)
def knn_by_vector(spark, sf):
    hits = retrieval.search_chunks(*inputs(spark, sf), 8, tag_id=12, document_type="t1")
    return hits.select("query_id", "chunk_id", "title", F.round("score", 6).alias("score"), "rank")


DOCS = """
SELECT query_id, document_id, score, chunk_index,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS doc_rank FROM (
  SELECT query_id, document_id, max(score) AS score, min_by(chunk_index, rank) AS chunk_index
  FROM hits25 WHERE document_id<>0 GROUP BY query_id, document_id) WHERE score >= 0.55"""


@query(
    "knn_documents",
    sql(
        """SELECT d.query_id, d.document_id, c.title AS document_title, c.passage, round(d.score,6) AS score,
        'http://localhost:8000/documents/' || d.document_id || '/details' AS deeplink_url, d.doc_rank AS rank
        FROM docs d JOIN chunk_vec c USING (document_id, chunk_index) WHERE doc_rank<=5""",
        docs=DOCS,
    ),
)
def knn_documents(spark, sf):
    found = retrieval.search_documents(*inputs(spark, sf), top_n=5, min_score=0.55)
    return found.withColumn("score", F.round("score", 6))


@query(
    "text_search",
    f"""WITH t AS (SELECT doc_id+1 AS document_id, i AS chunk_index, substring(text, i*800+1, 1000) AS t FROM (
        SELECT doc_id, text, unnest(CASE WHEN length(text)<=1000 THEN [0::BIGINT] ELSE range(0,(length(text)-1)//800+1) END) AS i FROM documents)),
    c AS MATERIALIZED (SELECT document_id, chunk_index, {HASH_SQL} AS v FROM t),
    q AS MATERIALIZED (SELECT item_id AS query_id, {HASH_SQL} AS v FROM (SELECT item_id, text AS t FROM benchmark)),
    s AS (SELECT query_id, document_id, chunk_index, round(list_cosine_similarity(c.v, q.v), 12) AS cos FROM q, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM s),
    d AS (SELECT query_id, document_id, max((1+cos)/2) AS score FROM r WHERE rank<=25 GROUP BY query_id, document_id)
    SELECT query_id, document_id, round(score,6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM d) WHERE rank<=5""",
)
def text_search(spark, sf):
    """Whole text path: chunk all documents, hash-embed, search with every benchmark text."""
    from foliant.functions.text import hash_embedding

    docs = spread(D.table(spark, sf, "documents")).select((F.col("doc_id") + 1).alias("document_id"), F.col("text").alias("content"))
    chunks = chunking.chunk(docs).withColumn("vector", hash_embedding(F.col("passage")))
    queries = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), hash_embedding(F.col("text")).alias("vector"))
    docs = retrieval.group_documents(retrieval.nearest(chunks, queries, 25), 5)
    return docs.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query(
    "chunk_results",
    sql(
        """SELECT query_id, document_id, chunk_index, round(new_score,6) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS position
        FROM (SELECT *, ((document_id*7+chunk_index) % 11) / 10.0::DOUBLE AS new_score FROM hits25) WHERE new_score >= 0.5"""
    ),
)
def chunk_results(spark, sf):
    hits = cut(retrieval.nearest(*inputs(spark, sf), 25))
    # Stand-in rerank scores from the ids, as a table would supply them.
    scores = hits.select(
        "query_id", *retrieval.POINT, (((F.col("document_id") * 7 + F.col("chunk_index")) % 11) / F.lit(10.0)).alias("score")
    )
    kept = retrieval.filter_results(retrieval.apply_rerank(hits, scores), 0.5, reranked=True)
    return kept.select("query_id", *retrieval.POINT, F.round("score", 6).alias("score"), "position")


@query(
    "similar_entities",
    with_(
        """SELECT DISTINCT query_id, kind, name FROM (
          SELECT query_id, unnest(tags) AS name, 'tag' AS kind FROM picked
          UNION ALL SELECT query_id, correspondent, 'correspondent' FROM picked
          UNION ALL SELECT query_id, document_type, 'document_type' FROM picked
          UNION ALL SELECT query_id, cf_batch, 'field:batch' FROM picked) WHERE trim(name)<>''""",
        scored="SELECT query_id, document_id, chunk_index, round(list_cosine_similarity(q.vector, c.vector), 12) AS cos FROM query_vec q, chunk_vec c WHERE NOT list_contains(c.tag_ids, 13)",
        ranked="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM scored",
        firsts="SELECT query_id, document_id, min(rank) AS rank, min_by(chunk_index, rank) AS chunk_index FROM ranked WHERE rank<=20 GROUP BY ALL",
        picked="""SELECT query_id, tags, correspondent, document_type, cf_batch FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n
          FROM (SELECT query_id, document_id, min(rank) AS rank, min_by(chunk_index, rank) AS chunk_index
                FROM ranked WHERE rank<=20 GROUP BY query_id, document_id))
          JOIN chunk_vec USING (document_id, chunk_index) WHERE n<=4""",
    ),
)
def similar_entities(spark, sf):
    return retrieval.similar_entities(*inputs(spark, sf), top_n=4, exclude_tag=13)


# --- sparse, hybrid ---------------------------------------------------------------

TERMS = r"""
SELECT doc_id+1 AS document_id, 0::BIGINT AS chunk_index, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(trim(text, E' \n\t\r')), '\s+')) AS term FROM documents)
WHERE term<>'' GROUP BY doc_id, term"""
QTERMS = r"""
SELECT item_id AS query_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest(regexp_split_to_array(lower(trim(text, E' \n\t\r')), '\s+')) AS term FROM benchmark)
WHERE term<>'' GROUP BY item_id, term"""
SPARSE = """
SELECT q.query_id, t.document_id, t.chunk_index, sum(t.tf*q.tf*i.idf) AS score
FROM terms t JOIN query_term q USING (term) JOIN (
  SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM terms GROUP BY term) i USING (term)
GROUP BY ALL"""
SPARSE_RANKED = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, document_id, chunk_index) AS rank FROM sparse"""


def whole_documents(spark, sf):
    """Every document as one chunk, number 0 (not a literal: a constant key is folded, and rows then count as not clustered by it)."""
    return D.table(spark, sf, "documents").select(
        (F.col("doc_id") + 1).alias("document_id"), F.shiftright(F.abs("doc_id"), 63).cast("long").alias("chunk_index"), F.col("text").alias("passage")
    )


def sparse_inputs(spark, sf, build=False):
    """The stored sparse index of all documents (built by the first query that needs it) and the terms of the queries."""
    asked = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    path = D.shared_path(spark, sf, "terms")
    if build or not posting_index.exists(spark, path):
        docs = whole_documents(spark, sf)
        total = docs.agg(F.count(F.lit(1)).alias("total"))
        posting_index.build(chunking.sparse_terms(docs, list(retrieval.POINT)), total, path, buckets=8, doc_buckets=16)
    return posting_index.PostingIndex(spark, path), chunking.sparse_terms(asked, ["query_id"])


@query(
    "sparse_index",
    with_(
        """SELECT term, count(*) AS df, max(tf)::BIGINT AS max_tf FROM terms GROUP BY term""",
        terms=TERMS,
    ),
)
def sparse_index(spark, sf):
    """Builds the stored sparse index anew; document frequencies come from its term statistics."""
    built, _ = sparse_inputs(spark, sf, build=True)
    return built.terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))


@query(
    "sparse_score",
    with_(
        "SELECT query_id, document_id, round(score,6) AS score, rank FROM sparse_ranked WHERE rank<=100",
        terms=TERMS, query_term=QTERMS, sparse=SPARSE, sparse_ranked=SPARSE_RANKED,
    ),
)
def sparse_score(spark, sf):
    """The hundred best documents of each query."""
    best = posting_index.search(*sparse_inputs(spark, sf), 100)
    return best.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


HYBRID_CTES = dict(
    terms=TERMS,
    query_term=QTERMS,
    sparse=SPARSE,
    sparse_ranked=SPARSE_RANKED,
    doc_hash=f"SELECT doc_id+1 AS document_id, 0::BIGINT AS chunk_index, {HASH_SQL} AS v FROM (SELECT doc_id, text AS t FROM documents)",
    item_hash=f"SELECT item_id AS query_id, {HASH_SQL} AS v FROM (SELECT item_id, text AS t FROM benchmark)",
    dense_ranked="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM (
      SELECT query_id, document_id, chunk_index, round(list_cosine_similarity(d.v, q.v), 12) AS cos FROM doc_hash d, item_hash q)""",
    fused="""SELECT query_id, document_id, chunk_index, sum(r) AS score FROM (
      SELECT query_id, document_id, chunk_index, 1.0::DOUBLE/(rank-1+2) AS r FROM dense_ranked WHERE rank<=20
      UNION ALL SELECT query_id, document_id, chunk_index, 1.0::DOUBLE/(rank-1+2) FROM sparse_ranked WHERE rank<=20) GROUP BY ALL""",
    fused_ranked="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, document_id, chunk_index) AS rank
      FROM fused) WHERE rank<=20""",
)


def hybrid(spark, sf):
    from foliant.functions.text import hash_embedding

    terms, asked = sparse_inputs(spark, sf)
    docs = spread(D.table(spark, sf, "documents")).select(
        (F.col("doc_id") + 1).alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), hash_embedding(F.col("text")).alias("vector")
    )
    items = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), hash_embedding(F.col("text")).alias("vector"))
    dense = retrieval.nearest(docs, items, 20)
    return retrieval.fuse_rrf(dense, posting_index.search(terms, asked, 20), 20)


@query(
    "hybrid_rrf",
    with_("SELECT query_id, document_id, round(score,6) AS score, rank FROM fused_ranked", **HYBRID_CTES),
)
def hybrid_rrf(spark, sf):
    return hybrid(spark, sf).select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query(
    "rrf_minmax",
    with_(
        """SELECT query_id, document_id, round(CASE WHEN hi-lo<1e-9 THEN 1.0 ELSE (score-lo)/(hi-lo) END, 6) AS score FROM (
        SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM fused_ranked)""",
        **HYBRID_CTES,
    ),
)
def rrf_minmax(spark, sf):
    return retrieval.minmax(hybrid(spark, sf)).select("query_id", "document_id", F.round("score", 6).alias("score"))


# --- rerank, approximate -----------------------------------------------------------


@query(
    "rerank_scores",
    with_(
        """SELECT event_id, round(greatest(0.0, least(1.0, coalesce(v,0)/10)),6) AS ten,
        round(1/(1+exp(-v)),6) AS logit, round(coalesce(v,0),6) AS unit
        FROM (SELECT event_id, CASE WHEN event_id%10>0 THEN value-8 END AS v FROM events)"""
    ),
)
def rerank_scores(spark, sf):
    raw = D.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 > 0, F.col("value") - 8).alias("raw_score")
    )
    out = raw
    for kind in ("ten", "logit", "unit"):
        out = retrieval.normalise_scores(out, kind).withColumn(kind, F.round("score", 6)).drop("score")
    return out.drop("raw_score")


class LengthScorer:
    """Stand-in scorer: a 0..10 judgement from the passage length."""

    kind = "ten"

    def score(self, query, passages):
        return [len(p) % 11 for p in passages]


@query(
    "rerank",
    sql(
        """SELECT query_id, document_id, round(score,6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank
        FROM (SELECT query_id, document_id, max((length(passage)%11)/10.0::DOUBLE) AS score FROM ranked JOIN chunk_vec USING (document_id, chunk_index)
          WHERE rank<=20 GROUP BY query_id, document_id) QUALIFY rank<=5"""
    ),
)
def rerank(spark, sf):
    chunks, queries = inputs(spark, sf)
    hits = retrieval.with_payload(retrieval.nearest(chunks, queries, 20), chunks, "passage")
    asked = queries.select("query_id", F.concat(F.lit("question "), "query_id").alias("query_text"))
    scored = retrieval.rerank(hits, asked, LengthScorer)
    docs = retrieval.group_documents(scored, 5)
    return docs.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query("vector_index", "SELECT count(*) AS points, count(*) AS codes, 64::INTEGER AS dim, true AS tuned FROM embeddings")
def vector_index_build(spark, sf):
    """Builds the stored index anew; cells and codes hold every chunk once."""
    built = index(spark, sf, build=True)
    codes = built.codes.agg(F.count(F.lit(1)).alias("codes"))
    sums = built.cells.agg(F.sum("n").alias("points"), F.max("dim").alias("dim"), (F.max("probes") >= 1).alias("tuned"))
    return sums.crossJoin(codes)  # one row each


@query("ann_knn")
def ann_knn(spark, sf):
    built = index(spark, sf)
    return vector_index.search(built, D.query_vec(spark, sf), 10, probes=built.probes).withColumn("score", F.round("score", 6))


@query("ann_recall", "SELECT count(*) * 10 AS expected, true AS reached FROM embeddings")
def ann_recall(spark, sf):
    """Whether the approximate search returns nine tenths of the exact neighbours of all queries."""
    built, (chunks, queries) = index(spark, sf), inputs(spark, sf)
    found = vector_index.search(built, queries, 10, probes=built.probes)
    return retrieval.recall(found, retrieval.nearest(chunks, queries, 10)).select("expected", (F.col("recall") >= 0.9).alias("reached"))


@query(
    "knn_indexed",
    sql("SELECT query_id, document_id, chunk_index, round(score,6) AS score, rank FROM ranked WHERE rank<=10"),
)
def knn_indexed(spark, sf):
    """Exact search through the index: cells and blocks are skipped by bounds only."""
    return vector_index.search(index(spark, sf), D.query_vec(spark, sf), 10).withColumn("score", F.round("score", 6))


SIGNS = """SELECT query_id, document_id, chunk_index, cos,
  list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (qv[i] > 0) <> (cv[i] > 0) THEN 1 ELSE 0 END)) AS distance
  FROM (SELECT query_id, document_id, chunk_index, q.vector AS qv, c.vector AS cv,
    round(list_cosine_similarity(q.vector, c.vector), 12) AS cos FROM query_vec q, chunk_vec c)"""


@query(
    "quantized_knn",
    with_(
        """SELECT query_id, document_id, chunk_index, round((1+cos)/2, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank
        FROM signs JOIN (SELECT query_id, min(distance) AS bar FROM reached WHERE n >= 80 GROUP BY query_id) USING (query_id) WHERE distance <= bar) WHERE rank <= 10""",
        signs=SIGNS,
        reached="""SELECT query_id, distance, sum(count(*)) OVER (PARTITION BY query_id ORDER BY distance) AS n FROM signs GROUP BY query_id, distance""",
    ),
)
def quantized_knn(spark, sf):
    """Candidates by stored sign bits (all within the distance of the 80 nearest), rescored exactly."""
    chunks, queries = inputs(spark, sf)
    return vector_index.search_signs(index(spark, sf), chunks, queries, 10, 8).withColumn("score", F.round("score", 6))


@query(
    "quantized_knn_int8",
    with_(
        """SELECT query_id, document_id, chunk_index, round((1+cos)/2, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM coded WHERE place <= 20) WHERE rank <= 10""",
        query_code="SELECT query_id, vector, list_transform(vector, lambda x: round_even(x::DOUBLE / list_max(list_transform(vector, lambda y: abs(y::DOUBLE))) * 127, 0)) AS code FROM query_vec",
        chunk_code="SELECT document_id, chunk_index, vector, list_transform(vector, lambda x: round_even(x::DOUBLE / list_max(list_transform(vector, lambda y: abs(y::DOUBLE))) * 127, 0)) AS code FROM chunk_vec",
        coded="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, document_id, chunk_index) AS place FROM (
          SELECT query_id, document_id, chunk_index, round(list_cosine_similarity(q.code, c.code), 12) AS near,
            round(list_cosine_similarity(q.vector, c.vector), 12) AS cos FROM query_code q, chunk_code c)""",
    ),
)
def quantized_knn_int8(spark, sf):
    return retrieval.quantised_nearest(*inputs(spark, sf), 10, 2).withColumn("score", F.round("score", 6))


# --- index state ---------------------------------------------------------------------

# A store with holes: the second chunk of every fifth document was never written.
STORED = "SELECT * FROM chunk_vec WHERE NOT (document_id%5=0 AND chunk_index=1)"


def stored(spark, sf):
    return D.chunk_vec(spark, sf).where(~((F.col("document_id") % 5 == 0) & (F.col("chunk_index") == 1)))


@query("chunk_count", with_("SELECT count(*) AS total FROM stored", stored=STORED))
def chunk_count(spark, sf):
    return retrieval.chunk_count(stored(spark, sf))


@query(
    "chunk_counts_by_doc",
    with_("SELECT document_id, count(*) AS stored, max(total_chunks) AS expected FROM stored_chunks GROUP BY document_id", stored_chunks=STORED),
)
def chunk_counts_by_doc(spark, sf):
    return retrieval.chunk_counts(stored(spark, sf))


@query(
    "index_completeness",
    with_(
        """SELECT document_id, count(*) AS stored, max(total_chunks) AS expected, count(*)>=max(total_chunks) AS complete
        FROM stored_chunks GROUP BY document_id""",
        stored_chunks=STORED,
    ),
)
def index_completeness(spark, sf):
    return retrieval.completeness(stored(spark, sf))


@query(
    "dim_check",
    with_(
        """SELECT len(vector) AS dim, count(*) AS chunks, len(vector)<>48 AS needs_reindex FROM (
        SELECT CASE WHEN document_id%3=0 THEN vector[1:48] ELSE vector END AS vector FROM chunk_vec) GROUP BY len(vector)"""
    ),
)
def dim_check(spark, sf):
    mixed = D.chunk_vec(spark, sf).withColumn(
        "vector", F.when(F.col("document_id") % 3 == 0, F.slice("vector", 1, 48)).otherwise(F.col("vector"))
    )
    return retrieval.dim_check(mixed, 48)


@query(
    "reindex_reason",
    """SELECT event_id AS index_id, reason, reason NOT IN ('none','migrate') AS reindex_required, b AND NOT m AND s AS can_migrate FROM (
      SELECT *, CASE WHEN b AND m THEN 'embed_changed_with_backend' WHEN m THEN 'embed_changed' WHEN b AND NOT s THEN 'no_store_to_migrate'
        WHEN c THEN 'chunk_changed' WHEN b THEN 'migrate' ELSE 'none' END AS reason FROM (
      SELECT event_id, user_id%2=0 AS b, user_id%3=0 AS m, user_id%5<2 AS c, user_id%7>2 AS s FROM events))""",
)
def reindex_reason(spark, sf):
    user = F.col("user_id")
    pick = lambda test, a, b: F.when(test, F.lit(a)).otherwise(F.lit(b))
    manifests = D.table(spark, sf, "events").select(
        F.col("event_id").alias("index_id"),
        F.lit("local").alias("old_backend"),
        pick(user % 2 == 0, "server", "local").alias("new_backend"),
        F.lit("m1").alias("old_model"),
        pick(user % 3 == 0, "m2", "m1").alias("new_model"),
        F.lit(1000).alias("old_chunk_size"),
        pick(user % 5 == 0, 800, 1000).alias("new_chunk_size"),
        F.lit("char").alias("old_strategy"),
        pick(user % 5 == 1, "sentence", "char").alias("new_strategy"),
        (user % 7 > 2).alias("has_store"),
    )
    return retrieval.reindex_reason(manifests)

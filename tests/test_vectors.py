import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from foliant.functions import vectors
from foliant.functions.ranking import blocked_row_number, id_blocks, salted_top_n
from foliant.functions.vectors import AtLeast, TopN, cosine, on_grid, score_blocks
from foliant.operators import retrieval
from foliant.plans import derive as D


def frames(spark, points=300, queries=40, dim=8, seed=1):
    rng = random.Random(seed)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(dim)]
    base = [(i // 3 + 1, i % 3, vec()) for i in range(points)]
    # A third of all points are copies of one vector, and one vector is zero.
    base = [(d, c, base[0][2] if i % 3 == 0 else v) for i, (d, c, v) in enumerate(base)]
    base.append((9999, 0, [0.0] * dim))
    p = spark.createDataFrame(base, "document_id long, chunk_index long, vector array<double>")
    q = spark.createDataFrame([(i, vec()) for i in range(queries)], "query_id long, vector array<double>")
    return p, q


def native(p, q):
    """All pairs, in expressions only; a test oracle, not an operator."""
    pairs = p.crossJoin(q.select("query_id", F.col("vector").alias("w")))
    return pairs.select("query_id", "document_id", "chunk_index", on_grid(cosine("vector", "w")).alias("cosine"))


def as_set(df):
    return {(*r[:-1], round(r[-1], 9)) for r in df.collect()}


@pytest.mark.parametrize("cap", [4096, 7])
def test_top_n_equals_native(spark, cap):
    """The broadcast path and the shuffled path (cap below the query count) agree with all pairs."""
    p, q = frames(spark)
    found = score_blocks(p.repartition(5), q, TopN(11), max_broadcast=cap)
    order = [F.desc("cosine"), F.col("document_id"), F.col("chunk_index")]
    top = lambda df: salted_top_n(df, ["query_id"], order, 11, ["document_id", "chunk_index"])
    columns = ["query_id", "document_id", "chunk_index", "rank", "cosine"]
    assert as_set(top(found).select(columns)) == as_set(top(native(p, q)).select(columns))


@pytest.mark.parametrize("cap", [4096, 7])
def test_at_least_equals_native(spark, cap):
    p, q = frames(spark)
    found = score_blocks(p, q, AtLeast(0.3), max_broadcast=cap)
    assert as_set(found) == as_set(native(p, q).where("cosine >= 0.3"))


def test_many_queries_move_few_bytes(spark, monkeypatch):
    """Points in several parts give the same pairs, and a query travels once a part, however many shuffle partitions there are."""
    p, q = frames(spark)
    monkeypatch.setattr(vectors, "HELD_BYTES", 8 * 8 * 100, raising=False)
    monkeypatch.setattr(vectors, "LEAST_PRODUCTS", 1000, raising=False)
    monkeypatch.setattr(vectors, "SLICE_PRODUCTS", 500, raising=False)
    found = score_blocks(p, q, TopN(11), max_broadcast=7)
    order = [F.desc("cosine"), F.col("document_id"), F.col("chunk_index")]
    top = lambda df: salted_top_n(df, ["query_id"], order, 11, ["document_id", "chunk_index"])
    columns = ["query_id", "document_id", "chunk_index", "rank", "cosine"]
    assert as_set(top(found).select(columns)) == as_set(top(native(p, q)).select(columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in plan and "Join" in plan
    at_most = found.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert at_most <= 4 * 11  # 301 points in four parts of at most 100
    assert as_set(score_blocks(p, q, AtLeast(0.3), max_broadcast=7)) == as_set(native(p, q).where("cosine >= 0.3"))


def test_dimension_mismatch_fails(spark):
    p, q = frames(spark, points=6)
    short = q.withColumn("vector", F.slice("vector", 1, 4))
    with pytest.raises(Exception, match="dimension"):
        score_blocks(p, short, TopN(2)).collect()
    with pytest.raises(Exception, match="dimension"):
        spark.range(1).select(cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_empty_queries_and_zero_vector(spark):
    p, q = frames(spark, points=6)
    assert score_blocks(p, q.limit(0), TopN(2)).count() == 0
    zero = score_blocks(p.where("document_id = 9999"), q, TopN(1)).collect()
    assert zero and all(r.cosine == 0.0 for r in zero)


def test_document_zero_is_dropped(spark):
    hits = spark.createDataFrame(
        [(1, 0, 0, 0.9, 1), (1, 5, 0, 0.8, 2), (1, 5, 1, 0.8, 3), (1, 6, 0, 0.2, 4)],
        "query_id long, document_id long, chunk_index long, score double, rank long",
    )
    rows = retrieval.group_documents(hits, 5, 0.5).collect()
    assert [(r.document_id, r.chunk_index, r.rank) for r in rows] == [(5, 0, 1)]


def test_knn_plan(spark, sf):
    """Local limits before the ranking shuffle, vectors only in the scoring scan, no nested-loop join."""
    chunks, queries = D.chunk_vec(spark, sf), D.query_vec(spark, sf)
    plan = retrieval.nearest(chunks, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recall(spark, sf):
    chunks, queries = D.chunk_vec(spark, sf), D.query_vec(spark, sf)
    exact = retrieval.nearest(chunks, queries, 10)
    share = lambda found: retrieval.recall(found, exact).first().recall
    assert share(retrieval.quantised_nearest(chunks, queries, 10, 2)) > 0.95
    cells = retrieval.train_cells(chunks, 8)
    assert share(retrieval.cell_nearest(chunks, queries, cells, 10, probes=5)) > 0.7
    assert share(retrieval.cell_nearest(chunks, queries, cells, 10, probes=8)) == 1.0


def test_row_number_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice([0.0, 0.0, 0.25, rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s double, id long")
    got = blocked_row_number(
        df, ["k"], {"_b": F.floor(F.col("s") * 16)}, {"_s": F.col("s"), "_i": F.floor(F.col("id") / 50)},
        [F.col("s"), F.col("id")], "n",
    )
    want = {}
    for k in (1, 2):
        for n, (s, i) in enumerate(sorted((s, i) for kk, s, i in rows if kk == k), 1):
            want[i] = n
    assert {r.id: r.n for r in got.collect()} == want
    coarse, fine = id_blocks("id", 10, 7)
    plain = blocked_row_number(df, [], coarse, fine, [F.col("id")], "n")
    assert all(r.n == r.id + 1 for r in plain.collect())


def test_many_queries_are_dealt_evenly(spark, monkeypatch):
    """Parts and shares are balanced, so that fewer rows move for the same number of tasks."""
    moved = spark.sparkContext.accumulator(0)

    class Counted(vectors._Part):
        def __init__(self, points, rule, names):
            moved.add(points.num_rows)
            super().__init__(points, rule, names)

        def meet(self, queries):
            moved.add(queries.num_rows)
            return super().meet(queries)

    monkeypatch.setattr(vectors, "_Part", Counted)
    monkeypatch.setattr(vectors, "LEAST_PRODUCTS", 1000)
    vector = F.array(F.cos("id"), F.sin("id"))
    p = spark.range(3000).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), vector.alias("vector"))
    q = spark.range(5000).select(F.col("id").alias("query_id"), vector.alias("vector"))
    assert score_blocks(p, q, AtLeast(1.0)).count() >= 3000
    assert moved.value <= 40_000  # one part with a share for each task moved 101 000


def test_many_queries_are_ranked_once(spark):
    """Queries with n rows a part meet in one window, with the ranks of all pairs."""
    vector = F.array(F.cos("id"), F.sin("id"))
    p = spark.range(40).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), vector.alias("vector"))
    q = spark.range(4500).select(F.col("id").alias("query_id"), vector.alias("vector"))
    hits = retrieval.nearest(p, q, 3)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    order = [F.desc("cosine"), F.col("document_id"), F.col("chunk_index")]
    want = salted_top_n(native(p, q), ["query_id"], order, 3, ["document_id", "chunk_index"])
    columns = ["query_id", "document_id", "rank"]
    assert {tuple(r) for r in hits.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}


def test_rerank_scores_the_chunks_once(spark, sf):
    plan = queries()["chunk_results"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the hits are cut; they were scored for each use


def test_texts_without_embedding_are_not_shuffled(spark, sf):
    plan = D.chunk_vec(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan

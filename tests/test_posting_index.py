"""The stored sparse index against the exhaustive sum."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from foliant.operators import chunking, retrieval
from foliant.plans import search_queries
from foliant.sources import posting_index as PI


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(400)]
    rows = []
    for doc in range(1200):
        counts = Counter({"the": rng.randrange(1, 9), "of": rng.randrange(0, 5)})
        counts.update(rng.choice(rare) for _ in range(rng.randrange(12)))
        rows += [(doc // 2 + 1, doc % 2, t, c) for t, c in counts.items() if c]
    rows += [(9000 + i, 0, "tie", 1) for i in range(700)]
    asked = [(1, "the", 1), (1, "r1", 1), (1, "r2", 2), (2, "the", 3), (2, "of", 1), (3, "tie", 1), (3, "the", 1), (4, "r3", 1), (5, "missing", 1), (6, "r1", 1), (6, "missing", 2), (6, "of", 1)]
    terms = spark.createDataFrame(rows, "document_id long, chunk_index long, term string, tf long").cache()
    queries = spark.createDataFrame(asked, "query_id long, term string, tf long").cache()
    total = spark.createDataFrame([(1900,)], "total long")
    index = PI.build(terms, total, str(tmp_path_factory.mktemp("terms")), buckets=4, doc_buckets=4)
    yield terms, queries, total, index
    terms.unpersist(), queries.unpersist()


def table(df):
    return sorted((r.query_id, r["rank"], r.document_id, r.chunk_index, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("whole", [0.0, 1.0])
@pytest.mark.parametrize("n", [1, 10, 300, 3000])
def test_equals_the_exhaustive_sum(setup, monkeypatch, n, whole):
    monkeypatch.setattr(PI, "WHOLE", whole)
    terms, queries, total, index = setup
    assert table(PI.search(index, queries, n)) == table(retrieval.nearest_sparse(terms, queries, total, n))


def test_stop_words_make_no_candidates(setup):
    terms, queries, _, index = setup
    weighted, small = PI.weights(index, queries.where("query_id = 1"))
    found = PI.candidates(index, PI.essential_terms(index, weighted, small, 10), small).count()
    rare = terms.where("term in ('r1', 'r2')").select(*PI.POINT).distinct().count()
    assert 10 <= found <= rare < terms.where("term = 'the'").count() / 5


def test_layout(setup):
    terms, _, _, index = setup
    sizes = index.postings.selectExpr("n", "size(entries) = n as same", "array_max(transform(entries, e -> e.tf)) = max_tf as top").collect()
    assert all(r.n <= PI.BLOCK and r.same and r.top for r in sizes)
    assert index.terms.where("term = 'the'").selectExpr("sum(df) df").first().df == 1200
    assert sum(r.n for r in sizes) == terms.count() == index.forward.count()


def test_plan_prunes_term_folders(setup, monkeypatch):
    _, queries, _, index = setup
    monkeypatch.setattr(PI, "WHOLE", 1.0)
    plan = PI.search(index, queries, 5)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "Python" not in plan and "NestedLoop" not in plan


def test_empty(spark, setup, tmp_path):
    terms, queries, total, index = setup
    assert PI.search(index, queries.limit(0), 5).count() == 0
    none = PI.build(terms.limit(0), total, str(tmp_path / "none"), buckets=2, doc_buckets=2)
    assert PI.exists(spark, none.path)


def test_strata_need_no_shuffle(spark):
    docs = search_queries.whole_documents(spark, "/root/testdata/sf0.001")
    assert docs.where("chunk_index <> 0 or chunk_index is null").count() == 0
    rows = PI.with_stratum(chunking.sparse_terms(docs, list(PI.POINT)))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the texts


def test_blocks_are_cut_where_a_key_changes():
    names = ["term", "stratum", "block", "tf", "document_id", "chunk_index"]
    rows = [("a", 1, 7, 3, 10, 0), ("a", 1, 7, 2, 11, 1), ("a", 1, 8, 2, 12, 0), ("a", 2, 8, 9, 13, 0), ("b", 2, 8, 1, 14, 0)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    blocks = [r for out in PI._gathered([batch[:0], batch]) for r in out.to_pylist()]
    assert [(r["term"], r["stratum"], r["block"], r["max_tf"], r["n"], [e["document_id"] for e in r["entries"]]) for r in blocks] == [
        ("a", 1, 7, 3, 2, [10, 11]), ("a", 1, 8, 2, 1, [12]), ("a", 2, 8, 9, 1, [13]), ("b", 2, 8, 1, 1, [14])
    ]

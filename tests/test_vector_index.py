"""The stored vector index against brute force."""

import numpy as np
import pytest
from foliant.functions import vectors
from foliant.operators import retrieval
from foliant.sources import vector_index as VI


def rows_of(matrix, per_document=3):
    return [(int(i) // per_document + 1, int(i) % per_document, v.tolist() if v is not None else None) for i, v in enumerate(matrix)]


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    points = np.concatenate([c + 0.25 * rng.normal(size=(90, 24)) for c in centres] + [np.repeat(centres[:1], 700, axis=0), np.zeros((3, 24))])
    rng.shuffle(points)
    matrix = [*points, None]
    chunks = spark.createDataFrame(rows_of(matrix), "document_id long, chunk_index long, vector array<double>").cache()
    asked = [*(centres[rng.integers(12, size=40)] + 0.3 * rng.normal(size=(40, 24))), np.zeros(24)]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, None)], "query_id long, vector array<double>").cache()
    path = str(tmp_path_factory.mktemp("index"))
    VI.BLOCK_ROWS, old = 64, VI.BLOCK_ROWS
    index = VI.build(chunks, path)
    VI.BLOCK_ROWS = old
    yield chunks, queries, index, np.array(asked)
    chunks.unpersist(), queries.unpersist()


def table(df):
    return sorted((r.query_id, r["rank"], r.document_id, r.chunk_index, round(r.score, 9)) for r in df.collect())


def test_every_row_is_indexed_once(setup, spark):
    chunks, _, index, _ = setup
    assert VI.exists(spark, index.path) and VI.opened(spark, index.path).dim == 24
    assert index.cells.agg({"n": "sum"}).first()[0] == chunks.count() - 1 == index.codes.count()
    assert index.blocks.groupBy().agg({"n": "max"}).first()[0] <= 64
    ids = [tuple(r) for b in index.blocks.select("body").collect() for r in zip(*(VI._read(bytes(b.body)).column(c).to_pylist() for c in VI.POINT))]
    assert len(ids) == len(set(ids)) == chunks.count() - 1


@pytest.mark.parametrize("n", [1, 7, 300])
def test_exact_search_equals_the_scan(setup, n):
    chunks, queries, index, _ = setup
    assert table(VI.search(index, queries, n)) == table(retrieval.nearest(chunks, queries, n))


def test_queries_too_many_to_broadcast(setup, monkeypatch):
    chunks, queries, index, _ = setup
    monkeypatch.setattr(VI, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(VI, "PACK_ROWS", 3)
    assert table(VI.search(index, queries, 5)) == table(retrieval.nearest(chunks, queries, 5))


def test_bounds_skip_cells(setup):
    _, queries, index, asked = setup
    cells = VI._Cells.of(index)
    bar = VI.F.lit(0.9)
    first = VI._probed(queries.where("vector is not null").withColumn("bar", bar), cells, 5, 1, False).count()
    rest = VI._probed(queries.where("vector is not null").withColumn("bar", bar), cells, 5, 1, True).count()
    assert first + rest < len(asked) * len(cells.ids) / 2


def test_probes_read_their_partitions(setup):
    chunks, queries, index, _ = setup
    found = VI.search(index, queries, 5, probes=3)
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    exact = retrieval.nearest(chunks, queries, 5)
    assert retrieval.recall(found, exact).first().recall > 0.9


def test_signs(setup):
    chunks, queries, index, asked = setup
    rows = [(r.document_id, r.chunk_index, np.array(r.vector)) for r in chunks.collect() if r.vector is not None]
    got = {}
    for r in VI.sign_candidates(index, queries, 20, block=7).collect():
        got.setdefault(r.query_id, set()).add((r.document_id, r.chunk_index, r.distance))
    for i, q in enumerate(asked):
        distance = [int(((v > 0) != (q > 0)).sum()) for *_, v in rows]
        limit = sorted(distance)[19]
        assert got[i] == {(d, c, x) for (d, c, _), x in zip(rows, distance) if x <= limit}
    plan = VI.search_signs(index, chunks, queries, 5)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_many_queries_read_points_by_part(setup, monkeypatch):
    """Many queries through cells that leave out little, and many by signs, give the results of few."""
    chunks, queries, index, _ = setup
    rows = lambda df: sorted((r.query_id, r.rank, r.document_id, r.chunk_index, round(r.score, 9)) for r in df.collect())
    exact, signs = rows(VI.search(index, queries, 5)), rows(VI.search_signs(index, chunks, queries, 5))
    monkeypatch.setattr(VI, "MANY_QUERIES", 3, raising=False)
    monkeypatch.setattr(vectors, "HELD_BYTES", 8 * index.dim * 60)
    monkeypatch.setattr(VI, "_reads_most", lambda *args: True, raising=False)
    assert rows(VI.search(index, queries, 5)) == exact
    plan = VI.search(index, queries, 5, probes=3)._jdf.queryExecution().toString()
    assert "asked" not in plan  # no query is copied once a cell
    assert rows(VI.search_signs(index, chunks, queries, 5)) == signs


def test_wide_signs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=130)
    code = spark.createDataFrame([(v.tolist(),)], "vector array<double>").select(VI.sign_words(VI.F.col("vector"), 130)).first()[0]
    assert [c & (1 << 64) - 1 for c in code] == [sum(1 << i for i, x in enumerate(v[a : a + 64]) if x > 0) for a in (0, 64, 128)]


def test_empty_and_odd(spark, tmp_path):
    none = spark.createDataFrame([], "document_id long, chunk_index long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    index = VI.build(none, str(tmp_path / "a"))
    assert VI.search(index, queries, 3).count() == 0 and VI.search(index, queries, 3, probes=2).count() == 0
    mixed = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0])], "document_id long, chunk_index long, vector array<double>")
    with pytest.raises(Exception, match="dimensions differ"):
        VI.build(mixed, str(tmp_path / "b"))

from pyspark.sql import functions as F

from foliant.operators import scan as S

P = S.ScanParams(top_k=100, add=0.80, remove=0.35, percentile=10, min_chunks=2)
SCORES = "entity_type string, entity_id long, document_id long, score double, best_passage string, title string, supporting long, payload_name string"


def scores(spark, rows, kind="tag"):
    return spark.createDataFrame([(kind, e, d, s, "p", "t", n, name) for e, d, s, n, name in rows], SCORES)


def assigned(spark, rows, kind="tag"):
    return spark.createDataFrame([(kind, e, d) for e, d in rows], "entity_type string, entity_id long, document_id long")


def percentiles(spark, rows, kind="tag"):
    return spark.createDataFrame(
        [(kind, e, d, p) for e, d, p in rows], "entity_type string, entity_id long, document_id long, percentile double"
    )


def result(df):
    return {(r.entity_id, r.document_id): (r.action, r.reason, round(r.distance, 6)) for r in df.collect()}


def test_percentiles_are_distinct_on_ties(spark):
    rows = [("tag", 1, d, 0.0 if d < 4 else d / 100) for d in range(1, 12)] + [("tag", 2, d, 0.5) for d in range(9)]
    got = S.cohort_percentiles(spark.createDataFrame(rows, "entity_type string, entity_id long, document_id long, score double"))
    placed = {r.document_id: r.percentile for r in got.collect()}
    assert placed == {d: 10.0 * (d - 1) for d in range(1, 12)}  # the small cohort is left out


def test_multi_valued_rules(spark):
    s = scores(
        spark,
        [(1, 10, 0.85, 2, ""), (1, 11, 0.85, 1, ""), (1, 12, 0.79, 9, ""), (1, 20, 0.34, 0, ""), (1, 21, 0.50, 0, ""), (1, 23, 0.90, 3, "")],
    )
    a = assigned(spark, [(1, 20), (1, 21), (1, 22), (1, 23)])
    p = percentiles(spark, [(1, 21, 50.0), (1, 22, 0.0), (1, 23, 5.0)])
    assert result(S.classify_multi(s, a, p, P)) == {
        (1, 10): ("add", None, 0.05),
        (1, 20): ("remove", "low_score", 0.01),
        (1, 22): ("remove", "absent", 0.35),
        (1, 23): ("remove", "cohort_bottom", -0.55),
    }


def test_absence_needs_depth(spark):
    s = scores(spark, [(1, 99, 0.5, 0, "")])
    a = assigned(spark, [(1, d) for d in range(1, 41)])
    shallow = S.classify_multi(s, a, percentiles(spark, [(1, 5, 3.0)]), P)
    assert result(shallow) == {(1, 5): ("remove", "cohort_bottom", 0.35)}


def test_single_valued_rules(spark):
    kind = "correspondent"
    s = scores(
        spark,
        [
            (1, 10, 0.85, 2, ""),  # no incumbent: add
            (1, 11, 0.95, 2, "other name"),  # a payload name blocks the add
            (1, 12, 0.30, 0, ""), (2, 12, 0.90, 3, ""),  # incumbent 1 loses to 2
            (1, 13, 0.30, 0, ""), (2, 13, 0.60, 3, ""),  # nobody clears the bar
            (2, 14, 0.90, 2, ""), (3, 14, 0.90, 2, ""),  # tie between competitors: the lower id
        ],
        kind,
    )
    a = assigned(spark, [(1, 12), (1, 13), (1, 14)], kind)
    got = S.classify_single(s, a, percentiles(spark, [(9, 9, 9.0)], kind), P)
    assert result(got) == {
        (1, 10): ("add", None, 0.05),
        (1, 12): ("replace", "low_score", 0.6),
        (1, 13): ("review", "low_score", 0.05),
        (1, 14): ("replace", "absent", 0.9),
    }
    assert {r.document_id: r.replacement_entity_id for r in got.where("action = 'replace'").collect()} == {12: 2, 14: 2}


def test_dismissal_kinds_and_expiry(spark):
    d = spark.sql(
        """SELECT 'tag' entity_type, CAST(1 AS BIGINT) entity_id, CAST(id AS BIGINT) document_id, action, CAST(at AS TIMESTAMP) dismissed_at
        FROM VALUES (1, 'replace', '2024-01-01'), (2, 'add', '2024-01-31'), (3, 'review', NULL), (4, 'dedup', NULL) t(id, action, at)"""
    )
    as_of = F.lit("2024-02-10").cast("timestamp")
    keep = lambda days: {(r.document_id, r.kind) for r in S.active_dismissals(d, as_of, days).collect()}
    assert keep(0) == {(1, "keep_incumbent"), (2, "add"), (3, "keep_incumbent")}
    assert keep(10) == {(2, "add"), (3, "keep_incumbent")}  # exactly at the cutoff still counts
    assert keep(9) == {(3, "keep_incumbent")}


def test_cap_counts_documents(spark):
    rows = [("tag", e, d, "add", x) for e, d, x in [(1, 1, 0.9), (2, 1, 0.1), (1, 2, 0.5), (1, 3, 0.5)]]
    c = spark.createDataFrame(rows, "entity_type string, entity_id long, document_id long, action string, distance double")
    assert sorted((r.document_id, r.entity_id) for r in S.cap_documents(c, 2).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert S.capped_count(c, 2).first().capped == 1

"""Mismatch-scan queries. Thresholds are calibrated to the mean-vector entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import scan as S
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query

NOW = "2024-06-01 00:00:00"
WIDE = S.ScanParams(top_k=500, add=0.60, remove=0.50, percentile=10, min_chunks=1, max_suggestions=50)
NARROW = S.ScanParams(top_k=200, add=0.60, remove=0.50, percentile=10, min_chunks=1, max_suggestions=50)


def chain(p: S.ScanParams) -> dict[str, str]:
    """The scan as SQL, one CTE per stage."""
    absent = f"{p.top_k} >= 3*greatest(coalesce(n_assigned,0),1)"
    reason = f"""CASE WHEN NOT has THEN NULL WHEN score < {p.remove} THEN 'low_score'
        WHEN score IS NULL AND {absent} THEN 'absent' WHEN percentile <= {p.percentile} THEN 'cohort_bottom' END"""
    return dict(
        ehits=f"""SELECT * FROM (SELECT *, (1+cos)/2 AS score,
            row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM (
            SELECT entity_type, entity_id, c.document_id, c.chunk_index, c.passage, c.title, c.correspondent,
              round(list_cosine_similarity(e.vector, c.vector), 12) AS cos FROM entity_vec e, chunk_vec c)) WHERE rank <= {p.top_k}""",
        escores=f"""SELECT entity_type, entity_id, document_id, max(score) AS score, min_by(substring(passage,1,300), rank) AS best_passage,
            min_by(title, rank) AS title, count(*) FILTER (WHERE score >= {p.add}) AS supporting,
            CASE WHEN entity_type='correspondent' THEN max_by(correspondent, rank) ELSE '' END AS payload_name
            FROM ehits GROUP BY entity_type, entity_id, document_id""",
        assigned="""SELECT entity_type, entity_id, document_id FROM (
            SELECT DISTINCT 'tag' AS entity_type, unnest(tag_ids) AS entity_id, document_id FROM archive
            UNION ALL SELECT 'correspondent', correspondent_id, document_id FROM archive WHERE correspondent_id IS NOT NULL)
            WHERE (entity_type, entity_id) IN (SELECT (entity_type, entity_id) FROM entity_vec)""",
        sizes="SELECT entity_type, entity_id, count(*) AS n_assigned FROM assigned GROUP BY 1,2",
        reached="""SELECT entity_type, entity_id, document_id, (1+max(cos))/2 AS score FROM (
            SELECT e.entity_type, e.entity_id, c.document_id, round(list_cosine_similarity(e.vector, c.vector), 12) AS cos
            FROM entity_vec e JOIN chunk_vec c ON
              (e.entity_type='tag' AND list_contains(c.tag_ids, e.entity_id)) OR (e.entity_type='correspondent' AND c.correspondent=e.name))
            GROUP BY 1,2,3""",
        cohort="SELECT a.*, coalesce(score, 0.0) AS score FROM assigned a LEFT JOIN reached USING (entity_type, entity_id, document_id)",
        percentiles="""SELECT *, 100.0::DOUBLE*(row_number() OVER w - 1)/(n-1) AS percentile FROM (
            SELECT *, count(*) OVER (PARTITION BY entity_type, entity_id) AS n FROM cohort) WHERE n >= 10
            WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY round(score,12), document_id)""",
        joined=f"""SELECT *, {reason} AS reason FROM (
            SELECT coalesce(s.entity_type, a.entity_type) AS entity_type, coalesce(s.entity_id, a.entity_id) AS entity_id,
              coalesce(s.document_id, a.document_id) AS document_id, s.score, s.best_passage, s.title, s.supporting,
              a.document_id IS NOT NULL AS has FROM escores s FULL JOIN assigned a
              ON s.entity_type=a.entity_type AND s.entity_id=a.entity_id AND s.document_id=a.document_id) j
            LEFT JOIN (SELECT entity_type, entity_id, document_id, percentile FROM percentiles) USING (entity_type, entity_id, document_id)
            LEFT JOIN sizes USING (entity_type, entity_id)""",
        multi=f"""SELECT entity_type, entity_id, document_id, CASE WHEN has THEN 'remove' ELSE 'add' END AS action, coalesce(score,0) AS score,
            CASE WHEN has THEN percentile END AS percentile,
            CASE WHEN has THEN {p.remove}-coalesce(score,0) ELSE score-{p.add} END AS distance, reason,
            NULL::BIGINT AS other_id, NULL::DOUBLE AS other_score, best_passage FROM joined
            WHERE entity_type='tag' AND (reason IS NOT NULL OR (NOT has AND score >= {p.add} AND supporting >= {p.min_chunks}))""",
        incumbent="""SELECT document_id, coalesce(max(held), -1) AS incumbent FROM (
            SELECT document_id, entity_id AS held FROM assigned WHERE entity_type='correspondent'
            UNION ALL SELECT document_id, NULL FROM escores WHERE entity_type='correspondent' AND payload_name<>'') GROUP BY 1""",
        ranked_other="""SELECT a.entity_id, a.document_id, o.entity_id AS other_id, o.score AS other_score,
            row_number() OVER (PARTITION BY a.entity_id, a.document_id ORDER BY round(o.score,12) DESC, o.entity_id) AS r
            FROM assigned a JOIN escores o ON o.entity_type='correspondent' AND a.entity_type='correspondent'
              AND o.document_id=a.document_id AND o.entity_id<>a.entity_id""",
        single=f"""SELECT 'correspondent' AS entity_type, entity_id, document_id,
            CASE WHEN NOT has THEN 'add' WHEN other_score >= {p.add} AND other_score > coalesce(score,0) THEN 'replace' ELSE 'review' END AS action,
            coalesce(score,0) AS score, CASE WHEN has THEN percentile END AS percentile,
            CASE WHEN NOT has THEN score-{p.add} WHEN other_score >= {p.add} AND other_score > coalesce(score,0) THEN other_score-coalesce(score,0)
              ELSE {p.remove}-coalesce(score,0) END AS distance, reason,
            CASE WHEN has AND other_score >= {p.add} AND other_score > coalesce(score,0) THEN other_id END AS other_id,
            CASE WHEN has AND other_score >= {p.add} AND other_score > coalesce(score,0) THEN other_score END AS other_score, best_passage
            FROM joined LEFT JOIN (SELECT * FROM ranked_other WHERE r=1) USING (entity_id, document_id) LEFT JOIN incumbent USING (document_id)
            WHERE entity_type='correspondent' AND (reason IS NOT NULL OR (NOT has AND incumbent IS NULL AND score >= {p.add} AND supporting >= {p.min_chunks}))""",
        inforce="""SELECT DISTINCT entity_type, entity_id, document_id,
            CASE WHEN action IN ('replace','review') THEN 'keep' ELSE action END AS kind FROM dismissal
            WHERE action<>'dedup' AND NOT coalesce(dismissed_at < TIMESTAMP '2024-06-01' - INTERVAL 140 DAY, false)""",
        candidates="""SELECT a.*, e.name AS entity_name, o.name AS other_name, coalesce(d.title,'') AS document_title,
            CASE WHEN EXISTS (SELECT 1 FROM inforce f WHERE f.entity_type=a.entity_type AND f.entity_id=a.entity_id AND f.document_id=a.document_id
                AND f.kind=CASE WHEN a.action IN ('replace','review') THEN 'keep' ELSE a.action END) THEN 'dismissed'
              WHEN a.document_id IN (SELECT document_id FROM pending_document) THEN 'pending' END AS skipped
            FROM (SELECT * FROM multi UNION ALL SELECT * FROM single) a
            JOIN entity_vec e ON e.entity_type=a.entity_type AND e.entity_id=a.entity_id
            LEFT JOIN entity_vec o ON o.entity_type=a.entity_type AND o.entity_id=a.other_id
            LEFT JOIN archive d ON d.document_id=a.document_id""",
        open_candidates="SELECT * FROM candidates WHERE skipped IS NULL",
        chosen=f"""SELECT document_id FROM (SELECT document_id, max(round(distance,12)) AS best FROM open_candidates GROUP BY 1)
            ORDER BY best DESC, document_id LIMIT {p.max_suggestions}""",
        capped="SELECT * FROM open_candidates WHERE document_id IN (SELECT document_id FROM chosen)",
        base_tags="""SELECT document_id, list(name ORDER BY pos) AS base FROM (
            SELECT document_id, unnest(tag_ids) AS t, generate_subscripts(tag_ids,1) AS pos FROM current_document)
            JOIN scan_name s ON s.entity_type='tag' AND s.entity_id=t GROUP BY document_id""",
        valid="""SELECT c.*, d.title, coalesce(b.base, []) AS base, d.correspondent_id,
            row_number() OVER (PARTITION BY c.document_id ORDER BY round(distance,12) DESC, c.entity_type, c.entity_id, action) AS pos
            FROM capped c JOIN current_document d USING (document_id) LEFT JOIN base_tags b USING (document_id)
            WHERE CASE WHEN c.entity_type='tag' AND action='add' THEN NOT list_contains(coalesce(b.base,[]), entity_name)
              WHEN c.entity_type='tag' THEN list_contains(coalesce(b.base,[]), entity_name)
              WHEN action='add' THEN d.correspondent_id IS NULL ELSE coalesce(d.correspondent_id=c.entity_id, false) END""",
        applied="""SELECT document_id, any_value(title) AS title, any_value(base) AS base, any_value(correspondent_id) AS correspondent_id,
            coalesce(list(entity_name ORDER BY pos) FILTER (WHERE entity_type='tag' AND action='add'), []) AS adds,
            coalesce(list(entity_name) FILTER (WHERE entity_type='tag' AND action='remove'), []) AS removes,
            max_by(CASE WHEN action='add' THEN entity_name ELSE other_name END, pos) FILTER (WHERE entity_type='correspondent' AND action IN ('add','replace')) AS new_corr,
            array_to_string(list(action || ':' || entity_name ORDER BY pos), ',') AS actions FROM valid GROUP BY document_id""",
    )


def sql(body: str, p: S.ScanParams = WIDE) -> str:
    return with_(body, **chain(p))


class Stages:
    """The stages of one scan over the test tables."""

    def __init__(self, spark, sf, p: S.ScanParams = WIDE):
        self.p = p
        self.chunks = D.chunk_store(spark, sf)
        self.entities = D.entity_vec(spark, sf)
        self.docs = D.archive(spark, sf)
        self.spark, self.sf = spark, sf

    def scores(self):
        return S.scan_scores(S.scan_hits(self.chunks, self.entities, self.p.top_k), self.p.add)

    def assigned(self):
        return S.assignments(self.docs, self.entities)

    def cohort(self):
        return S.cohort_scores(self.chunks, self.entities, self.assigned())

    def percentiles(self):
        return S.cohort_percentiles(self.cohort())

    def dismissals(self):
        return S.active_dismissals(D.dismissal(self.spark, self.sf), D.ntz(NOW), 140)

    def candidates(self):
        pending = D.pending_document(self.spark, self.sf)
        return S.scan_candidates(self.chunks, self.entities, self.docs, self.dismissals(), pending, self.p)

    def applied(self, candidates=None):
        found = S.kept(candidates if candidates is not None else self.candidates())
        current, names = D.current_document(self.spark, self.sf), D.scan_name(self.spark, self.sf)
        return S.apply_actions(S.cap_documents(found, self.p.max_suggestions), current, names)


@query(
    "scan_scores",
    sql("SELECT entity_type, entity_id, document_id, round(score,6) AS score, best_passage, title, supporting, payload_name FROM escores"),
)
def scan_scores(spark, sf):
    return Stages(spark, sf).scores().withColumn("score", F.round("score", 6))


@query("assignments", sql("SELECT * FROM assigned"))
def assignments(spark, sf):
    return Stages(spark, sf).assigned()


@query("cohort_scores", sql("SELECT entity_type, entity_id, document_id, round(score,6) AS score FROM cohort"))
def cohort_scores(spark, sf):
    return Stages(spark, sf).cohort().withColumn("score", F.round("score", 6))


@query(
    "cohort_percentiles",
    sql("SELECT entity_type, entity_id, document_id, round(percentile,6) AS percentile FROM percentiles"),
)
def cohort_percentiles(spark, sf):
    return Stages(spark, sf).percentiles().select(*S.PAIR, F.round("percentile", 6).alias("percentile"))


ACTION_SQL = """SELECT entity_type, entity_id, document_id, action, round(score,6) AS score, round(percentile,6) AS cohort_percentile,
  round(distance,6) AS distance, reason, other_id AS replacement_entity_id, round(other_score,6) AS replacement_score FROM """


def _rounded(df):
    for c in ("score", "cohort_percentile", "distance", "replacement_score"):
        df = df.withColumn(c, F.round(c, 6))
    return df.drop("best_passage", "title")


def _classify(spark, sf, p, kind, rule):
    s = Stages(spark, sf, p)
    of = lambda df: df.where(F.col("entity_type") == kind)
    return _rounded(rule(of(s.scores()), of(s.assigned()), of(s.percentiles()), p))


@query("classify_multi", sql(ACTION_SQL + "multi"))
def classify_multi(spark, sf):
    return _classify(spark, sf, WIDE, "tag", S.classify_multi)


@query("classify_multi_narrow", sql(ACTION_SQL + "multi", NARROW))
def classify_multi_narrow(spark, sf):
    return _classify(spark, sf, NARROW, "tag", S.classify_multi)


@query("classify_single", sql(ACTION_SQL + "single"))
def classify_single(spark, sf):
    return _classify(spark, sf, WIDE, "correspondent", S.classify_single)


@query("classify_single_narrow", sql(ACTION_SQL + "single", NARROW))
def classify_single_narrow(spark, sf):
    return _classify(spark, sf, NARROW, "correspondent", S.classify_single)


@query(
    "competitor_best",
    sql("SELECT entity_id, document_id, other_id, round(other_score,6) AS other_score FROM ranked_other WHERE r=1"),
)
def competitor_best(spark, sf):
    s = Stages(spark, sf)
    is_corr = F.col("entity_type") == "correspondent"
    best = S.competitor_best(s.scores().where(is_corr), s.assigned().where(is_corr))
    return best.select("entity_id", "document_id", "other_id", F.round("other_score", 6).alias("other_score"))


@query("incumbents", sql("SELECT document_id, incumbent FROM incumbent"))
def incumbents(spark, sf):
    s = Stages(spark, sf)
    is_corr = F.col("entity_type") == "correspondent"
    return S.incumbents(s.scores().where(is_corr), s.assigned().where(is_corr)).drop("entity_type")


@query("dismissal_filter", sql("SELECT entity_type, entity_id, document_id, replace(kind,'keep','keep_incumbent') AS kind FROM inforce"))
def dismissal_filter(spark, sf):
    return Stages(spark, sf).dismissals()


@query(
    "pending_filter",
    sql("SELECT entity_type, entity_id, document_id, action, skipped FROM candidates WHERE skipped IS NOT NULL"),
)
def pending_filter(spark, sf):
    return Stages(spark, sf).candidates().where(F.col("skipped").isNotNull()).select(*S.PAIR, "action", "skipped")


@query(
    "incremental_entities",
    with_(
        """SELECT entity_type, entity_id FROM entity_state WHERE last_scanned_at IS NULL OR description_updated_at > last_scanned_at
        OR (SELECT max(last_embedded_at) FROM tracking WHERE last_embedded_at < TIMESTAMP '2024-08-10') > last_scanned_at"""
    ),
)
def incremental_entities(spark, sf):
    tracked = D.tracking(spark, sf).where(F.col("last_embedded_at") < D.ntz("2024-08-10 00:00:00"))
    return S.needs_rescan(D.entity_state(spark, sf), tracked).select("entity_type", "entity_id")


@query(
    "scan_eligible",
    with_(
        """SELECT entity_type, entity_id FROM entity_state WHERE NOT excluded AND NOT (entity_type='tag' AND entity_id=6)
        AND embedding_stored AND vector IS NOT NULL"""
    ),
)
def scan_eligible(spark, sf):
    return S.eligible(D.entity_state(spark, sf), 6).select("entity_type", "entity_id")


@query(
    "scan_candidates",
    sql(
        """SELECT entity_type, entity_id, entity_name, document_id, document_title, action, round(score,4) AS score,
        round(percentile,1) AS cohort_percentile, round(distance,6) AS distance, reason, coalesce(best_passage,'') AS best_passage,
        other_name AS replacement_entity_name FROM open_candidates"""
    ),
)
def scan_candidates(spark, sf):
    found = S.kept(Stages(spark, sf).candidates())
    return found.select(
        *S.KEY, "entity_name", "document_id", "document_title", "action", "score", "cohort_percentile",
        F.round("distance", 6).alias("distance"), "reason", "best_passage", "replacement_entity_name",
    )


@query("scan_cap", sql("SELECT entity_type, entity_id, document_id, action, (SELECT greatest(count(DISTINCT document_id)-50,0) FROM open_candidates) AS capped FROM capped"))
def scan_cap(spark, sf):
    found = S.kept(Stages(spark, sf).candidates())
    return S.cap_documents(found, WIDE.max_suggestions).select(
        *S.PAIR, "action", S.capped_count(found, WIDE.max_suggestions).scalar().alias("capped")
    )


APPLIED = """SELECT document_id, title, array_to_string(base,',') AS base_tags,
  array_to_string(list_filter(list_concat(base, adds), lambda t: NOT list_contains(removes, t)), ',') AS tags,
  coalesce(new_corr, (SELECT name FROM entity_vec e WHERE e.entity_type='correspondent' AND e.entity_id=correspondent_id)) AS correspondent,
  actions FROM applied"""


def _actions(column):
    return F.array_join(F.transform(column, lambda a: F.concat(a["action"], F.lit(":"), a["entity_name"])), ",")


@query("scan_apply", sql(APPLIED))
def scan_apply(spark, sf):
    return Stages(spark, sf).applied().select(
        "document_id", "title", F.array_join("base_tags", ",").alias("base_tags"), F.array_join("tags", ",").alias("tags"),
        "correspondent", _actions("actions").alias("actions"),
    )


@query(
    "scan_suggestions",
    sql(f"SELECT document_id, 'pending' AS status, 'grooming' AS analysis_mode, title, tags, correspondent, actions AS evidence_actions, base_tags AS evidence_tags FROM ({APPLIED})"),
)
def scan_suggestions(spark, sf):
    built = S.build_suggestions(Stages(spark, sf).applied(), D.ntz(NOW), "local", "m1")
    return built.select(
        "document_id", "status", "analysis_mode", "title", F.array_join("tags", ",").alias("tags"), "correspondent",
        _actions("evidence.actions").alias("evidence_actions"), F.array_join("evidence.base_tags", ",").alias("evidence_tags"),
    )


@query(
    "scan_summary",
    sql(
        """SELECT count(*) FILTER (WHERE action='add') AS added, count(*) FILTER (WHERE action='remove') AS removed,
        count(*) FILTER (WHERE action='replace') AS replaced, count(*) FILTER (WHERE action='review') AS review,
        (SELECT count(*) FROM candidates WHERE skipped='dismissed') AS skipped_dismissed,
        (SELECT count(*) FROM candidates WHERE skipped='pending') AS skipped_pending,
        (SELECT greatest(count(DISTINCT document_id)-50,0) FROM open_candidates) AS capped FROM valid"""
    ),
)
def scan_summary(spark, sf):
    s = Stages(spark, sf)
    candidates = s.candidates()
    return S.scan_summary(candidates, s.applied(candidates), WIDE.max_suggestions)


@query(
    "stamp_scanned",
    with_(
        """SELECT entity_type, entity_id, CASE WHEN entity_type='tag' AND NOT excluded THEN '2024-06-01 00:00:00'
        ELSE strftime(last_scanned_at, '%Y-%m-%d %H:%M:%S') END AS last_scanned_at FROM entity_state"""
    ),
)
def stamp_scanned(spark, sf):
    stamped = S.stamp_scanned(D.entity_state(spark, sf), ["tag"], D.ntz(NOW))
    return stamped.select(*S.KEY, D.stamp("last_scanned_at").alias("last_scanned_at"))

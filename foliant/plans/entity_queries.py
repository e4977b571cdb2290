"""Entity curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.graph import connected_components as components
from foliant.functions.names import normalise_name, similar_names
from foliant.operators import entities as E
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query

NOW = "2024-06-01 00:00:00"


@query(
    "normalise_name",
    with_(
        """SELECT entity_id, lower(strip_accents(trim(name))) AS norm FROM entity_name
        UNION ALL SELECT -s_suppkey-1, lower(strip_accents(trim(s_name))) FROM supplier"""
    ),
)
def normalise(spark, sf):
    suppliers = D.table(spark, sf, "supplier").select((-F.col("s_suppkey") - 1).alias("entity_id"), F.col("s_name").alias("name"))
    names = D.entity_name(spark, sf).select("entity_id", "name").unionByName(suppliers)
    return names.select("entity_id", normalise_name("name").alias("norm"))


@query("name_similarity")
def similarity(spark, sf):
    names = D.entity_name(spark, sf).select("entity_type", normalise_name("name").alias("norm")).distinct()
    return similar_names(names, 0.85).select(
        "a", "b", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward")
    )


def named_and_vector(spark, sf):
    """Named and vector entities in one table."""
    return D.entity_name(spark, sf).unionByName(D.vector_entity(spark, sf).withColumn("entity_id", F.col("entity_id") + 1_000_000))


@query("dedup_pairs")
def dedup_pairs(spark, sf):
    return E.dedup_links(named_and_vector(spark, sf), D.dismissal(spark, sf))


@query(
    "dedup_pairs_embedding",
    with_(
        """SELECT a.entity_type, a.entity_id AS id_a, b.entity_id AS id_b, round(list_cosine_similarity(a.vector,b.vector),6) AS cosine
        FROM vector_entity a JOIN vector_entity b ON a.entity_type=b.entity_type AND a.entity_id<b.entity_id
        WHERE list_cosine_similarity(a.vector,b.vector) >= 0.4"""
    ),
)
def dedup_pairs_embedding(spark, sf):
    return E.embedding_pairs(D.vector_entity(spark, sf), 0.4).withColumn("cosine", F.round("cosine", 6))


@query(
    "dismissed_pairs",
    with_(
        """SELECT DISTINCT entity_type, least(entity_id, other_entity_id) AS id_a, greatest(entity_id, other_entity_id) AS id_b
        FROM dismissal WHERE action='dedup' AND other_entity_id IS NOT NULL"""
    ),
)
def dismissed_pairs(spark, sf):
    return E.dismissed_pairs(D.dismissal(spark, sf))


@query(
    "dismiss_pair",
    with_(
        """SELECT entity_type, a AS entity_id, 0::BIGINT AS document_id, 'dedup' AS action, b AS other_entity_id FROM (
        SELECT entity_type, entity_id AS a, other_entity_id AS b FROM dismissal WHERE other_entity_id IS NOT NULL
        UNION ALL SELECT entity_type, other_entity_id, entity_id FROM dismissal WHERE other_entity_id IS NOT NULL)"""
    ),
)
def dismiss_pair(spark, sf):
    chosen = D.dismissal(spark, sf).where(F.col("other_entity_id").isNotNull())
    return E.dismiss(chosen, D.ntz(NOW)).drop("dismissed_at")


COMPONENTS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a, b FROM ({edges}) UNION SELECT DISTINCT b, a FROM ({edges})),
n AS MATERIALIZED (SELECT DISTINCT a AS id FROM e),
step AS (SELECT id, id AS component, 0 AS i FROM n
  UNION ALL
  SELECT s.id, least(s.component, coalesce(m.low, s.component)), s.i+1
  FROM step s LEFT JOIN (SELECT e.a AS id, min(t.component) AS low FROM e JOIN step t ON t.id=e.b GROUP BY e.a) m ON m.id=s.id
  WHERE s.i < 40)
SELECT id, component FROM step WHERE i=40"""


@query(
    "connected_components",
    COMPONENTS.format(edges="SELECT o_custkey AS a, floor(o_custkey*0.5 + o_orderkey%3)::BIGINT AS b FROM orders WHERE o_orderstatus='P'"),
)
def connected(spark, sf):
    return components(D.similarity_link(spark, sf))


CLUSTER_SQL = """
WITH RECURSIVE {ctes},
pairs AS MATERIALIZED (SELECT a.entity_type, a.entity_id AS id_a, b.entity_id AS id_b, list_cosine_similarity(a.vector,b.vector) AS c
  FROM vector_entity a JOIN vector_entity b ON a.entity_type=b.entity_type AND a.entity_id<b.entity_id
  WHERE list_cosine_similarity(a.vector,b.vector) >= 0.4),
e AS MATERIALIZED (SELECT entity_type, id_a AS a, id_b AS b FROM pairs UNION SELECT entity_type, id_b, id_a FROM pairs),
step AS (SELECT DISTINCT entity_type, a AS id, a AS component, 0 AS i FROM e
  UNION ALL
  SELECT s.entity_type, s.id, least(s.component, coalesce(m.low, s.component)), s.i+1
  FROM step s LEFT JOIN (SELECT e.entity_type, e.a AS id, min(t.component) AS low FROM e JOIN step t ON t.id=e.b AND t.entity_type=e.entity_type GROUP BY 1,2) m
    ON m.id=s.id AND m.entity_type=s.entity_type WHERE s.i < 40),
c AS (SELECT entity_type, id, component FROM step WHERE i=40)
SELECT c.entity_type, component AS cluster_id, c.id AS entity_id, v.name, v.description IS NOT NULL AS has_description, v.embedding_stored,
  row_number() OVER (PARTITION BY c.entity_type, component ORDER BY (v.description IS NOT NULL)::INT + v.embedding_stored::INT DESC,
    v.embedding_stored DESC, c.id) AS position,
  'embedding' AS signal, round(f.best, 3) AS similarity
FROM c JOIN vector_entity v ON v.entity_id=c.id AND v.entity_type=c.entity_type
JOIN (SELECT pairs.entity_type, c.component AS comp, max(pairs.c) AS best FROM pairs JOIN c ON c.id=id_a AND c.entity_type=pairs.entity_type GROUP BY 1,2) f
  ON f.comp=component AND f.entity_type=c.entity_type"""


def _recursive(template: str, *needed: str) -> str:
    """Fill {ctes} of a recursive query with the named derived tables."""
    prefix = with_("SELECT " + ", ".join(needed))
    return template.replace("{ctes}", prefix[len("WITH ") : prefix.rindex("\nSELECT")])


@query("dedup_clusters", _recursive(CLUSTER_SQL, "vector_entity"))
def dedup_clusters(spark, sf):
    entities = D.vector_entity(spark, sf)
    pairs = E.embedding_pairs(entities, 0.4).select(
        "entity_type", "id_a", "id_b", F.lit("embedding").alias("signal"), F.round("cosine", 3).alias("similarity")
    )
    return E.dedup_clusters(pairs, entities)


@query("dedup_clusters_full")
def dedup_clusters_full(spark, sf):
    entities = named_and_vector(spark, sf)
    return E.dedup_clusters(E.cluster_links(entities, D.dismissal(spark, sf)), entities)


# --- merge: the toxic and blank tags go to quality, every second source to the first one -----

MERGE_TAG = "SELECT * FROM (VALUES (102::BIGINT, 101::BIGINT), (103, 101)) m(remove_id, keep_id)"
MERGE_CORR = """
SELECT entity_id AS remove_id, (SELECT min(entity_id) FROM entity WHERE entity_type='correspondent') AS keep_id FROM entity
WHERE entity_type='correspondent' AND entity_id%2=0"""


def tag_mapping(spark, sf):
    tags = D.entity(spark, sf).where((F.col("entity_type") == "tag") & (F.col("entity_id") > D.QUALITY))
    tags_kept = D.entity(spark, sf).where(F.col("name") == "quality").agg(F.min("entity_id"))
    return tags.select(F.col("entity_id").alias("remove_id"), tags_kept.scalar().alias("keep_id"))


def source_mapping(spark, sf):
    c = D.entity(spark, sf).where(F.col("entity_type") == "correspondent")
    return c.where(F.col("entity_id") % 2 == 0).select(
        F.col("entity_id").alias("remove_id"), c.agg(F.min("entity_id")).scalar().alias("keep_id")
    )


@query(
    "merge_entities_tags",
    with_(
        """SELECT document_id, array_to_string(list_filter(moved, lambda x, i: NOT list_contains(moved[1:i-1], x)), ',') AS tag_ids FROM (
        SELECT document_id, list_transform(tag_ids, lambda t: CASE WHEN t IN (102,103) THEN 101 ELSE t END) AS moved FROM document)"""
    ),
)
def merge_entities_tags(spark, sf):
    docs, _, _ = E.merge_entities(D.document(spark, sf), D.entity(spark, sf), tag_mapping(spark, sf), "tag", "ann", D.ntz(NOW))
    return docs.select("document_id", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tag_ids"))


@query(
    "merge_entities",
    with_(
        """SELECT d.document_id, d.title AS document_title, 'correspondent' AS field_name, o.name AS previous_value, k.name AS new_value,
        'user:ann' AS change_source, 'entity_merge' AS action_type
        FROM document d JOIN mapping ON remove_id=d.correspondent_id
        JOIN entity o ON o.entity_type='correspondent' AND o.entity_id=remove_id JOIN entity k ON k.entity_type='correspondent' AND k.entity_id=keep_id""",
        mapping=MERGE_CORR,
    ),
)
def merge_entities(spark, sf):
    _, audit, _ = E.merge_entities(
        D.document(spark, sf), D.entity(spark, sf), source_mapping(spark, sf), "correspondent", "ann", D.ntz(NOW)
    )
    return audit.drop("changed_at")


@query(
    "merge_counts",
    with_(
        """SELECT (SELECT count(*) FROM document JOIN mapping ON remove_id=correspondent_id) AS documents_updated,
        (SELECT count(*) FROM mapping) AS entities_deleted""",
        mapping=MERGE_CORR,
    ),
)
def merge_counts(spark, sf):
    mapping = source_mapping(spark, sf)
    _, audit, _ = E.merge_entities(D.document(spark, sf), D.entity(spark, sf), mapping, "correspondent", "ann", D.ntz(NOW))
    return E.merge_counts(audit, mapping)


@query(
    "entity_sync",
    with_(
        """SELECT entity_type, entity_id, coalesce(s.name, t.name) AS name, coalesce(s.document_count,0) AS document_count, description,
        description_source, coalesce(excluded,false) OR (entity_type='tag' AND entity_id=5) AS excluded,
        entity_type='tag' AND entity_id=5 AS forced_excluded,
        coalesce(embedding_stored,false) AND NOT coalesce(s.name<>t.name,false) AS embedding_stored,
        strftime(description_updated_at, '%Y-%m-%d %H:%M:%S') AS description_updated_at,
        CASE WHEN s.name IS NULL THEN 'deleted' WHEN t.name IS NULL THEN 'added' WHEN s.name<>t.name THEN 'renamed' ELSE 'kept' END AS change
        FROM entity_source s FULL JOIN entity_state t USING (entity_type, entity_id)"""
    ),
)
def entity_sync(spark, sf):
    synced = E.sync_entities(D.entity_source(spark, sf), D.entity_state(spark, sf), 5)
    return synced.withColumn("description_updated_at", D.stamp("description_updated_at"))


@query(
    "entity_update",
    with_(
        """SELECT entity_type, entity_id, CASE WHEN edited THEN nullif(trim(nd),'') ELSE description END AS description,
        CASE WHEN edited THEN 'user' ELSE description_source END AS description_source,
        CASE WHEN edited THEN false ELSE embedding_stored END AS embedding_stored,
        coalesce(ne, excluded) AS excluded,
        CASE WHEN edited THEN '2024-06-01 00:00:00' ELSE strftime(description_updated_at, '%Y-%m-%d %H:%M:%S') END AS description_updated_at
        FROM (SELECT *, nd IS NOT NULL AND nd IS DISTINCT FROM description AS edited FROM entity_state
          LEFT JOIN (SELECT CASE WHEN c_custkey%3=0 THEN 'correspondent' ELSE 'tag' END AS entity_type, c_custkey+1 AS entity_id,
            CASE WHEN c_custkey%12=5 THEN '   ' WHEN c_custkey%12<8 THEN ' About ' || c_mktsegment END AS nd,
            CASE WHEN c_custkey%13=1 THEN c_custkey%2=0 END AS ne FROM customer WHERE c_nationkey<12) USING (entity_type, entity_id))"""
    ),
)
def entity_update(spark, sf):
    c = D.table(spark, sf, "customer").where(F.col("c_nationkey") < 12)
    k = F.col("c_custkey")
    updates = c.select(
        F.when(k % 3 == 0, "correspondent").otherwise("tag").alias("entity_type"),
        (k + 1).alias("entity_id"),
        F.when(k % 12 == 5, F.lit("   ")).when(k % 12 < 8, F.concat(F.lit(" About "), "c_mktsegment")).alias("new_description"),
        F.when(k % 13 == 1, k % 2 == 0).alias("new_excluded"),
    )
    out = E.update_entities(D.entity_state(spark, sf), updates, D.ntz(NOW))
    return out.select(
        "entity_type", "entity_id", "description", "description_source", "embedding_stored", "excluded",
        D.stamp("description_updated_at").alias("description_updated_at"),
    )


SAMPLES = """
SELECT entity_id, count(*) AS documents, array_to_string(list('- ' || title ORDER BY r), chr(10)) AS titles,
  coalesce(array_to_string(list(CASE WHEN r<=2 AND content<>'' THEN 'Excerpt from "' || title || '": ' || substring(content,1,300) END ORDER BY r), chr(10)||chr(10)), '') AS excerpts
FROM (SELECT correspondent_id AS entity_id, title, content, row_number() OVER (PARTITION BY correspondent_id ORDER BY created DESC, document_id) AS r
  FROM document WHERE correspondent_id IS NOT NULL) WHERE r<=5 GROUP BY entity_id"""


def samples(spark, sf):
    docs = D.document(spark, sf)
    uses = docs.where(F.col("correspondent_id").isNotNull()).select(
        F.lit("correspondent").alias("entity_type"), F.col("correspondent_id").alias("entity_id"), "document_id"
    )
    return E.description_samples(uses, docs)


@query("description_sample", with_("SELECT entity_id, documents, titles, excerpts FROM samples", samples=SAMPLES))
def description_sample(spark, sf):
    return samples(spark, sf).drop("entity_type")


class EchoModel:
    """Stand-in text model: fails on prompts of odd length."""

    name = "echo"

    def complete(self, prompts, max_tokens):
        return [None if len(p) % 2 else f' "{p[:40]}" ' for p in prompts]


_FIELDS = ("entity_type", "name", "name", "coalesce(documents, 0)", "coalesce(titles, '(no documents)')", "coalesce(excerpts, '')")
_WORDING = ["'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for part in E.DESCRIPTION_PROMPT.split("%s")]
_PROMPT_SQL = _WORDING[0] + "".join(f" || {field} || {part}" for field, part in zip(_FIELDS, _WORDING[1:]))


@query(
    "generate_descriptions",
    with_(
        rf"""SELECT entity_id, CASE WHEN ok THEN trim(regexp_replace(trim(' "' || substring(p,1,40) || '" '), '^"+|"+$', '', 'g')) ELSE '' END AS description,
          CASE WHEN ok THEN 'llm' ELSE 'user' END AS description_source, NOT ok AS embedding_stored, CASE WHEN NOT ok THEN 'no answer' END AS error
        FROM (SELECT *, length(p)%2=0 AS ok FROM (SELECT e.entity_id, {_PROMPT_SQL} AS p
          FROM (SELECT * FROM entity WHERE entity_type='correspondent') e LEFT JOIN samples USING (entity_id)))""",
        samples=SAMPLES,
    ),
)
def generate_descriptions(spark, sf):
    state = D.entity(spark, sf).where(F.col("entity_type") == "correspondent").select(
        "entity_type", "entity_id", "name", F.lit("").alias("description"), F.lit("user").alias("description_source"),
        F.lit(True).alias("embedding_stored"), D.ntz(NOW).alias("description_updated_at"),
    )
    prompts = E.description_prompts(E.pending_descriptions(state), samples(spark, sf))
    done = E.generate_descriptions(prompts, EchoModel, D.ntz(NOW))
    return done.select("entity_id", "description", "description_source", "embedding_stored", "error")


@query(
    "pending_descriptions",
    with_("SELECT entity_type, entity_id FROM entity_state WHERE entity_type='tag' AND coalesce(description,'')=''"),
)
def pending_descriptions(spark, sf):
    return E.pending_descriptions(D.entity_state(spark, sf), "tag").select("entity_type", "entity_id")


@query(
    "entity_refresh_needed",
    with_(
        """SELECT entity_type, entity_id FROM entity_state WHERE (coalesce(description,'')<>'' AND NOT embedding_stored)
        OR (vector IS NOT NULL AND embed_model IS DISTINCT FROM 'm1')"""
    ),
)
def entity_refresh_needed(spark, sf):
    return E.refresh_needed(D.entity_state(spark, sf), "m1").select("entity_type", "entity_id")



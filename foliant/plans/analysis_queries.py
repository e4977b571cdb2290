"""Metadata analysis queries: shortlists, prompts, parsing, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import analysis as A
from foliant.operators import retrieval
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.entity_queries import EchoModel
from foliant.plans.registry import query

NOW = "2024-06-01 00:00:00"

SIMILAR_CTES = dict(
    near="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM (
      SELECT q.document_id AS query_id, c.document_id, c.chunk_index, round(list_cosine_similarity(q.vector, c.vector), 12) AS cos
      FROM chunk_vec q, chunk_vec c WHERE q.chunk_index=0 AND NOT list_contains(c.tag_ids, 13))""",
    near_docs="""SELECT query_id, tags, correspondent, document_type, cf_batch FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (
        SELECT query_id, document_id, min(rank) AS rank, min_by(chunk_index, rank) AS chunk_index FROM near WHERE rank<=20 GROUP BY query_id, document_id))
      JOIN chunk_vec USING (document_id, chunk_index) WHERE n<=4""",
    similar_name="""SELECT DISTINCT query_id AS document_id, kind, name FROM (
      SELECT query_id, unnest(tags) AS name, 'tag' AS kind FROM near_docs UNION ALL SELECT query_id, correspondent, 'correspondent' FROM near_docs
      UNION ALL SELECT query_id, document_type, 'document_type' FROM near_docs UNION ALL SELECT query_id, cf_batch, 'field:batch' FROM near_docs)
      WHERE trim(name)<>''""",
    lists="""SELECT entity_type AS kind, list(name ORDER BY entity_id) AS names FROM scan_name GROUP BY entity_type""",
    known="""SELECT document_id, kind, list(name ORDER BY name) AS names FROM similar_name GROUP BY document_id, kind""",
    shortlist_base="""SELECT c.document_id, passage, c.tags, c.correspondent, c.document_type, c.cf_batch,
      {near}, {all}, array_to_string((SELECT names FROM known k WHERE k.document_id=c.document_id AND k.kind='field:batch'), ', ') AS fields
      FROM chunk_vec c WHERE c.chunk_index=0""".format(
        near=", ".join(f"coalesce((SELECT names FROM known k WHERE k.document_id=c.document_id AND k.kind='{k}'), []) AS n_{k}" for k in A.KINDS),
        all=", ".join(f"coalesce((SELECT names FROM lists WHERE kind='{k}'), []) AS a_{k}" for k in A.KINDS),
    ),
    shortlist="""SELECT *, passage<>'' AS near_used, {lists} FROM shortlist_base""".format(
        lists=", ".join(
            f"CASE WHEN passage='' THEN a_{k} ELSE list_concat(n_{k}, list_filter(a_{k}[1:6], lambda n: NOT list_contains(n_{k}, n))) END AS l_{k}"
            for k in A.KINDS
        )
    ),
)


def shortlist(spark, sf):
    chunks = D.chunk_vec(spark, sf)
    docs = chunks.where(F.col("chunk_index") == 0).select(
        "document_id", F.col("passage").alias("content"), F.filter("tags", lambda t: t != "tag13").alias("current_tags"),
        "correspondent", "document_type", "custom_fields", F.col("vector"),
    )
    queries = docs.select(F.col("document_id").alias("query_id"), "vector")
    similar = retrieval.similar_entities(chunks, queries, top_n=4, exclude_tag=13).withColumnRenamed("query_id", "document_id")
    return A.entity_shortlist(docs.drop("vector"), similar, D.scan_name(spark, sf), 6)


@query(
    "entity_shortlist",
    with_(
        """SELECT document_id, array_to_string(l_tag, ',') AS tags, array_to_string(l_correspondent, ',') AS correspondents,
        array_to_string(l_document_type, ',') AS document_types FROM shortlist""",
        **SIMILAR_CTES,
    ),
)
def entity_shortlist(spark, sf):
    rows = shortlist(spark, sf)
    return rows.select("document_id", *[F.array_join(f"{k}s_list", ",").alias(f"{k}s") for k in ("tag", "correspondent", "document_type")])


def _line_sql(label: str, expr: str) -> str:
    return f"'  {label}: ' || nullif(array_to_string({expr}, ', '), '')"


_LISTS = ", ".join(_line_sql(A.LABELS[k], f"l_{k}") for k in A.KINDS)
_FIELDS_SQL = "(SELECT '  Custom fields: ' || array_to_string(list(name || ' (' || coalesce(data_type,'') || ')' ORDER BY field_id), ', ') FROM custom_field)"


@query(
    "entity_context",
    with_(
        f"""SELECT document_id, md5(ctx) AS context_md5, length(ctx) AS chars FROM (SELECT document_id, concat_ws(chr(10)||chr(10),
        CASE WHEN near_used THEN 'Similar documents use the following:' || chr(10) || nullif(concat_ws(chr(10), {_LISTS}, '  batch: ' || nullif(fields,'')), '') END,
        'Available:' || chr(10) || CASE WHEN near_used THEN {_FIELDS_SQL} ELSE concat_ws(chr(10), {_LISTS}, {_FIELDS_SQL}) END,
        'Current metadata already on this document:' || chr(10) || concat_ws(chr(10),
          '  Tags: ' || coalesce(nullif(array_to_string(list_filter(tags, lambda t: t<>'tag13'), ', '),''),'none'),
          '  Correspondent: ' || coalesce(nullif(correspondent,''),'none'), '  Document type: ' || coalesce(nullif(document_type,''),'none'),
          CASE WHEN trim(cf_batch)<>'' THEN '  batch: ' || cf_batch END) || chr(10) || chr(10) || '{(A.KEEP_RULE + A.EXISTING_RULE + A.OMIT_RULE).replace("'", "''")}') AS ctx
        FROM shortlist)""",
        **SIMILAR_CTES,
    ),
)
def entity_context(spark, sf):
    rows = A.entity_context(shortlist(spark, sf), D.scan_name(spark, sf), D.custom_field(spark, sf), 13)
    return rows.select("document_id", F.md5("entity_context").alias("context_md5"), F.length("entity_context").cast("long").alias("chars"))


TEMPLATE_SQL = """CASE WHEN document_type_id=1 THEN 'Letter {content} end' WHEN document_id%3=0 THEN 'Find the title' ELSE 'Default: {content}' END"""


def _templates(docs):
    field = F.when(F.col("document_id") % 3 == 0, "title").otherwise("other")
    return docs.withColumn(
        "template",
        A.resolve_template(
            F.col("document_type_id"), {1: "Letter {content} end", 2: ""}, "Default: {content}", {"title": "Find the title", "other": ""}, field
        ),
    )


@query("resolve_template", with_(f"SELECT document_id, {TEMPLATE_SQL} AS template FROM document"))
def resolve_template(spark, sf):
    return _templates(D.document(spark, sf)).select("document_id", "template")


@query(
    "field_instructions",
    with_(
        """SELECT array_to_string(list('Instructions for ' || field || ': ' || description ORDER BY position), chr(10)) AS instructions FROM (
        SELECT s_suppkey AS position, CASE WHEN s_suppkey%4=0 THEN s_name WHEN s_suppkey%4=3 THEN NULL ELSE name END AS field, 'use ' || s_suppkey AS description
        FROM supplier LEFT JOIN custom_field ON s_suppkey%4 IN (1,2) AND field_id=s_suppkey%40 WHERE s_suppkey%5>0) WHERE field IS NOT NULL"""
    ),
)
def field_instructions(spark, sf):
    k = F.col("s_suppkey")
    described = D.table(spark, sf, "supplier").select(
        k.alias("position"),
        F.when(k % 4 == 0, F.col("s_name")).when(k % 4 == 3, F.concat(F.lit("cf:x"), k)).otherwise(F.concat(F.lit("cf:"), k % 40)).alias("key"),
        F.when(k % 5 > 0, F.concat(F.lit("use "), k)).otherwise("").alias("description"),
    )
    return A.field_instructions(described, D.custom_field(spark, sf))


_TAIL_SQL = (A.LANGUAGE_RULE % ("German", "German") + A.JSON_RULE).replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    "build_prompt",
    with_(
        f"""SELECT document_id, md5(p) AS prompt_md5, length(p) AS chars FROM (SELECT document_id, CASE WHEN contains(template, '{{content}}')
          THEN replace(template, '{{content}}', CASE WHEN block<>'' THEN block || chr(10) || chr(10) ELSE '' END || content)
          ELSE template || CASE WHEN block<>'' THEN chr(10) || chr(10) || block ELSE '' END || chr(10) || chr(10) || 'Document content:' || chr(10) || content || chr(10) END
          || '{_TAIL_SQL}' AS p FROM (
        SELECT document_id, content, {TEMPLATE_SQL} AS template, concat_ws(chr(10)||chr(10), CASE WHEN document_id%4>0 THEN title END,
          CASE WHEN document_id%5>0 THEN 'Instructions {{x}}' END) AS block FROM document))"""
    ),
)
def build_prompt(spark, sf):
    docs = _templates(D.document(spark, sf))
    prompt = A.build_prompt(
        F.col("template"), F.col("content"), F.when(F.col("document_id") % 4 > 0, F.col("title")).otherwise(""),
        F.when(F.col("document_id") % 5 > 0, "Instructions {x}").otherwise(""), "German",
    )
    return docs.select("document_id", prompt.alias("_p")).select("document_id", F.md5("_p").alias("prompt_md5"), F.length("_p").cast("long").alias("chars"))


_JSON_SQL = A.JSON_RULE.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    "llm_complete",
    with_(
        f"""SELECT document_id, CASE WHEN length(p)%2=0 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN length(p)%2=1 THEN 'no answer' END AS error
        FROM (SELECT document_id, CASE WHEN contains(template, '{{content}}') THEN replace(template, '{{content}}', content)
          ELSE template || chr(10) || chr(10) || 'Document content:' || chr(10) || content || chr(10) END || '{_JSON_SQL}' AS p
        FROM (SELECT document_id, content, {TEMPLATE_SQL} AS template FROM document))"""
    ),
)
def llm_complete(spark, sf):
    docs = _templates(D.document(spark, sf)).withColumn(
        "prompt", A.build_prompt(F.col("template"), F.col("content"), F.lit(""), F.lit(""))
    )
    made, failed = A.analyse(docs.select("document_id", "prompt"), EchoModel, "local", "echo", D.ntz(NOW))
    return made.select("document_id", "status", F.lit(None).cast("string").alias("error")).unionByName(
        failed.select("document_id", F.lit("failed").alias("status"), "error")
    )


def _responses(spark, sf):
    """Model answers in seven shapes, good and bad."""
    u, kind = F.col("user_id"), F.col("event_id") % 7
    body = F.concat(
        F.lit('{"title": "T'), u, F.lit('", "tags": ["a", "b'), u % 3, F.lit('"], "correspondent": "SRC'), u % 25,
        F.lit('", "document_type": "", "storage_path": null, "custom_fields": {"k": "'), u, F.lit('"}}'),
    )
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Here you go:\n```json\n"), body, F.lit("\n```\n")))
        .when(kind == 2, F.lit('x {"a": 1} y {"b": 2} z'))
        .when(kind == 3, F.concat(F.lit("no json for "), u))
        .when(kind == 4, F.lit("[1, 2]"))
        .when(kind == 5, F.concat(F.lit('{"title": "only '), u, F.lit('", "tags": []}')))
        .otherwise(F.concat(F.lit(" \n"), body, F.lit("\n ")))
    )
    return D.table(spark, sf, "events").select(F.col("event_id").alias("document_id"), raw.alias("response"))


PARSED = """
SELECT event_id AS document_id, CASE WHEN k IN (0,1,6) THEN 'T' || user_id WHEN k=5 THEN 'only ' || user_id END AS title,
  CASE WHEN k IN (0,1,6) THEN 'a,b' || (user_id%3) WHEN k=5 THEN '' END AS tags, CASE WHEN k IN (0,1,6) THEN 'SRC' || (user_id%25) END AS correspondent,
  CASE WHEN k IN (0,1,6) THEN '' END AS document_type, CASE WHEN k IN (0,1,6) THEN 'k=' || user_id END AS custom_fields
FROM (SELECT *, event_id%7 AS k FROM events)"""


def _pairs(column):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("parse_response", with_("SELECT * FROM answers", answers=PARSED))
def parse_response(spark, sf):
    parsed = _responses(spark, sf).withColumn("p", A.parse_response(F.col("response")))
    return parsed.select(
        "document_id", "p.title", F.array_join("p.tags", ",").alias("tags"), "p.correspondent", "p.document_type",
        _pairs("p.custom_fields").alias("custom_fields"),
    )


@query(
    "build_suggestion",
    with_(
        """SELECT document_id, 'pending' AS status, title, coalesce(tags,'') AS tags, correspondent, nullif(document_type,'') AS document_type,
        NULL::VARCHAR AS storage_path, coalesce(custom_fields,'') AS custom_fields FROM answers""",
        answers=PARSED,
    ),
)
def build_suggestion(spark, sf):
    parsed = _responses(spark, sf).withColumn("parsed", A.parse_response(F.col("response")))
    built = A.build_suggestion(parsed, "local", "echo", "ocr", D.ntz(NOW))
    return built.select(
        "document_id", "status", "title", F.array_join("tags", ",").alias("tags"), "correspondent", "document_type", "storage_path",
        _pairs("custom_fields").alias("custom_fields"),
    )


@query(
    "creation_policy",
    with_(
        """SELECT id, coalesce((SELECT array_to_string(list(tag ORDER BY pos), ',') FROM kept_tag k WHERE k.id=suggestion.id), '') AS tags,
        CASE WHEN lower(correspondent) IN (SELECT lower(name) FROM entity WHERE entity_type='correspondent') THEN correspondent END AS correspondent,
        document_type, CASE WHEN lower(storage_path) IN (SELECT lower(name) FROM entity WHERE entity_type='storage_path') THEN storage_path END AS storage_path
        FROM suggestion""",
        kept_tag="""SELECT id, tag, pos FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags,1) AS pos FROM suggestion)
          WHERE lower(tag) IN (SELECT lower(name) FROM entity WHERE entity_type='tag' AND name<>'')""",
    ),
)
def creation_policy(spark, sf):
    policy = {"tag": True, "correspondent": True, "document_type": False, "storage_path": True}
    out = A.creation_policy(D.suggestion(spark, sf), D.entity(spark, sf), policy)
    return out.select("id", F.array_join("tags", ",").alias("tags"), "correspondent", "document_type", "storage_path")


@query(
    "new_values",
    with_(
        """SELECT id, 'correspondent' AS kind, correspondent AS name FROM suggestion WHERE correspondent<>'' AND lower(correspondent) NOT IN (SELECT lower(name) FROM entity WHERE entity_type='correspondent')
        UNION ALL SELECT id, 'document_type', document_type FROM suggestion WHERE document_type<>'' AND lower(document_type) NOT IN (SELECT lower(name) FROM entity WHERE entity_type='document_type')
        UNION ALL SELECT id, 'custom_field', cf_name FROM suggestion WHERE lower(cf_name) NOT IN (SELECT lower(name) FROM custom_field)"""
    ),
)
def new_values(spark, sf):
    return A.new_values(D.suggestion(spark, sf), D.entity(spark, sf), D.custom_field(spark, sf))

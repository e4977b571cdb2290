"""Scans, chunking and text preparation over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import chunking, retrieval
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query
from foliant.sources import documents as S

INBOX = D.INBOX

COMPLETE_SQL = "SELECT document_id FROM chunk_vec GROUP BY document_id HAVING count(*) >= max(total_chunks)"


@query(
    "scan_documents",
    with_(
        f"""SELECT document_id, title, strftime(added, '%Y-%m-%d %H:%M:%S') AS added FROM document
        WHERE NOT list_contains(tag_ids, 100) AND content <> ''
          AND document_id NOT IN ({COMPLETE_SQL})"""
    ),
)
def scan_documents(spark, sf):
    complete = retrieval.completeness(D.chunk_vec(spark, sf)).where("complete")
    docs = S.to_index(D.document(spark, sf), complete, INBOX)
    return docs.orderBy(F.desc("added"), "document_id").select("document_id", "title", D.stamp("added").alias("added"))


def resolved(spark, sf):
    return S.resolve_names(D.document(spark, sf), D.entity(spark, sf), D.custom_field(spark, sf))


RESOLVED = """
SELECT d.*, coalesce(tn.tags, []) AS tags, coalesce(c.name,'') AS correspondent, coalesce(t.name,'') AS document_type,
  CASE WHEN cf_amount IS NOT NULL THEN 'NATION_0' END AS f1, CASE WHEN cf_note IS NOT NULL THEN 'NATION_1' END AS f2,
  CASE WHEN cf_amount IS NOT NULL THEN 'NATION_8' END AS f9
FROM document d
LEFT JOIN (SELECT document_id, list(name ORDER BY pos) AS tags FROM (
    SELECT document_id, unnest(tag_ids) AS tid, generate_subscripts(tag_ids,1) AS pos FROM document) x
  JOIN entity e ON e.entity_type='tag' AND e.entity_id=tid AND e.name<>'' GROUP BY document_id) tn USING (document_id)
LEFT JOIN entity c ON c.entity_type='correspondent' AND c.entity_id=d.correspondent_id
LEFT JOIN entity t ON t.entity_type='document_type' AND t.entity_id=d.document_type_id"""


@query(
    "resolve_names",
    with_(
        """SELECT document_id, array_to_string(tags, ',') AS tags, correspondent, document_type,
        concat_ws(',', f1 || '=' || cf_amount, f2 || '=' || cf_note, f9 || '=x') AS custom_fields FROM resolved""",
        resolved=RESOLVED,
    ),
)
def resolve_names(spark, sf):
    pairs = F.transform(F.map_entries("custom_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved(spark, sf).select(
        "document_id",
        F.array_join("tags", ",").alias("tags"),
        "correspondent",
        "document_type",
        F.array_join(pairs, ",").alias("custom_fields"),
    )


@query("entity_dim", with_("SELECT entity_id, name FROM entity WHERE entity_type='tag' AND name<>''"))
def entity_dim(spark, sf):
    return S.entities_of(D.entity(spark, sf), "tag")


@query(
    "custom_field_dim",
    with_("SELECT field_id, name, coalesce(data_type,'') AS data_type FROM custom_field"),
)
def custom_field_dim(spark, sf):
    return S.custom_fields(D.custom_field(spark, sf))


@query("inbox_documents", with_("SELECT document_id FROM document WHERE list_contains(tag_ids, 100)"))
def inbox_documents(spark, sf):
    return S.inbox(D.document(spark, sf), INBOX)


@query("inbox_documents_all", with_("SELECT document_id FROM document"))
def inbox_documents_all(spark, sf):
    return S.inbox(D.document(spark, sf), None)


FILTER = """list_has_any(tag_ids, [101,102]) AND correspondent_id IN (1,2,3,4,5,6,7,8,9,10)
  AND document_type_id IN (SELECT document_type_id FROM lang_first) AND (contains(lower(content), 'an') OR contains(lower(title),'an'))"""


def _filtered(spark, sf):
    types = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    return S.filter_documents(
        D.document(spark, sf), tag_ids=[101, 102], correspondent_ids=types, query="An", custom_field_values={9: "x"}
    )


@query(
    "filter_documents",
    with_(
        """SELECT document_id, title, (SELECT count(*) FROM hits) AS total FROM hits
        ORDER BY added DESC, document_id LIMIT 25 OFFSET 25""",
        hits="""SELECT * FROM document WHERE list_has_any(tag_ids, [101,102]) AND correspondent_id BETWEEN 1 AND 10
          AND (contains(lower(content),'an') OR contains(lower(title),'an'))""",
    ),
)
def filter_documents(spark, sf):
    hits = _filtered(spark, sf)
    paged = S.page(hits, [F.desc("added"), F.col("document_id")], 2, 25)
    return paged.select("document_id", "title", S.total(hits).scalar().alias("total"))


@query(
    "docs_modified_since",
    with_(
        """SELECT document_id, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM document
        WHERE modified::DATE >= DATE '2024-01-20'"""
    ),
)
def docs_modified_since(spark, sf):
    return S.modified_since(D.document(spark, sf), "2024-01-20").select("document_id", D.stamp("modified").alias("modified"))


# --- chunks ---------------------------------------------------------------------

CHAR_CHUNKS = """
SELECT document_id, i AS chunk_index, count(*) OVER (PARTITION BY document_id) AS total_chunks,
  document_id || '_' || i AS chunk_id, substring(content, i*800+1, 1000) AS passage
FROM (SELECT document_id, content,
  unnest(CASE WHEN length(content)=0 THEN []::BIGINT[] WHEN length(content)<=1000 THEN [0::BIGINT]
    ELSE range(0, (length(content)-1)//800+1) END) AS i FROM document)"""


@query(
    "chunk_char",
    with_("SELECT document_id, chunk_index, total_chunks, chunk_id, passage FROM char_chunks", char_chunks=CHAR_CHUNKS),
)
def chunk_char(spark, sf):
    return chunking.chunk(D.document(spark, sf).select("document_id", "content"))


SENTENCES = r"""
SELECT document_id, s, row_number() OVER (PARTITION BY document_id ORDER BY p) AS n FROM (
  SELECT document_id, trim(u, E' \n\t\r') AS s, p FROM (
    SELECT document_id, unnest(pieces) AS u, generate_subscripts(pieces, 1) AS p FROM (
      SELECT document_id, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS pieces
      FROM document))) WHERE s <> ''"""


@query("sentence_split", with_("SELECT document_id, n, s AS sentence FROM sents", sents=SENTENCES))
def sentence_split(spark, sf):
    docs = D.document(spark, sf)
    return docs.select("document_id", F.posexplode(X.sentences(F.col("content")))).select(
        "document_id", (F.col("pos") + 1).cast("long").alias("n"), F.col("col").alias("sentence")
    )


# The packing is a running state per document: one recursion step per sentence.
_TAIL = """len(list_filter(range(1, len(cur)+1), lambda k: list_sum(list_transform(cur[-k:], lambda x: length(x)+1)) <= 200))"""
_SPLIT = """list_transform(CASE WHEN length(s)<=1000 THEN [0::BIGINT] ELSE range(0,(length(s)-1)//800+1) END,
  lambda i: substring(s, i*800+1, 1000))"""
CHUNK_SENTENCE_SQL = f"""
WITH RECURSIVE document AS MATERIALIZED (SELECT doc_id+1 AS document_id,
    CASE WHEN doc_id%31=9 THEN '' ELSE text END AS content FROM documents),
sents AS MATERIALIZED (SELECT * FROM ({SENTENCES}) WHERE document_id IN (SELECT document_id FROM document WHERE length(content)>1000)),
step AS (
  SELECT document_id, 0::BIGINT AS n, []::VARCHAR[] AS cur, 0::BIGINT AS used, []::VARCHAR[] AS done
  FROM document WHERE length(content) > 1000
  UNION ALL
  SELECT document_id, n,
    CASE WHEN length(s)>1000 THEN [] WHEN len(cur)>0 AND used+length(s)+1>1000
      THEN list_append(CASE WHEN t>0 THEN cur[-t:] ELSE [] END, s) ELSE list_append(cur, s) END,
    CASE WHEN length(s)>1000 THEN 0 WHEN len(cur)>0 AND used+length(s)+1>1000
      THEN coalesce(list_sum(list_transform(CASE WHEN t>0 THEN cur[-t:] ELSE [] END, lambda x: length(x)+1)),0)+length(s)+1
      ELSE used+length(s)+1 END,
    CASE WHEN length(s)>1000 THEN list_concat(CASE WHEN len(cur)>0 THEN [array_to_string(cur,' ')] ELSE [] END, {_SPLIT})
      WHEN len(cur)>0 AND used+length(s)+1>1000 THEN [array_to_string(cur,' ')] ELSE [] END
  FROM (SELECT step.document_id, sents.n, sents.s, cur, used, {_TAIL} AS t
        FROM step JOIN sents ON sents.document_id=step.document_id AND sents.n=step.n+1)),
pieces AS (
  SELECT document_id, n, unnest(done) AS passage, generate_subscripts(done,1) AS k FROM step
  UNION ALL SELECT document_id, n+1, array_to_string(cur,' '), 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC) AS r FROM step) WHERE r=1 AND len(cur)>0
  UNION ALL SELECT document_id, 0, content, 1 FROM document WHERE length(content) BETWEEN 1 AND 1000)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n,k)-1 AS chunk_index,
  count(*) OVER (PARTITION BY document_id) AS total_chunks, passage FROM pieces"""


@query("chunk_sentence", CHUNK_SENTENCE_SQL)
def chunk_sentence(spark, sf):
    docs = D.document(spark, sf).select("document_id", "content")
    return chunking.chunk(docs, strategy="sentence").drop("chunk_id")


PREFIX = """
coalesce(nullif(concat_ws(chr(10), 'Title: ' || nullif(title,''), 'Type: ' || nullif(document_type,''),
  'From: ' || nullif(correspondent,''), 'Tags: ' || nullif(array_to_string(tags,', '),''),
  f1 || ': ' || nullif(cf_amount,''), f2 || ': ' || nullif(cf_note,''), f9 || ': x'),'') || chr(10) || chr(10), '')"""


@query("embed_prefix", with_(f"SELECT document_id, {PREFIX} AS prefix FROM resolved", resolved=RESOLVED))
def embed_prefix(spark, sf):
    return resolved(spark, sf).select("document_id", chunking.prefix_column().alias("prefix"))


@query(
    "chunk_payload",
    with_(
        """SELECT document_id, chunk_index, total_chunks, title, array_to_string(tags,',') AS tags,
        array_to_string(tag_ids,',') AS tag_ids, correspondent, document_type, length(passage) AS passage_chars
        FROM char_chunks JOIN resolved USING (document_id)""",
        resolved=RESOLVED,
        char_chunks=CHAR_CHUNKS,
    ),
)
def chunk_payload(spark, sf):
    return chunking.chunk(resolved(spark, sf)).select(
        "document_id",
        "chunk_index",
        "total_chunks",
        "title",
        F.array_join("tags", ",").alias("tags"),
        F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tag_ids"),
        "correspondent",
        "document_type",
        F.length("passage").cast("long").alias("passage_chars"),
    )


HASH_SQL = r"""list_transform(range(0,64), lambda i: ('0x' || substring(sha256(t), 2*(i%32)+1, 2))::INTEGER / 255.0::DOUBLE)"""


@query(
    "embed_hash",
    with_(
        """SELECT document_id, chunk_index, round(list_sum(list_transform(v, lambda x, i: x*i)), 6) AS weighted,
        round(v[1], 6) AS first_value, round(v[32], 6) AS last_value, len(v) AS dims
        FROM (SELECT document_id, chunk_index, """
        + HASH_SQL
        + f""" AS v FROM (SELECT document_id, chunk_index, {PREFIX} || passage AS t
            FROM char_chunks JOIN resolved USING (document_id)))""",
        resolved=RESOLVED,
        char_chunks=CHAR_CHUNKS,
    ),
)
def embed_hash(spark, sf):
    chunks = chunking.with_embed_text(chunking.chunk(resolved(spark, sf)))
    v = chunks.select("document_id", "chunk_index", X.hash_embedding(F.col("embed_text")).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select(
        "document_id",
        "chunk_index",
        F.round(weighted, 6).alias("weighted"),
        F.round(F.get("v", F.lit(0)), 6).alias("first_value"),
        F.round(F.get("v", F.lit(31)), 6).alias("last_value"),
        F.size("v").cast("long").alias("dims"),
    )


class HashEmbedder:
    """Plug-in twin of ``hash_embedding``; fails for texts whose length is a multiple of seven."""

    name, max_batch = "sha256", 96

    def embed(self, texts):
        import hashlib

        out = []
        for t in texts:
            d = hashlib.sha256(t.encode()).digest()
            out.append(None if len(t) % 7 == 0 else [b / 255 for b in d + d])
        return out


@query(
    "embed_chunks",
    with_(
        """SELECT document_id, chunk_index, len(v) AS dims, 'sha256' AS embed_model,
        list_sum(list_transform(v, lambda x, i: i*round(x*255)))::BIGINT AS weighted
        FROM (SELECT document_id, chunk_index, """
        + HASH_SQL
        + f""" AS v FROM (SELECT document_id, chunk_index, {PREFIX} || passage AS t
            FROM char_chunks JOIN resolved USING (document_id)) WHERE length(t)%7<>0)""",
        resolved=RESOLVED,
        char_chunks=CHAR_CHUNKS,
    ),
)
def embed_chunks(spark, sf):
    chunks = chunking.with_embed_text(chunking.chunk(resolved(spark, sf)))
    stored, _failed = chunking.split_failed(chunking.embed(chunks, HashEmbedder, 32))
    weighted = F.aggregate(F.transform("vector", lambda x, i: F.round(x * 255) * (i + 1)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return stored.select(
        "document_id", "chunk_index", F.size("vector").cast("long").alias("dims"), "embed_model", weighted.cast("long").alias("weighted")
    )


@query(
    "sparse_terms",
    with_(
        r"""SELECT document_id, term, count(*) AS tf FROM (
        SELECT document_id, unnest(regexp_split_to_array(lower(trim(content, E' \n\t\r')), '\s+')) AS term FROM document)
        WHERE term <> '' GROUP BY document_id, term"""
    ),
)
def sparse_terms(spark, sf):
    return chunking.sparse_terms(D.document(spark, sf), ["document_id"], "content")


@query(
    "truncate_context",
    with_(
        """SELECT document_id, length(content) > 3000 AS truncated, substring(content,1,3000) AS content
        FROM document"""
    ),
)
def truncate_context(spark, sf):
    return chunking.truncate(D.document(spark, sf).select("document_id", "content"), 3000)


@query(
    "deeplink",
    with_(
        """SELECT document_id, 'http://archive:8000/documents/' || document_id || '/details' AS link,
        'https://docs.example.org/documents/' || document_id || '/details' AS public_link FROM document"""
    ),
)
def deeplink(spark, sf):
    link = X.deeplink("http://archive:8000/", "document_id")
    return D.document(spark, sf).select(
        "document_id",
        link.alias("link"),
        X.public_link(link, "http://archive:8000/", "https://docs.example.org/").alias("public_link"),
    )


@query(
    "transcript_assembly",
    with_(
        r"""SELECT session_id AS document_id, array_to_string(list(text ORDER BY call_no), chr(10)||chr(10)) AS content
        FROM (SELECT session_id, call_no, trim(array_to_string(list(content ORDER BY turn_no), chr(10)), E' \n\t\r') AS text
          FROM (SELECT *, turn_no//3 AS call_no FROM turns) GROUP BY session_id, call_no)
        WHERE text<>'' GROUP BY session_id"""
    ),
)
def transcript_assembly(spark, sf):
    pages = D.turns(spark, sf).select(
        F.col("session_id").alias("document_id"), (F.col("turn_no") + 1).alias("page_no"), "content"
    )
    # The text of one call: its pages in order, as a model would return them.
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "content")))
    calls = (
        chunking.page_batches(pages, 3)
        .groupBy("document_id", "call_no")
        .agg(F.array_join(F.transform(ordered, lambda s: s["content"]), "\n").alias("text"))
    )
    return chunking.assemble_transcript(calls)


@query(
    "entity_embed_text",
    with_(
        """SELECT entity_type, entity_id, substring(entity_type || ': ' || name ||
        CASE WHEN entity_type='document_type' THEN '' ELSE chr(10) || repeat(name || ' ', 300) END, 1, 2000) AS embed_text
        FROM entity"""
    ),
)
def entity_embed_text(spark, sf):
    described = D.entity(spark, sf).withColumn(
        "description",
        F.when(F.col("entity_type") != "document_type", F.repeat(F.concat("name", F.lit(" ")), F.lit(300))),
    )
    return described.select(
        "entity_type",
        "entity_id",
        X.entity_text(F.col("entity_type"), F.col("name"), F.col("description")).alias("embed_text"),
    )

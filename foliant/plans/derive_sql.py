"""SQL twins of ``derive`` and a helper that assembles WITH clauses."""

from __future__ import annotations

import re

CTE: dict[str, str] = {}

CTE["src_first"] = "SELECT source, min(doc_id)+1 AS correspondent_id, count(*) AS n FROM documents GROUP BY source"
CTE["lang_first"] = "SELECT lang, min(doc_id)+1 AS document_type_id, count(*) AS n FROM documents GROUP BY lang"
CTE["document"] = """
SELECT doc_id+1 AS document_id, d.source || ' #' || (doc_id+1) AS title,
  CASE WHEN doc_id%31=9 THEN '' ELSE text END AS content,
  list_filter([CASE WHEN doc_id%17=0 THEN 100 END, CASE WHEN quality=1 THEN 101 END,
    CASE WHEN toxic=1 THEN 102 END, CASE WHEN doc_id%23=2 THEN 103 END]::BIGINT[],
    lambda x: x IS NOT NULL) AS tag_ids,
  CASE WHEN doc_id%13<>5 THEN s.correspondent_id END AS correspondent_id,
  CASE WHEN doc_id%19=4 THEN -7 ELSE l.document_type_id END AS document_type_id,
  n_chars::VARCHAR AS cf_amount, CASE WHEN doc_id%3=0 THEN d.lang END AS cf_note,
  TIMESTAMP '2024-01-01' + to_hours(doc_id%8760) AS created,
  TIMESTAMP '2024-01-01' + to_hours(doc_id%8760) AS added,
  TIMESTAMP '2024-01-01' + to_hours(doc_id%8760) + to_hours(doc_id%5) AS modified
FROM documents d LEFT JOIN labels USING (doc_id) JOIN src_first s ON s.source=d.source
  JOIN lang_first l ON l.lang=d.lang"""
CTE["entity"] = """
SELECT 'tag' AS entity_type, t AS entity_id,
  CASE t WHEN 100 THEN 'inbox' WHEN 101 THEN 'quality' WHEN 102 THEN 'toxic' ELSE '' END AS name,
  count(*) AS document_count FROM (SELECT unnest(tag_ids) AS t FROM document) GROUP BY t
UNION ALL SELECT 'correspondent', correspondent_id, source, n FROM src_first
UNION ALL SELECT 'document_type', document_type_id, lang, n FROM lang_first
UNION ALL SELECT 'storage_path', r_regionkey+1, r_name, 0 FROM region"""
CTE["custom_field"] = """
SELECT n_nationkey::BIGINT+1 AS field_id, n_name AS name,
  CASE WHEN n_nationkey%6<>5 THEN ['monetary','integer','float','boolean','string'][n_nationkey%6+1] END AS data_type
FROM nation"""
CTE["chunk_vec"] = """
SELECT document_id, chunk_index, 2::BIGINT AS total_chunks, document_id || '_' || chunk_index AS chunk_id,
  coalesce(text,'') AS passage, 'doc ' || document_id AS title,
  [label+1, document_id%5+11] AS tag_ids,
  ['tag' || (label+1), 'tag' || (document_id%5+11)] AS tags,
  'c' || label AS correspondent,
  CASE WHEN document_id%7=0 THEN '' ELSE 't' || (label%4) END AS document_type,
  CASE WHEN document_id%9=0 THEN ' ' ELSE 'b' || (document_id%4) END AS cf_batch,
  vector, label
FROM (SELECT vec_id//2+1 AS document_id, vec_id%2 AS chunk_index, vec_id,
        max(CASE WHEN vec_id%2=0 THEN label END) OVER (PARTITION BY vec_id//2)::BIGINT AS label,
        embedding::DOUBLE[] AS vector FROM embeddings) e
  LEFT JOIN documents ON doc_id=vec_id"""
CTE["query_vec"] = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings"
CTE["entity_mean"] = """
SELECT label::BIGINT AS label, list(x ORDER BY i) AS vector FROM (
  SELECT label, i, avg(x) AS x FROM (
    SELECT label, unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
  GROUP BY label, i) GROUP BY label"""
CTE["entity_vec"] = """
SELECT 'tag' AS entity_type, label+1 AS entity_id, 'tag' || (label+1) AS name, vector FROM entity_mean
UNION ALL SELECT 'correspondent', label+1, 'c' || label, vector FROM entity_mean"""
CTE["archive"] = """
SELECT document_id, title,
  CASE WHEN document_id%8=5 AND NOT list_contains(tag_ids, tag_ids[1]%10+1) THEN list_append(tag_ids, tag_ids[1]%10+1) ELSE tag_ids END AS tag_ids,
  CASE WHEN document_id%6<>0 THEN CASE WHEN document_id%8=5 THEN tag_ids[1]%10+1 ELSE tag_ids[1] END END AS correspondent_id
FROM chunk_vec WHERE chunk_index=0"""
CTE["suggestion"] = """
SELECT event_id AS id, event_id%300+1 AS document_id,
  CASE WHEN event_id%10<7 THEN 'pending' WHEN event_id%10<9 THEN 'approved' ELSE 'rejected' END AS status,
  ts AS created_at, 'Title ' || (event_id%5) AS title,
  list_filter([CASE WHEN user_id%4<>3 THEN 'tag' || (user_id%4) END,
    CASE WHEN user_id%2=0 THEN 'Quality' END, CASE WHEN user_id%4=1 THEN 'toxic' END],
    lambda x: x IS NOT NULL) AS tags,
  CASE WHEN user_id%3>0 THEN 'SRC' || (user_id%25) END AS correspondent,
  ['EN','fr','it'][user_id%3+1] AS document_type,
  CASE WHEN user_id%5=0 THEN 'asia' END AS storage_path,
  'Nation_' || (user_id%30) AS cf_name, value::VARCHAR AS cf_value,
  CASE WHEN event_id%5=1 THEN repeat('read ' || (user_id%9) || ' ', 100) END AS extracted_content,
  CASE WHEN event_id%2=1 THEN repeat('old ', 200) END AS original_content,
  CASE WHEN event_id%3=0 THEN 'grooming' ELSE 'ocr' END AS analysis_mode,
  CASE WHEN event_id%2=0 THEN 'add' ELSE 'remove' END AS action1, user_id%10+1 AS entity1,
  CASE WHEN user_id%7>0 THEN user_id%7 END AS entity2, user_id%7+1 AS replacement2
FROM events WHERE event_type IN ('click','view','signup')"""
CTE["decision"] = """
SELECT event_id AS decision_id, event_id-user_id%3-1 AS suggestion_id,
  CASE WHEN event_type='purchase' THEN 'approve' ELSE 'reject' END AS verdict,
  'user:' || user_id AS change_source, ts AS decided_at,
  CASE WHEN event_id%2=0 THEN 'Title ' || (event_id%5) END AS edit_title,
  CASE WHEN event_id%4=1 THEN ['tag0','Quality'] END AS edit_tags,
  CASE WHEN event_id%3=1 THEN 'SRC7' END AS edit_correspondent, event_id%2=0 AS apply_content
FROM events WHERE event_type IN ('purchase','error')"""
CTE["audit"] = """
SELECT event_id AS id, user_id+1 AS document_id, 'Report ' || (user_id%12) AS document_title,
  ['title','tags','correspondent','document_type','storage_path','_event'][event_id%6+1] AS field_name,
  CASE WHEN event_id%4>0 THEN floor(value)::BIGINT::VARCHAR END AS previous_value,
  (floor(value)+1)::BIGINT::VARCHAR AS new_value, 'user:' || (user_id%20) AS change_source,
  event_type AS action_type, CASE WHEN event_id%5=0 THEN 's' || (event_id%40) END AS session_id,
  ts AS changed_at, CASE WHEN event_id%3=0 THEN event_id END AS suggestion_id
FROM events"""
CTE["tracking"] = """
SELECT document_id, TIMESTAMP '2024-01-01' AS first_seen_at,
  CASE WHEN ((document_id%5)+5)%5>0 THEN TIMESTAMP '2024-02-01' END AS last_analyzed_at,
  CASE WHEN document_id%7=0 THEN TIMESTAMP '2024-02-01' + to_hours(((document_id%100)+100)%100) END AS reembed_dirty_since,
  CASE WHEN document_id%11<>0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id%8760) + to_hours(doc_id%5)
    + to_hours(((document_id%3)+3)%3-1) END AS last_embedded_at
FROM (SELECT doc_id+1 AS document_id, doc_id FROM documents WHERE (doc_id+1)%3>0
  UNION ALL SELECT -s_suppkey-1, 0 FROM supplier)"""
CTE["webhook_body"] = r"""
SELECT event_id, ts, CASE event_id%9
  WHEN 0 THEN '{"document_id": ' || t || '}'
  WHEN 1 THEN '{"id": ' || t || '}'
  WHEN 2 THEN '{"doc_url": "http://host/documents/' || t || '/details"}'
  WHEN 3 THEN '"{\"document_id\": ' || t || '}"'
  WHEN 4 THEN 'not json ' || t
  WHEN 5 THEN '[' || t || ']'
  WHEN 6 THEN '{"title": "t' || t || '"}'
  WHEN 7 THEN '{"doc_url": "http://host/files/' || t || '"}'
  ELSE '{"document_id": "' || t || '"}' END AS body
FROM (SELECT event_id, ts, (event_id%1000)::VARCHAR AS t FROM events)"""
CTE["turns"] = """
SELECT conv_id AS session_id, turn AS turn_no, role,
  CASE WHEN (conv_id+turn)%11=3 THEN '  ' ELSE text END AS content,
  TIMESTAMP '2024-01-01' + to_hours((conv_id*2+turn)%8760) AS ts FROM conversations"""
CTE["summary"] = """
SELECT conv_id AS session_id, 'Earlier: ' || role AS summary FROM conversations
WHERE turn=0 AND length(text)>150"""
CTE["memory_vec"] = """
SELECT vec_id AS memory_id, 'memory ' || vec_id AS text, embedding::DOUBLE[] AS vector,
  TIMESTAMP '2024-01-01' + to_hours(vec_id%8760) AS created_at FROM embeddings WHERE vec_id%2=0"""
CTE["fact_vec"] = """
SELECT vec_id*2 AS fact_id, 'fact ' || (vec_id*2) AS text, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id%2=1
UNION ALL
SELECT vec_id*2+1, 'fact ' || (vec_id*2+1),
  list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i-1=vec_id%64 THEN x+0.01 ELSE x END) FROM embeddings"""


def with_(body: str, **extra: str) -> str:
    """``body`` with the CTEs it names (directly or through others) in front of it."""
    known = {**CTE, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name]) if known[name] is not text else None
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({known[n].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"

# --- entities ----------------------------------------------------------------------

CTE["entity_name"] = """
SELECT 'tag' AS entity_type, k*6 + v AS entity_id, names[v] AS name,
  CASE WHEN k%2=0 THEN 'text' END AS description, (v-1)%2=0 AS embedding_stored FROM (
  SELECT k, unnest(range(1,7)) AS v, [base, upper(base), replace(base,'e','é'), base || 's',
    substring(base,1,length(base)-1), ' ' || base || ' '] AS names FROM (
    SELECT p_name AS base, min(p_partkey)*3 AS k FROM part GROUP BY 1
    UNION ALL SELECT p_brand, min(p_partkey)*3+1 FROM part GROUP BY 1
    UNION ALL SELECT p_type, min(p_partkey)*3+2 FROM part GROUP BY 1))"""
CTE["vector_entity"] = """
SELECT CASE WHEN fact_id%8<6 THEN 'tag' ELSE 'correspondent' END AS entity_type, fact_id+1 AS entity_id, substring(sha256(fact_id::VARCHAR),1,12) AS name, vector,
  CASE WHEN fact_id%3=0 THEN 'text' END AS description, fact_id%2=0 AS embedding_stored FROM fact_vec"""
CTE["similarity_link"] = """
SELECT o_custkey AS a, floor(o_custkey*0.5 + o_orderkey%3)::BIGINT AS b FROM orders WHERE o_orderstatus='P'"""
CTE["entity_state"] = """
SELECT CASE WHEN k%3=0 THEN 'correspondent' ELSE 'tag' END AS entity_type, k+1 AS entity_id,
  CASE WHEN k%10=0 THEN c_name || ' old' ELSE c_name END AS name,
  CASE WHEN k%4=0 THEN '' WHEN k%4<3 THEN 'About ' || c_mktsegment END AS description,
  CASE WHEN k%4=1 THEN 'user' WHEN k%4=2 THEN 'llm' END AS description_source, k%8=7 AS excluded,
  CASE WHEN k%5>0 THEN [c_acctbal, 1.0] END AS vector, k%5>1 AS embedding_stored,
  CASE WHEN k%5>0 THEN CASE WHEN k%7=0 THEN 'old' ELSE 'm1' END END AS embed_model,
  CASE WHEN k%6>0 THEN TIMESTAMP '2024-01-01' + to_hours(k%700) END AS description_updated_at,
  CASE WHEN k%9>0 THEN TIMESTAMP '2024-01-01' + to_hours(k%650+24*200) END AS last_scanned_at
FROM (SELECT *, c_custkey AS k FROM customer)"""
CTE["entity_source"] = """
SELECT CASE WHEN c_custkey%3=0 THEN 'correspondent' ELSE 'tag' END AS entity_type, c_custkey+1 AS entity_id, c_name AS name,
  c_custkey%50 AS document_count FROM customer WHERE c_custkey%11<10
UNION ALL SELECT 'document_type', s_suppkey+1, s_name, 0 FROM supplier"""
CTE["dismissal"] = """
SELECT CASE WHEN event_id%2=0 THEN 'tag' ELSE 'correspondent' END AS entity_type, user_id%10+1 AS entity_id,
  CASE WHEN event_id%5=4 THEN 0 ELSE event_id%300+1 END AS document_id,
  ['add','remove','replace','review','dedup'][event_id%5+1] AS action,
  CASE WHEN event_id%3>0 THEN user_id%14+1 END AS other_entity_id,
  CASE WHEN event_id%40>0 THEN ts END AS dismissed_at FROM events"""
CTE["pending_document"] = "SELECT DISTINCT document_id FROM suggestion WHERE status='pending' AND correspondent='SRC7'"
CTE["current_document"] = """
SELECT document_id, title, CASE WHEN document_id%8=3 THEN tag_ids[2:2] WHEN document_id%8=5 THEN list_append(tag_ids, 3)
  ELSE tag_ids END AS tag_ids, CASE WHEN document_id%9=2 THEN 4 ELSE correspondent_id END AS correspondent_id FROM archive"""
CTE["scan_name"] = """
SELECT entity_type, entity_id, name FROM entity_vec
UNION SELECT 'tag', unnest(tag_ids), unnest(tags) FROM chunk_vec"""

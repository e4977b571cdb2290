"""Conversation and memory queries. Windows use four turns, since sessions here have at most eight."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import converse as C
from foliant.operators import retrieval
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query

NOW = "2024-06-01 00:00:00"
AGED = "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS age FROM turns"
SPOKEN = "CASE WHEN role='user' THEN 'User: ' ELSE 'Assistant: ' END || substring(content,1,{n})"


@query("recent_turns", with_("SELECT session_id, turn_no, role, content, age FROM aged WHERE age<=4", aged=AGED))
def recent_turns(spark, sf):
    return C.recent_turns(D.turns(spark, sf), 4).drop("ts")


@query(
    "turns_to_compress",
    with_(
        f"""SELECT session_id, 0::BIGINT AS segment, concat_ws(chr(10)||chr(10), '[Prior summary]: ' || summary, text) AS summary_input FROM (
        SELECT session_id, array_to_string(list({SPOKEN.format(n=500)} ORDER BY turn_no), chr(10)) AS text FROM aged WHERE age>4 GROUP BY session_id)
        LEFT JOIN summary USING (session_id)""",
        aged=AGED,
    ),
)
def turns_to_compress(spark, sf):
    return C.turns_to_compress(D.turns(spark, sf), D.summary(spark, sf), 4)


@query(
    "valid_history",
    with_("SELECT session_id, turn_no, role, content FROM aged WHERE age<=4 AND role IN ('user','assistant') AND trim(content)<>''", aged=AGED),
)
def valid_history(spark, sf):
    return C.valid_history(D.turns(spark, sf), 4).select("session_id", "turn_no", "role", "content")


MEM = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, memory_id) AS rank FROM (
  SELECT query_id, memory_id, text, round(list_cosine_similarity(q.vector, m.vector), 12) AS cos FROM query_vec q, memory_vec m)) WHERE rank<=5 AND cos>0.35"""


@query("retrieve_memories", with_("SELECT query_id, memory_id, text, round(cos,6) AS cosine, rank FROM mem", mem=MEM))
def retrieve_memories(spark, sf):
    found = C.retrieve_memories(D.memory_vec(spark, sf), D.query_vec(spark, sf), 5, 0.35)
    return found.withColumn("cosine", F.round("cosine", 6)).select("query_id", "memory_id", "text", "cosine", "rank")


# Questions: the embeddings, every second one turned away from everything stored.
QUESTION = "SELECT query_id, CASE WHEN query_id%2=1 THEN list_transform(vector, lambda x: -x) ELSE vector END AS vector FROM query_vec"
REWRITTEN = """SELECT query_id+1-2*(query_id%2) AS query_id, vector FROM query_vec WHERE query_id%3>0"""
PASS_SQL = """SELECT * FROM (SELECT *, (1+cos)/2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, document_id, chunk_index) AS rank FROM (
  SELECT query_id, document_id, chunk_index, round(list_cosine_similarity(q.vector, c.vector), 12) AS cos FROM {q} q, chunk_vec c)) WHERE rank<=20 AND score>=0.72"""
FOUND = dict(
    question=QUESTION,
    rewritten=REWRITTEN,
    pass1=PASS_SQL.format(q="question"),
    unanswered="SELECT * FROM rewritten WHERE query_id NOT IN (SELECT query_id FROM pass1)",
    pass2=PASS_SQL.format(q="unanswered"),
    found="SELECT *, 1::BIGINT AS search_pass FROM pass1 UNION ALL SELECT *, 2 FROM pass2",
)


def found(spark, sf):
    q = D.query_vec(spark, sf)
    questions = q.withColumn(
        "vector", F.when(F.col("query_id") % 2 == 1, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    )
    rewritten = q.where(F.col("query_id") % 3 > 0).withColumn("query_id", F.col("query_id") + 1 - 2 * (F.col("query_id") % 2))
    return C.search_with_fallback(D.chunk_vec(spark, sf), questions, rewritten, 5, 0.72)


@query(
    "search_with_fallback",
    with_("SELECT query_id, document_id, chunk_index, round(score,6) AS score, rank, search_pass FROM found", **FOUND),
)
def search_with_fallback(spark, sf):
    return found(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "accepted_rewrites",
    r"""SELECT * FROM (SELECT doc_id AS query_id, regexp_replace(regexp_replace(trim(text, E' \n\t\r'), '^[*"`#_ \t\n]+|[*"`#_ \t\n]+$', '', 'g'), '^''+|''+$', '', 'g') AS rewrite
      FROM (SELECT doc_id, '"' || text || '"' AS text FROM documents)) WHERE length(rewrite) BETWEEN 1 AND 300""",
)
def accepted_rewrites(spark, sf):
    docs = D.table(spark, sf, "documents")
    return C.accepted_rewrites(docs.select(F.col("doc_id").alias("query_id"), F.concat(F.lit('"'), "text", F.lit('"')).alias("rewrite")))


@query(
    "rewrite_inputs",
    with_(
        f"""SELECT session_id AS query_id, concat_ws(chr(10), '[Earlier context]: ' || summary, text) AS rewrite_context FROM (
        SELECT session_id, array_to_string(list({SPOKEN.format(n=400)} ORDER BY turn_no), chr(10)) AS text FROM aged WHERE age<=6 GROUP BY session_id)
        LEFT JOIN summary USING (session_id)""",
        aged=AGED,
    ),
)
def rewrite_inputs(spark, sf):
    t = D.turns(spark, sf)
    questions = t.select("session_id", F.col("session_id").alias("query_id")).distinct()
    return C.rewrite_inputs(questions, t, D.summary(spark, sf))


CITED = dict(
    **FOUND,
    used="""SELECT f.*, c.title, c.passage, min(rank) OVER (PARTITION BY query_id, f.document_id) AS first_rank FROM found f
      JOIN chunk_vec c USING (document_id, chunk_index) WHERE rank<=10 AND passage<>''""",
    cited="""SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS citation FROM used""",
)


def cited(spark, sf):
    return C.citations(found(spark, sf), D.chunk_store(spark, sf), 5)


@query(
    "citations",
    with_(
        """SELECT query_id, rank, document_id, citation, '[' || citation || '] ' || title || ' (ID ' || document_id || ')' || chr(10) || passage AS context_line FROM cited""",
        **CITED,
    ),
)
def citations(spark, sf):
    return cited(spark, sf).select("query_id", "rank", "document_id", "citation", "context_line")


@query(
    "sources",
    with_(
        """SELECT query_id, citation, document_id, min_by(title, (-score, rank)) AS title, round(max(score),3) AS score, substring(min_by(passage, (-score, rank)),1,1500) AS snippet,
        'https://docs.example.org/documents/' || document_id || '/details' AS deeplink_url FROM cited GROUP BY query_id, citation, document_id""",
        **CITED,
    ),
)
def sources(spark, sf):
    return C.sources(cited(spark, sf), "http://archive:8000", "https://docs.example.org")


@query(
    "chat_messages",
    with_(
        f"""SELECT t.session_id AS query_id, 1 + coalesce(h.n, 0) + 1 AS messages,
        md5(concat_ws(chr(10), 'system: ' || '{C.SAME_LANGUAGE.replace(chr(10), "' || chr(10) || '")}' || 'Answer from the excerpts.'
          || coalesce('{C.MEMORY_HEADER.replace(chr(10), "' || chr(10) || '")}' || facts, '') || coalesce('{C.SUMMARY_HEADER.replace(chr(10), "' || chr(10) || '")}' || summary, ''),
          h.said, 'user: Documents:' || chr(10) || coalesce(ctx, '') || chr(10) || chr(10) || 'Question: q' || t.session_id)) AS digest
        FROM (SELECT DISTINCT session_id FROM turns) t
        LEFT JOIN (SELECT session_id, count(*) AS n, array_to_string(list(role || ': ' || content ORDER BY turn_no), chr(10)) AS said FROM aged
          WHERE age<=4 AND role IN ('user','assistant') AND trim(content)<>'' GROUP BY session_id) h USING (session_id)
        LEFT JOIN summary USING (session_id)
        LEFT JOIN (SELECT query_id, array_to_string(list('- ' || text ORDER BY rank), chr(10)) AS facts FROM mem GROUP BY query_id) m ON m.query_id=t.session_id
        LEFT JOIN (SELECT query_id, array_to_string(list('[' || citation || '] ' || title || ' (ID ' || document_id || ')' || chr(10) || passage ORDER BY rank), chr(10)||chr(10)) AS ctx
          FROM cited GROUP BY query_id) c ON c.query_id=t.session_id""",
        aged=AGED,
        mem=MEM,
        **CITED,
    ),
)
def chat_messages(spark, sf):
    t = D.turns(spark, sf)
    questions = t.select("session_id").distinct().select(
        "session_id", F.col("session_id").alias("query_id"), F.concat(F.lit("q"), "session_id").alias("question")
    )
    memories = C.retrieve_memories(D.memory_vec(spark, sf), D.query_vec(spark, sf), 5, 0.35)
    out = C.chat_messages(
        questions, C.context(cited(spark, sf)), C.valid_history(t, 4), D.summary(spark, sf), memories, "Answer from the excerpts."
    )
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return out.select("query_id", F.size("messages").cast("long").alias("messages"), F.md5(text).alias("digest"))


@query(
    "session_persist",
    with_(
        """SELECT session_id, base + n AS turn_no, CASE WHEN n=1 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN n=1 THEN 'question ' ELSE 'answer ' END || event_id AS content FROM (
        SELECT user_id AS session_id, event_id, coalesce(l.last, -1) + 2*(row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1) AS base
        FROM events LEFT JOIN (SELECT session_id, max(turn_no) AS last FROM turns GROUP BY 1) l ON l.session_id=user_id), (SELECT unnest([1,2]) AS n)"""
    ),
)
def session_persist(spark, sf):
    exchanges = D.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("exchange_no"),
        F.concat(F.lit("question "), "event_id").alias("question"), F.concat(F.lit("answer "), "event_id").alias("answer"), "ts",
    )
    return C.persist_turns(D.turns(spark, sf), exchanges).drop("ts")


@query(
    "expired_sessions",
    with_(
        """SELECT session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM turns GROUP BY session_id
        HAVING max(ts) < TIMESTAMP '2024-01-07' - INTERVAL 24 HOUR"""
    ),
)
def expired_sessions(spark, sf):
    gone = C.expired_sessions(D.turns(spark, sf), D.ntz("2024-01-07 00:00:00"))
    return gone.select("session_id", D.stamp("updated_at").alias("updated_at"))


@query(
    "extraction_input",
    with_(
        f"""SELECT session_id, 0::BIGINT AS segment, concat_ws(chr(10), '[Earlier summary]: ' || summary, text) AS extraction_text FROM (
        SELECT session_id, array_to_string(list({SPOKEN.format(n=600)} ORDER BY turn_no), chr(10)) AS text FROM turns GROUP BY session_id) LEFT JOIN summary USING (session_id)"""
    ),
)
def extraction_input(spark, sf):
    return C.extraction_input(D.turns(spark, sf), D.summary(spark, sf))


@query(
    "parse_facts",
    with_(
        r"""SELECT session_id, turn_no, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY p)-1 AS fact_no, fact FROM (
        SELECT session_id, turn_no, p, trim(regexp_replace(trim(line, E' \t\r\n'), '^[-•*·▸→]+', ''), E' \t\r\n') AS fact FROM (
          SELECT session_id, turn_no, unnest(string_split(a, chr(10))) AS line, generate_subscripts(string_split(a, chr(10)),1) AS p FROM (
            SELECT session_id, turn_no, CASE WHEN role='system' THEN 'None so far' ELSE '• ' || content || chr(10) || '-* NONE of this' || chr(10) || '→ short' END AS a FROM turns)
          WHERE NOT starts_with(upper(trim(a)), 'NONE'))) WHERE length(fact)>5"""
    ),
)
def parse_facts(spark, sf):
    answers = D.turns(spark, sf).select(
        "session_id", "turn_no",
        F.when(F.col("role") == "system", "None so far").otherwise(F.concat(F.lit("• "), "content", F.lit("\n-* NONE of this\n→ short"))).alias("answer"),
    )
    return C.parse_facts(answers)


@query(
    "memory_upsert",
    with_(
        """SELECT m.memory_id, coalesce(f.text, m.text) AS text, CASE WHEN f.fact_id IS NULL THEN 0 ELSE 1 END::BIGINT AS facts
          FROM memory_vec m LEFT JOIN fact_vec f ON list_cosine_similarity(m.vector, f.vector) >= 0.88
        UNION ALL SELECT -f.fact_id-1, coalesce(g.text, f.text), CASE WHEN g.fact_id IS NULL THEN 1 ELSE 2 END
          FROM fact_vec f LEFT JOIN fact_vec g ON g.fact_id>f.fact_id AND list_cosine_similarity(g.vector, f.vector) >= 0.88
          WHERE NOT EXISTS (SELECT 1 FROM memory_vec m WHERE list_cosine_similarity(m.vector, f.vector) >= 0.88)
            AND NOT EXISTS (SELECT 1 FROM fact_vec e WHERE e.fact_id<f.fact_id AND list_cosine_similarity(e.vector, f.vector) >= 0.88)"""
    ),
)
def memory_upsert(spark, sf):
    return C.upsert_memories(D.memory_vec(spark, sf), D.fact_vec(spark, sf)).select("memory_id", "text", "facts")


@query(
    "memory_list",
    with_("SELECT memory_id, text, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM memory_vec"),
)
def memory_list(spark, sf):
    return C.list_memories(D.memory_vec(spark, sf)).select("memory_id", "text", D.stamp("created_at").alias("created_at"))


@query(
    "memory_edit",
    with_(
        """SELECT memory_id, coalesce(nt, text) AS text, coalesce(nt<>text, false) AS needs_embedding, CASE WHEN coalesce(nt<>text,false) THEN '2024-06-01 00:00:00' END AS updated_at
        FROM (SELECT *, CASE WHEN memory_id%6=0 THEN 'edited ' || memory_id WHEN memory_id%6=2 THEN text END AS nt FROM memory_vec) WHERE memory_id%10<>4"""
    ),
)
def memory_edit(spark, sf):
    m = D.memory_vec(spark, sf)
    i = F.col("memory_id")
    edits = m.select(
        "memory_id",
        F.when(i % 6 == 0, F.concat(F.lit("edited "), i)).when(i % 6 == 2, F.col("text")).alias("new_text"),
        (i % 10 == 4).alias("deleted"),
    )
    out = C.edit_memories(m, edits, D.ntz(NOW))
    return out.select("memory_id", "text", "needs_embedding", D.stamp("updated_at").alias("updated_at"))

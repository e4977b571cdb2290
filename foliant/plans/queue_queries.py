"""Suggestion queue, audit and access queries over tables derived from ``events`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import access as K
from foliant.operators import audit as H
from foliant.operators import queue as G
from foliant.plans import derive as D
from foliant.plans.derive_sql import with_
from foliant.plans.registry import query
from foliant.sources import documents as S

NOW = "2024-06-01 00:00:00"
AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(
    "enqueue",
    with_(
        """SELECT id, document_id, status FROM suggestion WHERE status<>'pending'
        UNION ALL SELECT id, document_id, 'pending' FROM suggestion WHERE status='pending'
        UNION ALL SELECT event_id, event_id%300+1, 'pending' FROM events WHERE event_type IN ('purchase','error')"""
    ),
)
def enqueue(spark, sf):
    """Late rows come twice under their id, the second for another document; the first counts."""
    s = D.suggestion(spark, sf).select("id", "document_id", "status")
    late = D.table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("id"), (F.col("event_id") % 300 + 1).alias("document_id"), F.lit("approved").alias("status")
    )
    twice = late.unionByName(late.withColumn("document_id", F.col("document_id") + 1000))
    return G.enqueue(s.where(F.col("status") != "pending"), s.unionByName(twice))


def states(supersede: bool) -> dict[str, str]:
    """Decision resolution as SQL: the state every suggestion ends in."""
    scope = "document_id" if supersede else "id"
    return dict(
        asked="""SELECT s.*, min(decision_id) FILTER (WHERE verdict='approve') AS a, min(decision_id) FILTER (WHERE verdict='reject') AS r
            FROM (SELECT id, document_id, status FROM suggestion) s LEFT JOIN decision d ON d.suggestion_id=s.id GROUP BY ALL""",
        cand="SELECT *, CASE WHEN status='pending' AND a IS NOT NULL AND (r IS NULL OR a<r) THEN a END AS c FROM asked",
        won=f"SELECT *, min(c) OVER (PARTITION BY {scope}) AS w, arg_min(id, c) OVER (PARTITION BY {scope}) AS wid FROM cand",
        ends="""SELECT *, CASE WHEN status<>'pending' THEN NULL WHEN wid=id THEN 'approved'
            WHEN r IS NOT NULL AND (w IS NULL OR r<w) THEN 'rejected' WHEN w IS NOT NULL THEN 'superseded' END AS fin FROM won""",
        outcomes="""SELECT decision_id, d.suggestion_id, verdict, CASE WHEN e.id IS NULL THEN 'not_found'
            WHEN fin='approved' AND verdict='approve' AND decision_id=w THEN 'approved'
            WHEN fin='rejected' AND verdict='reject' AND decision_id=r THEN 'rejected'
            WHEN status='rejected' AND verdict='reject' THEN 'no_op'
            WHEN fin IN ('rejected','superseded') AND verdict='reject' THEN 'no_op' ELSE 'error' END AS outcome
            FROM decision d LEFT JOIN ends e ON e.id=d.suggestion_id""",
        done="""SELECT s.*, d.*, o.outcome FROM outcomes o JOIN decision d ON d.decision_id=o.decision_id
            JOIN suggestion s ON s.id=o.suggestion_id WHERE outcome IN ('approved','rejected')""",
    )


def decided(spark, sf, supersede=True):
    return G.decide(D.suggestion(spark, sf), D.decision(spark, sf), supersede)


def _audit(df):
    return df.select(
        "document_id", "document_title", "field_name", "previous_value", "new_value", "change_source", "action_type",
        D.stamp("changed_at").alias("changed_at"), "suggestion_id",
    )


@query(
    "approve",
    with_(
        f"""SELECT document_id, title AS document_title, field_name, previous_value, new_value, change_source, 'field_change' AS action_type,
          {AT.format('decided_at')} AS changed_at, suggestion_id FROM (
          SELECT *, 'title' AS field_name, title AS previous_value, edit_title AS new_value FROM done WHERE outcome='approved' AND edit_title<>title
          UNION ALL SELECT *, 'tags', js(tags), js(edit_tags) FROM done WHERE outcome='approved' AND edit_tags<>tags
          UNION ALL SELECT *, 'correspondent', correspondent, edit_correspondent FROM done WHERE outcome='approved' AND edit_correspondent IS DISTINCT FROM correspondent AND edit_correspondent IS NOT NULL
          UNION ALL SELECT *, 'content', nullif(substring(original_content,1,500),''), substring(extracted_content,1,500) FROM done
            WHERE outcome='approved' AND apply_content AND extracted_content<>'')
        UNION ALL SELECT document_id, title, '_event', NULL, 'suggestion:' || suggestion_id, change_source, 'approved', {AT.format('decided_at')}, suggestion_id
          FROM done WHERE outcome='approved'""".replace(
            "js(tags)", """'[' || array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ', ') || ']'"""
        ).replace("js(edit_tags)", """'[' || array_to_string(list_transform(edit_tags, lambda t: '"' || t || '"'), ', ') || ']'"""),
        **states(True),
    ),
)
def approve(spark, sf):
    audit = decided(spark, sf).audit
    return _audit(audit.where(F.col("action_type").isin("field_change", "approved")))


@query(
    "supersede",
    with_(
        f"""SELECT e.document_id, s.title AS document_title, '_event' AS field_name, NULL::VARCHAR AS previous_value, 'superseded_by:' || wid AS new_value,
        d.change_source, 'rejected' AS action_type, {AT.format('d.decided_at')} AS changed_at, e.id AS suggestion_id
        FROM ends e JOIN decision d ON d.decision_id=e.w JOIN suggestion s ON s.id=e.wid WHERE fin='superseded'""",
        **states(True),
    ),
)
def supersede(spark, sf):
    audit = decided(spark, sf).audit
    return _audit(audit.where(F.startswith("new_value", F.lit("superseded_by:"))))


@query(
    "reject",
    with_(
        f"""SELECT entity_type, entity_id, document_id, action, other_entity_id, {AT.format('decided_at')} AS dismissed_at FROM (
        SELECT 'tag' AS entity_type, entity1 AS entity_id, document_id, action1 AS action, NULL::BIGINT AS other_entity_id, decided_at, outcome, analysis_mode FROM done
        UNION ALL SELECT 'correspondent', entity2, document_id, 'replace', replacement2, decided_at, outcome, analysis_mode FROM done WHERE entity2 IS NOT NULL)
        WHERE outcome='rejected' AND analysis_mode='grooming'""",
        **states(True),
    ),
)
def reject(spark, sf):
    return decided(spark, sf).dismissals.withColumn("dismissed_at", D.stamp("dismissed_at"))


@query("bulk_decide", with_("SELECT * FROM outcomes", **states(False)))
def bulk_decide(spark, sf):
    return decided(spark, sf, supersede=False).outcomes


@query(
    "queue_after",
    with_(
        """SELECT s.id, s.document_id, CASE WHEN fin='superseded' THEN 'rejected' ELSE coalesce(fin, s.status) END AS status,
        coalesce(d.edit_title, s.title) AS title, array_to_string(coalesce(d.edit_tags, s.tags), ',') AS tags,
        coalesce(d.edit_correspondent, s.correspondent) AS correspondent
        FROM suggestion s JOIN ends e ON e.id=s.id LEFT JOIN done d ON d.suggestion_id=s.id AND d.outcome='approved'""",
        **states(True),
    ),
)
def queue_after(spark, sf):
    out = decided(spark, sf).suggestions
    return out.select("id", "document_id", "status", "title", F.array_join("tags", ",").alias("tags"), "correspondent")


@query(
    "queue_page",
    with_(
        f"""SELECT id, document_id, {AT.format('created_at')} AS created_at, (SELECT count(*) FROM suggestion WHERE status='pending') AS total
        FROM suggestion WHERE status='pending' ORDER BY suggestion.created_at DESC, id LIMIT 50 OFFSET 100"""
    ),
)
def queue_page(spark, sf):
    pending = D.suggestion(spark, sf).where(F.col("status") == "pending")
    rows = S.page(pending, [F.desc("created_at"), F.col("id")], 3, 50)
    return rows.select("id", "document_id", D.stamp("created_at").alias("created_at"), S.total(pending).scalar().alias("total"))


@query(
    "queue_stats",
    with_(
        """SELECT count(*) FILTER (WHERE status='pending') AS suggestions_pending, count(*) FILTER (WHERE status='approved') AS suggestions_approved,
        count(*) FILTER (WHERE status='rejected') AS suggestions_rejected, (SELECT count(*) FROM tracking) AS tracked_documents FROM suggestion"""
    ),
)
def queue_stats(spark, sf):
    return G.queue_stats(D.suggestion(spark, sf), D.tracking(spark, sf))


@query("eligible_documents", with_("SELECT count(*) AS eligible FROM document WHERE NOT list_contains(tag_ids, 100)"))
def eligible_documents(spark, sf):
    return G.eligible_documents(D.document(spark, sf), D.INBOX)


@query(
    "empty_queue",
    with_(
        """SELECT document_id, title AS document_title, 'suggestion:' || id AS new_value, 'user:ann' AS change_source, 'rejected' AS action_type
        FROM suggestion WHERE status='pending'"""
    ),
)
def empty_queue(spark, sf):
    _, audit = G.empty_queue(D.suggestion(spark, sf), "user:ann", D.ntz(NOW))
    return audit.select("document_id", "document_title", "new_value", "change_source", "action_type")


# Rejections that count for the reset: those of one correspondent, so that some tracking stays.
_REJ = "SELECT * FROM suggestion WHERE status<>'rejected' OR correspondent='SRC7'"


@query(
    "reset_rejected",
    with_(
        f"""SELECT 'suggestion' AS kind, id AS key FROM ({_REJ}) WHERE status<>'rejected'
        UNION ALL SELECT 'tracking', document_id FROM tracking WHERE document_id NOT IN (SELECT document_id FROM ({_REJ}) WHERE status='rejected')"""
    ),
)
def reset_rejected(spark, sf):
    s = D.suggestion(spark, sf).where((F.col("status") != "rejected") | (F.col("correspondent") == "SRC7"))
    left, tracked = G.reset_rejected(s, D.tracking(spark, sf))
    return left.select(F.lit("suggestion").alias("kind"), F.col("id").alias("key")).unionByName(
        tracked.select(F.lit("tracking").alias("kind"), F.col("document_id").alias("key"))
    )


@query("reset_tracking", with_("SELECT count(*) AS cleared FROM tracking"))
def reset_tracking(spark, sf):
    return G.reset_tracking(D.tracking(spark, sf))[1]


@query(
    "reanalyze_swap",
    with_(
        """SELECT id, document_id, CASE WHEN status='pending' AND id%4<>1 THEN 'rejected' ELSE status END AS status, title FROM suggestion
        UNION ALL SELECT -id-1, document_id, 'pending', 'Fresh ' || id FROM suggestion WHERE status='pending' AND id%4<>1"""
    ),
)
def reanalyze_swap(spark, sf):
    s = D.suggestion(spark, sf).select("id", "document_id", "status", "title")
    fresh = s.where(F.col("status") == "pending").select(
        (-F.col("id") - 1).alias("id"), "document_id", "status", F.concat(F.lit("Fresh "), "id").alias("title"),
        F.col("id").alias("old_id"), F.when(F.col("id") % 4 == 1, F.lit("timeout")).alias("error"),
    )
    return G.reanalyze_swap(s, fresh)


@query(
    "stack_suggestions",
    with_(
        f"""SELECT document_id, id, {AT.format('created_at')} AS created_at, copies,
          concat_ws(',', CASE WHEN max(title) OVER d<>min(title) OVER d THEN 'title' END,
            CASE WHEN max(tg) OVER d<>min(tg) OVER d THEN 'tags' END, CASE WHEN max(co) OVER d<>min(co) OVER d THEN 'correspondent' END,
            CASE WHEN max(dt) OVER d<>min(dt) OVER d THEN 'document_type' END, CASE WHEN max(sp) OVER d<>min(sp) OVER d THEN 'storage_path' END,
            CASE WHEN max(cf) OVER d<>min(cf) OVER d THEN 'custom_fields' END) AS varying FROM (
          SELECT document_id, title, tg, co, dt, sp, cf, max_by(id, (created_at, id)) AS id, max(created_at) AS created_at, count(*) AS copies FROM (
            SELECT *, array_to_string(list_sort(tags),',') AS tg, coalesce(correspondent,'-') AS co, document_type AS dt, coalesce(storage_path,'-') AS sp,
              CASE WHEN storage_path IS NULL THEN '-' ELSE cf_name END AS cf FROM suggestion WHERE status='pending') GROUP BY document_id, title, tg, co, dt, sp, cf)
        WINDOW d AS (PARTITION BY document_id)"""
    ),
)
def stack_suggestions(spark, sf):
    pending = D.suggestion(spark, sf).where(F.col("status") == "pending")
    # Few distinct custom fields, so that identical suggestions occur.
    name = F.get(F.map_keys("custom_fields"), F.lit(0))
    few = F.when(F.col("storage_path").isNotNull(), F.create_map(name, F.lit("x")))
    pending = pending.withColumn("custom_fields", few)
    return G.stack_suggestions(pending).select(
        "document_id", "id", D.stamp("created_at").alias("created_at"), "copies", F.array_join("varying", ",").alias("varying")
    )


@query(
    "final_tags",
    with_(
        """SELECT id, array_to_string(list_filter(every, lambda t: CASE WHEN t='Quality' AND id%3=0 THEN false WHEN t='extra' THEN true
          WHEN t='toxic' AND id%5=0 THEN true ELSE list_contains(tags, t) OR (analysis_mode='grooming' AND list_contains(cur, t)) END), ',') AS tags
        FROM (SELECT id, tags, cur, analysis_mode, list_filter(u, lambda x, i: NOT list_contains(u[1:i-1], x)) AS every FROM (
          SELECT id, tags, cur, analysis_mode, list_concat(cur, tags, CASE WHEN id%5=0 THEN ['toxic'] ELSE [] END, CASE WHEN id%7=0 THEN ['extra'] ELSE [] END) AS u FROM (
            SELECT *, ['tag' || (document_id%4), 'Quality'] AS cur FROM suggestion)))"""
    ),
)
def final_tags(spark, sf):
    i = F.col("id")
    override = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(i % 3 == 0, F.struct(F.lit("Quality").alias("k"), F.lit(False).alias("v"))),
                F.when(i % 5 == 0, F.struct(F.lit("toxic").alias("k"), F.lit(True).alias("v"))),
                F.when(i % 7 == 0, F.struct(F.lit("extra").alias("k"), F.lit(True).alias("v"))),
            )
        )
    )
    s = D.suggestion(spark, sf).withColumns(
        {"cur": F.array(F.concat(F.lit("tag"), F.col("document_id") % 4), F.lit("Quality")), "ov": override}
    )
    tags = G.final_tags(F.col("cur"), F.col("tags"), F.col("ov"), F.col("analysis_mode") == "grooming")
    return s.select("id", F.array_join(tags, ",").alias("tags"))


RESOLVED_NAMES = """
SELECT s.id, s.document_id, coalesce(t.ids, []) AS ids, c.entity_id AS correspondent_id, d.entity_id AS document_type_id, p.entity_id AS storage_path_id
FROM suggestion s
LEFT JOIN (SELECT id, list(entity_id ORDER BY pos) AS ids FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags,1) AS pos FROM suggestion)
  JOIN entity e ON e.entity_type='tag' AND lower(e.name)=lower(tag) AND tag<>'' GROUP BY id) t ON t.id=s.id
LEFT JOIN entity c ON c.entity_type='correspondent' AND lower(c.name)=lower(s.correspondent)
LEFT JOIN entity d ON d.entity_type='document_type' AND lower(d.name)=lower(s.document_type)
LEFT JOIN entity p ON p.entity_type='storage_path' AND lower(p.name)=lower(s.storage_path)"""
ALLOW = {"tag": True, "correspondent": True, "document_type": False, "storage_path": True}


@query(
    "resolve_entity_ids",
    with_(
        """SELECT r.id, array_to_string(list_filter(u, lambda x, i: NOT list_contains(u[1:i-1], x)), ',') AS tag_ids,
        correspondent_id, document_type_id, storage_path_id FROM (
        SELECT r.*, list_concat(coalesce(d.tag_ids, []), r.ids) AS u FROM resolved_names r LEFT JOIN document d USING (document_id)) r""",
        resolved_names=RESOLVED_NAMES,
    ),
)
def resolve_entity_ids(spark, sf):
    resolved, _ = G.resolve_entities(D.suggestion(spark, sf), D.entity(spark, sf), ALLOW)
    merged = G.merge_tags(resolved, D.document(spark, sf))
    return merged.select(
        "id", F.array_join(F.col("tag_ids").cast("array<string>"), ",").alias("tag_ids"), "correspondent_id", "document_type_id", "storage_path_id"
    )


@query(
    "entities_to_create",
    with_(
        """SELECT entity_type, min(name) AS name FROM (
        SELECT 'tag' AS entity_type, unnest(tags) AS name FROM suggestion UNION ALL SELECT 'correspondent', correspondent FROM suggestion
        UNION ALL SELECT 'storage_path', storage_path FROM suggestion) n WHERE name<>''
        AND NOT EXISTS (SELECT 1 FROM entity e WHERE e.entity_type=n.entity_type AND lower(e.name)=lower(n.name)) GROUP BY entity_type, lower(name)"""
    ),
)
def entities_to_create(spark, sf):
    return G.resolve_entities(D.suggestion(spark, sf), D.entity(spark, sf), ALLOW)[1]


def _raw_values(spark, sf):
    """Custom-field texts in several spellings, with a data type each."""
    i, v = F.col("event_id"), F.col("value")
    text = (
        F.when(i % 6 == 0, F.concat(F.lit(" "), F.replace(v.cast("string"), F.lit("."), F.lit(",")), F.lit(" ")))
        .when(i % 6 == 1, v.cast("string"))
        .when(i % 6 == 2, F.lit("Yes"))
        .when(i % 6 == 3, F.concat(F.lit("about "), F.floor(v)))
        .when(i % 6 == 4, F.concat(F.lit("-"), F.floor(v), F.lit(".75")))
        .otherwise(F.get(F.array(F.lit("12d"), F.lit("12f"), F.lit("1e7"), F.lit(None)), (i % 4).cast("int")))
    )
    kinds = F.array(*[F.lit(k) for k in ("monetary", "integer", "float", "boolean", "string")])
    return D.table(spark, sf, "events").select("event_id", text.alias("value"), F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("data_type"))


@query(
    "coerce_custom_field",
    """SELECT event_id, data_type, value AS given, CASE data_type
      WHEN 'monetary' THEN coalesce(printf('%.2f', TRY_CAST(replace(trim(value), ',', '.') AS DOUBLE)), value)
      WHEN 'integer' THEN coalesce(trunc(TRY_CAST(trim(value) AS DOUBLE))::BIGINT::VARCHAR, value)
      WHEN 'float' THEN coalesce(TRY_CAST(trim(value) AS DOUBLE)::VARCHAR, value)
      WHEN 'boolean' THEN CASE WHEN value IS NOT NULL THEN (lower(value) IN ('true','1','yes','on'))::VARCHAR END ELSE value END AS coerced FROM (
      SELECT event_id, CASE event_id%6 WHEN 0 THEN ' ' || replace(value::VARCHAR, '.', ',') || ' ' WHEN 1 THEN value::VARCHAR WHEN 2 THEN 'Yes'
        WHEN 3 THEN 'about ' || floor(value)::BIGINT WHEN 4 THEN '-' || floor(value)::BIGINT || '.75' ELSE ['12d','12f','1e7',NULL][event_id%4+1] END AS value,
        ['monetary','integer','float','boolean','string'][user_id%5+1] AS data_type FROM events)""",
)
def coerce_custom_field(spark, sf):
    raw = _raw_values(spark, sf)
    return raw.select("event_id", "data_type", F.col("value").alias("given"), G.coerce_value(F.col("value"), F.col("data_type")).alias("coerced"))


@query(
    "resolve_custom_fields",
    with_(
        """SELECT id, field_id, CASE coalesce(data_type,'string') WHEN 'monetary' THEN printf('%.2f', cf_value::DOUBLE) WHEN 'integer' THEN trunc(cf_value::DOUBLE)::BIGINT::VARCHAR
          WHEN 'float' THEN cf_value WHEN 'boolean' THEN (cf_value IN ('1'))::VARCHAR ELSE cf_value END AS value
        FROM suggestion JOIN custom_field ON lower(name)=lower(cf_name)"""
    ),
)
def resolve_custom_fields(spark, sf):
    return G.resolve_custom_fields(D.suggestion(spark, sf), D.custom_field(spark, sf))


@query(
    "creation_permissions",
    """SELECT c_custkey AS policy_id, entity_type, may_create FROM (
      SELECT c_custkey, unnest(['tags','correspondents','document_types','storage_paths','custom_fields']) AS entity_type,
        unnest([c_custkey%2=0, c_custkey%3=0, c_custkey%5=0, coalesce(c_custkey%7=0 AND c_custkey%4>0, false), false]) AS may_create FROM customer)""",
)
def creation_permissions(spark, sf):
    k = F.col("c_custkey")
    pick = lambda n: F.when(k % n == 0, "allow_new").otherwise("existing_only")
    policies = D.table(spark, sf, "customer").select(
        k.alias("policy_id"), pick(2).alias("tags_policy"), pick(3).alias("correspondents_policy"), pick(5).alias("document_types_policy"),
        F.when(k % 4 > 0, pick(7)).alias("storage_paths_policy"),
    )
    return G.creation_permissions(policies)


# --- audit -----------------------------------------------------------------------------------


@query(
    "record_changes",
    with_(
        """SELECT document_id, change_source, field_name, previous_value, new_value, 'field_change' AS action_type, '2024-06-01 00:00:00' AS changed_at FROM (
        SELECT document_id, change_source, 'title' AS field_name, previous_value, new_value FROM audit
        UNION ALL SELECT document_id, change_source, 'tags', new_value, new_value FROM audit)"""
    ),
)
def record_changes(spark, sf):
    pair = lambda a, b: F.struct(F.col(a).alias("previous"), F.col(b).alias("new"))
    changes = D.audit(spark, sf).select(
        "document_id",
        "change_source",
        F.create_map(F.lit("title"), pair("previous_value", "new_value"), F.lit("tags"), pair("new_value", "new_value")).alias("changes"),
    )
    out = H.record_changes(changes, D.ntz(NOW))
    return out.withColumn("changed_at", D.stamp("changed_at"))


@query(
    "record_event",
    with_(
        """SELECT CASE WHEN id%4=0 THEN 0 ELSE document_id END AS document_id, action_type, change_source, new_value, '_event' AS field_name, NULL::VARCHAR AS previous_value
        FROM audit"""
    ),
)
def record_event(spark, sf):
    events = D.audit(spark, sf).select(
        F.when(F.col("id") % 4 > 0, F.col("document_id")).alias("document_id"), "action_type", "change_source", "new_value"
    )
    return H.record_events(events)


WHERE_SQL = "changed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND action_type='click' AND document_title ILIKE '%PORT 1%'"


def _audit_query(spark, sf):
    return H.query(
        D.audit(spark, sf), date_from=D.ntz("2024-01-05 00:00:00"), date_to=D.ntz("2024-01-25 00:00:00"),
        action_type="click", title_pattern="PORT 1",
    )


@query(
    "audit_query",
    with_(
        f"""SELECT id, document_id, field_name, {AT.format('changed_at')} AS changed_at, (SELECT count(*) FROM audit WHERE {WHERE_SQL}) AS total
        FROM audit WHERE {WHERE_SQL} ORDER BY audit.changed_at DESC, id LIMIT 50 OFFSET 50"""
    ),
)
def audit_query(spark, sf):
    hits = _audit_query(spark, sf)
    rows = S.page(hits, [F.desc("changed_at"), F.col("id")], 2, 50)
    return rows.select("id", "document_id", "field_name", D.stamp("changed_at").alias("changed_at"), S.total(hits).scalar().alias("total"))


@query(
    "audit_retention",
    with_(f"SELECT id, {AT.format('changed_at')} AS changed_at FROM audit WHERE changed_at >= TIMESTAMP '2024-03-15 12:00:00' - INTERVAL 60 DAY"),
)
def audit_retention(spark, sf):
    kept = H.retain(D.audit(spark, sf), D.ntz("2024-03-15 12:00:00"), 60)
    return kept.select("id", D.stamp("changed_at").alias("changed_at"))


@query(
    "audit_export",
    with_(
        """SELECT id, document_id, document_title, field_name, previous_value, new_value, change_source, action_type, session_id,
        strftime(changed_at, '%Y-%m-%dT%H:%M:%S.%f') AS changed_at, suggestion_id FROM audit ORDER BY audit.changed_at DESC, id DESC LIMIT 100000"""
    ),
)
def audit_export(spark, sf):
    return H.export_rows(D.audit(spark, sf), 100_000)


# --- access -----------------------------------------------------------------------------------


def _users(spark, sf):
    k = F.col("c_custkey")
    return D.table(spark, sf, "customer").select(
        F.col("c_name").alias("username"),
        F.when(k % 9 > 0, k % 10 == 0).alias("admin"),
        *[F.when(k % 8 != n, k % (n + 2) == 0).alias(f) for n, f in enumerate(K.FLAGS)],
    )


def _flags(groom: str) -> str:
    cols = []
    for n, f in enumerate(K.FLAGS):
        value = f"(coalesce(CASE WHEN c_custkey%8<>{n} THEN c_custkey%{n + 2}=0 END, false) OR coalesce(CASE WHEN c_custkey%9>0 THEN c_custkey%10=0 END, false))"
        cols.append(f"{value}{groom if f == 'can_groom' else ''} AS {f}")
    return ", ".join(cols)


@query(
    "effective_permissions",
    f"SELECT c_name AS username, CASE WHEN c_custkey%9>0 THEN c_custkey%10=0 END AS admin, {_flags(' AND false')} FROM customer",
)
def effective_permissions(spark, sf):
    return K.effective_permissions(_users(spark, sf), sync_admins=True, grooming_enabled=False)


@query(
    "merged_users",
    f"""SELECT c_name AS username, CASE WHEN c_custkey%9>0 THEN c_custkey%10=0 END AS admin, {_flags('')}, true AS has_record FROM customer
    UNION ALL SELECT DISTINCT s_name, s_suppkey%4=0 OR s_suppkey%6=1, {', '.join('false' for _ in K.FLAGS)}, false FROM supplier WHERE s_nationkey<>3""",
)
def merged_users(spark, sf):
    listed = D.table(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") != 3, F.col("s_name")).otherwise("").alias("username"),
        (F.col("s_suppkey") % 4 == 0).alias("is_superuser"),
        (F.col("s_suppkey") % 6 == 1).alias("is_staff"),
    )
    users = _users(spark, sf)
    both = listed.unionByName(users.select("username", F.lit(True).alias("is_superuser"), F.lit(False).alias("is_staff")))
    return K.merged_users(users, both, sync_admins=True)

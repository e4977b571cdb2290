import random

from pyspark.sql import functions as F

from foliant.operators import queue as G


def simulate(suggestions, decisions, supersede):
    """Decisions walked one by one."""
    status = {s: st for s, _, st in suggestions}
    doc = {s: d for s, d, _ in suggestions}
    outcomes, events = {}, []
    for n, s, verdict in sorted(decisions):
        if s not in status:
            outcomes[n] = "not_found"
        elif verdict == "reject":
            outcomes[n] = {"pending": "rejected", "rejected": "no_op", "approved": "error"}[status[s]]
            if status[s] == "pending":
                status[s] = "rejected"
                events.append((s, f"suggestion:{s}"))
        elif status[s] != "pending":
            outcomes[n] = "error"
        else:
            outcomes[n], status[s] = "approved", "approved"
            events.append((s, f"suggestion:{s}"))
            if supersede:
                for other in status:
                    if other != s and doc[other] == doc[s] and status[other] == "pending":
                        status[other] = "rejected"
                        events.append((other, f"superseded_by:{s}"))
    return outcomes, status, sorted(events)


def test_decide_equals_sequential(spark):
    rng = random.Random(8)
    suggestions = [(i, rng.choice([1, 1, 1, *range(2, 60)]), rng.choice(["pending"] * 4 + ["approved", "rejected"])) for i in range(400)]
    decisions = [(n, rng.randrange(420), rng.choice(["approve", "reject"])) for n in range(700)]
    s = spark.createDataFrame(suggestions, "id long, document_id long, status string").selectExpr(
        "*", "'t' title", "array('a') tags", "'c' correspondent", "'d' document_type", "CAST(NULL AS STRING) storage_path",
        "map('k', 'v') custom_fields", "'grooming' analysis_mode",
        "array(named_struct('action', 'add', 'entity_type', 'tag', 'entity_id', id, 'replacement_entity_id', CAST(NULL AS BIGINT))) actions",
    )
    d = spark.createDataFrame(decisions, "decision_id long, suggestion_id long, verdict string").selectExpr(
        "*", "'user:x' change_source", "timestamp'2024-01-01' decided_at"
    )
    for supersede in (True, False):
        outcomes, status, events = simulate(suggestions, decisions, supersede)
        got = G.decide(s, d, supersede)
        assert {r.decision_id: r.outcome for r in got.outcomes.collect()} == outcomes
        assert {r.id: r.status for r in got.suggestions.collect()} == status
        assert sorted((r.suggestion_id, r.new_value) for r in got.audit.collect()) == events
        rejected = {s for n, s, v in decisions if outcomes[n] == "rejected"}
        assert {r.entity_id for r in got.dismissals.collect()} == rejected
    assert G.decide(s, d, True, record_dismissals=False).dismissals.count() == 0


def test_edits_and_content(spark):
    s = spark.sql(
        """SELECT 1L id, 7L document_id, 'pending' status, 'T' title, array('a') tags, 'c' correspondent, CAST(NULL AS STRING) document_type,
        CAST(NULL AS STRING) storage_path, map('k','v') custom_fields, 'ocr' analysis_mode, array(named_struct('action','x','entity_type','tag','entity_id',1L,'replacement_entity_id',1L)) actions,
        repeat('n', 600) extracted_content, '' original_content"""
    )
    d = spark.sql(
        """SELECT 5L decision_id, 1L suggestion_id, 'approve' verdict, 'user:x' change_source, timestamp'2024-01-01' decided_at,
        'T' edit_title, array('a', 'é"') edit_tags, CAST(NULL AS STRING) edit_correspondent, map('k','w') edit_custom_fields, true apply_content"""
    )
    got = G.decide(s, d)
    changes = {r.field_name: (r.previous_value, r.new_value) for r in got.audit.where("action_type = 'field_change'").collect()}
    assert changes == {
        "tags": ('["a"]', '["a", "é\\""]'),
        "custom_fields": ('{"k": "v"}', '{"k": "w"}'),
        "content": (None, "n" * 500),
    }
    row = got.suggestions.first()
    assert (row.status, row.tags, row.correspondent, row.custom_fields) == ("approved", ["a", 'é"'], "c", {"k": "w"})


def test_coerce(spark):
    cases = [
        ("monetary", "1,5", "1.50"), ("monetary", "EUR 5", "EUR 5"), ("monetary", None, None), ("integer", "-2.9", "-2"),
        ("integer", "NaN", "NaN"), ("integer", "x", "x"), ("float", " 3 ", "3.0"), ("boolean", "ON", "true"),
        ("boolean", "2", "false"), ("date", "2024-1-1", "2024-1-1"),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i long, k string, v string")
    got = {r.i: r.c for r in df.select("i", G.coerce_value(F.col("v"), F.col("k")).alias("c")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}

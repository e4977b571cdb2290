"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, B, TS, D = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _list(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


TEXT_MAP = T.MapType(S, S)
VECTOR = T.ArrayType(T.FloatType())

DOCUMENT = _table(
    document_id=L, title=S, content=S, tag_ids=_list(L), correspondent_id=L, document_type_id=L,
    custom_fields=_list(_table(field=L, value=S)), created=TS, added=TS, modified=TS,
)
ENTITY = _table(entity_type=S, entity_id=L, name=S, document_count=L)
CUSTOM_FIELD = _table(field_id=L, name=S, data_type=S)
CHUNK = _table(
    document_id=L, chunk_index=L, total_chunks=L, chunk_id=S, passage=S, title=S, tags=_list(S),
    tag_ids=_list(L), correspondent=S, document_type=S, custom_fields=TEXT_MAP, vector=VECTOR,
)
# The layout of older stores: lists and maps kept as JSON text.
LEGACY_CHUNK = _table(
    id=S, vector=VECTOR, document=S, document_id=L, title=S, tags_json=S, tag_ids_json=S,
    correspondent=S, document_type=S, custom_fields_json=S, chunk_index=L, total_chunks=L,
)
SPARSE_TERM = _table(document_id=L, chunk_index=L, term=S, tf=L)
SEARCH_RESULT = _table(
    query_id=L, document_id=L, document_title=S, passage=S, score=D, deeplink_url=S, rank=L
)
ACTION = _table(
    action=S, entity_type=S, entity_id=L, entity_name=S, score=D, cohort_percentile=D, reason=S,
    best_passage=S, replacement_entity_id=L, replacement_entity_name=S, replacement_score=D,
)
SUGGESTION = _table(
    id=S, document_id=L, status=S, created_at=TS, title=S, tags=_list(S), correspondent=S,
    document_type=S, storage_path=S, custom_fields=TEXT_MAP, provider=S, model=S,
    analysis_mode=S, prompt_used=S, raw_response=S, extracted_content=S, original_content=S,
    evidence=_table(actions=_list(ACTION), base_tags=_list(S), scanned_at=TS),
)
AUDIT = _table(
    id=S, document_id=L, document_title=S, field_name=S, previous_value=S, new_value=S,
    change_source=S, action_type=S, session_id=S, changed_at=TS, suggestion_id=S,
)
TRACKING = _table(
    document_id=L, first_seen_at=TS, last_analyzed_at=TS, embedding_stored=B,
    reembed_dirty_since=TS, last_embedded_at=TS,
)
ENTITY_STATE = _table(
    entity_type=S, entity_id=L, name=S, description=S, description_source=S, excluded=B,
    vector=VECTOR, embedding_stored=B, embed_model=S, embed_dim=L, description_updated_at=TS,
    last_scanned_at=TS,
)
DISMISSAL = _table(
    entity_type=S, entity_id=L, document_id=L, action=S, other_entity_id=L, dismissed_at=TS
)
TURN = _table(session_id=S, turn_no=L, role=S, content=S, ts=TS)
SUMMARY = _table(session_id=S, summary=S, updated_at=TS)
MEMORY = _table(memory_id=L, text=S, vector=VECTOR, created_at=TS, updated_at=TS, source_session_id=S)
PERMISSION = _table(
    username=S, admin=B, can_access=B, can_view_queue=B, can_approve=B, can_analyze=B,
    can_discover=B, can_settings=B, can_groom=B, updated_at=TS,
)

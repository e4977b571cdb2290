"""Suggestion queue: enqueueing, decisions, resets, display stacks, value resolution.

Suggestions carry ``tags`` and ``custom_fields`` as real arrays and maps and
the evidence actions as ``actions``. Mutations return new rows to append; see
``sources.store`` for how they become the current state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "tags", "correspondent", "document_type", "storage_path", "custom_fields")
CONTENT_CHARS = 500
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with ``new`` added as pending; an id already present is left unchanged.

    Of rows that repeat an id the earliest counts (by ``created_at`` where there is one, then by content).
    """
    order = ["created_at"] * ("created_at" in new.columns) + [c for c in new.columns if not c.startswith("created_at")]
    sortable = [c for c in order if not new.schema[c].dataType.typeName() in ("map", "variant")]
    first = F.min_by(F.struct(*new.columns), F.struct(*sortable)).alias("_first")
    fresh = (
        new.groupBy("id").agg(first).select("_first.*")
        .join(queue.select("id"), "id", "left_anti")
        .withColumn("status", F.lit("pending"))
    )
    return queue.unionByName(fresh.select(*queue.columns))


# --- decisions ----------------------------------------------------------------------


@dataclass(frozen=True)
class Decided:
    """Result of a batch of decisions."""

    outcomes: DataFrame
    suggestions: DataFrame
    audit: DataFrame
    dismissals: DataFrame


def decide(
    suggestions: DataFrame, decisions: DataFrame, supersede: bool = True, record_dismissals: bool = True
) -> Decided:
    """Applies decisions in ``decision_id`` order.

    A pending suggestion takes its first decision. With ``supersede`` the first
    approval of a document also rejects its other pending suggestions, so later
    ones find nothing pending. Rejecting a rejected suggestion is a no-op; any
    other decision on a settled suggestion is an error, reported per row.

    The order is resolved by minima per suggestion and per document, which
    aggregate on the map side, not by walking the decisions of a document.
    """
    asked = decisions.groupBy("suggestion_id").agg(
        F.min(F.when(F.col("verdict") == "approve", F.col("decision_id"))).alias("_approve"),
        F.min(F.when(F.col("verdict") == "reject", F.col("decision_id"))).alias("_reject"),
    )
    state = suggestions.select(F.col("id").alias("suggestion_id"), "document_id", "status").join(
        asked, "suggestion_id", "left"
    )
    pending = F.col("status") == "pending"
    first = F.col("_approve").isNotNull() & (F.col("_reject").isNull() | (F.col("_approve") < F.col("_reject")))
    state = state.withColumn("_candidate", F.when(pending & first, F.col("_approve")))
    if supersede:
        winners = state.where(F.col("_candidate").isNotNull()).groupBy("document_id").agg(
            F.min("_candidate").alias("_winner"), F.min_by("suggestion_id", "_candidate").alias("_winner_id")
        )
        state = state.join(winners, "document_id", "left")
    else:
        state = state.withColumns({"_winner": F.col("_candidate"), "_winner_id": F.when(F.col("_candidate").isNotNull(), F.col("suggestion_id"))})
    wins = F.coalesce(F.col("_winner_id") == F.col("suggestion_id"), F.lit(False))
    # A rejection counts when it comes before the document is resolved.
    own_reject = pending & ~wins & F.col("_reject").isNotNull() & (
        F.col("_winner").isNull() | (F.col("_reject") < F.col("_winner"))
    )
    displaced = pending & ~wins & ~own_reject & F.col("_winner").isNotNull()
    state = state.withColumn(
        "_end", F.when(pending & wins, "approved").when(own_reject, "rejected").when(displaced, "superseded")
    )

    marks = state.select("suggestion_id", "status", "_end", "_winner", "_winner_id", "_candidate", "_reject")
    joined = decisions.join(marks, "suggestion_id", "left")
    verdict = F.col("verdict")
    settled_before = (F.col("status") != "pending") | F.col("_end").isNull()
    outcome = (
        F.when(F.col("status").isNull(), "not_found")
        .when((F.col("_end") == "approved") & (verdict == "approve") & (F.col("decision_id") == F.col("_winner")), "approved")
        .when((F.col("_end") == "rejected") & (verdict == "reject") & (F.col("decision_id") == F.col("_reject")), "rejected")
        .when((F.col("status") == "rejected") & (verdict == "reject"), "no_op")
        .when(~settled_before & F.col("_end").isin("rejected", "superseded") & (verdict == "reject"), "no_op")
        .otherwise("error")
    )
    outcomes = joined.withColumn("outcome", outcome)
    done = outcomes.where(F.col("outcome").isin("approved", "rejected"))
    with_state = suggestions.withColumnRenamed("id", "suggestion_id").join(
        done.drop("status", "_end", "_winner", "_winner_id", "_candidate", "_reject"), "suggestion_id"
    )
    approved = with_state.where(F.col("outcome") == "approved")
    rejected = with_state.where(F.col("outcome") == "rejected")

    superseded = (
        state.where(F.col("_end") == "superseded")
        .join(
            decisions.select(F.col("decision_id").alias("_winner"), "change_source", "decided_at"), "_winner"
        )
        .select("suggestion_id", "document_id", "_winner_id", "change_source", "decided_at")
    )
    titles = approved.select(F.col("suggestion_id").alias("_winner_id"), F.coalesce("title").alias("_title"))
    superseded = superseded.join(titles, "_winner_id", "left")
    audit = (
        _field_changes(approved)
        .unionByName(_events(approved, "approved", F.concat(F.lit("suggestion:"), "suggestion_id"), F.col("title")))
        .unionByName(_events(rejected, "rejected", F.concat(F.lit("suggestion:"), "suggestion_id"), F.col("title")))
        .unionByName(_events(superseded, "rejected", F.concat(F.lit("superseded_by:"), "_winner_id"), F.col("_title")))
    )
    dismissals = grooming_dismissals(rejected if record_dismissals else rejected.limit(0))
    return Decided(
        outcomes.select("decision_id", "suggestion_id", "verdict", "outcome"),
        _settled(suggestions, state, approved),
        audit,
        dismissals,
    )


def _edits(columns: list[str]) -> list[str]:
    return [f for f in FIELDS if f"edit_{f}" in columns]


def _settled(suggestions: DataFrame, state: DataFrame, approved: DataFrame) -> DataFrame:
    """The suggestions with their new status and the approver's edits."""
    fields = _edits(approved.columns)
    edits = approved.select(F.col("suggestion_id").alias("id"), *[f"edit_{f}" for f in fields])
    ends = state.select(F.col("suggestion_id").alias("id"), "_end")
    out = suggestions.join(ends, "id", "left").join(edits, "id", "left")
    status = F.when(F.col("_end") == "superseded", "rejected").otherwise(F.coalesce("_end", "status"))
    return out.withColumns(
        {"status": status, **{f: F.coalesce(f"edit_{f}", f) for f in fields}}
    ).drop("_end", *[f"edit_{f}" for f in fields])


def json_list(values: Column) -> Column:
    """A string list as JSON text with a blank after each comma."""
    quoted = F.transform(values, lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def json_map(values: Column) -> Column:
    quote = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    entries = F.transform(F.map_entries(values), lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def _as_text(field: str, column: str) -> Column:
    if field == "tags":
        return json_list(F.col(column))
    if field == "custom_fields":
        return json_map(F.col(column))
    return F.col(column)


AUDIT = [
    "document_id", "document_title", "field_name", "previous_value", "new_value", "change_source",
    "action_type", "changed_at", "suggestion_id",
]


def _field_changes(approved: DataFrame) -> DataFrame:
    """One row per edited field that differs from the suggested value, and per content write-back."""
    nothing = F.lit(None).cast("struct<field_name:string,previous_value:string,new_value:string>")
    changes = [nothing]
    for field in _edits(approved.columns):
        edited = f"edit_{field}"
        differs = (
            ~_as_text(field, edited).eqNullSafe(_as_text(field, field))
            if field == "custom_fields"
            else ~F.col(edited).eqNullSafe(F.col(field))
        )
        changes.append(
            F.when(
                F.col(edited).isNotNull() & differs,
                F.struct(
                    F.lit(field).alias("field_name"),
                    _as_text(field, field).alias("previous_value"),
                    _as_text(field, edited).alias("new_value"),
                ),
            )
        )
    if {"apply_content", "extracted_content", "original_content"} <= set(approved.columns):
        short = lambda c: F.substring(c, 1, CONTENT_CHARS)
        written = F.col("apply_content") & (F.length("extracted_content") > 0)
        changes.append(
            F.when(
                written,
                F.struct(
                    F.lit("content").alias("field_name"),
                    F.nullif(short("original_content"), F.lit("")).alias("previous_value"),
                    short("extracted_content").alias("new_value"),
                ),
            )
        )
    rows = approved.withColumn("_c", F.explode(F.array_compact(F.array(*changes))))
    return rows.select(
        "document_id",
        F.col("title").alias("document_title"),
        "_c.field_name",
        "_c.previous_value",
        "_c.new_value",
        "change_source",
        F.lit("field_change").alias("action_type"),
        F.col("decided_at").alias("changed_at"),
        "suggestion_id",
    )


def _events(rows: DataFrame, action_type: str, value: Column, title: Column) -> DataFrame:
    return rows.select(
        "document_id",
        title.alias("document_title"),
        F.lit("_event").alias("field_name"),
        F.lit(None).cast("string").alias("previous_value"),
        value.alias("new_value"),
        "change_source",
        F.lit(action_type).alias("action_type"),
        F.col("decided_at").alias("changed_at"),
        "suggestion_id",
    )


def grooming_dismissals(rejected: DataFrame) -> DataFrame:
    """One dismissal per evidence action of a rejected grooming suggestion."""
    rows = rejected.where(F.col("analysis_mode") == "grooming").select(
        "document_id", "decided_at", F.explode("actions").alias("_a")
    )
    return rows.where(F.col("_a.entity_id").isNotNull()).select(
        F.coalesce("_a.entity_type", F.lit("")).alias("entity_type"),
        F.col("_a.entity_id").alias("entity_id"),
        "document_id",
        F.coalesce("_a.action", F.lit("")).alias("action"),
        F.col("_a.replacement_entity_id").alias("other_entity_id"),
        F.col("decided_at").alias("dismissed_at"),
    )


def empty_queue(suggestions: DataFrame, change_source: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Rejects everything pending without recording dismissals: (suggestions, audit rows)."""
    pending = suggestions.where(F.col("status") == "pending").select(
        F.col("id").alias("suggestion_id"),
        "document_id",
        "title",
        F.lit(change_source).alias("change_source"),
        at.alias("decided_at"),
    )
    audit = _events(pending, "rejected", F.concat(F.lit("suggestion:"), "suggestion_id"), F.col("title"))
    status = F.when(F.col("status") == "pending", "rejected").otherwise(F.col("status"))
    return suggestions.withColumn("status", status), audit


def reset_rejected(suggestions: DataFrame, tracking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops rejected suggestions and the tracking of their documents."""
    rejected = suggestions.where(F.col("status") == "rejected").select("document_id").distinct()
    return (
        suggestions.where(F.col("status") != "rejected"),
        tracking.join(rejected, "document_id", "left_anti"),
    )


def reset_tracking(tracking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty tracking table, and how many rows were cleared."""
    return tracking.limit(0), tracking.agg(F.count(F.lit(1)).alias("cleared"))


def reanalyze_swap(suggestions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replaces analysed suggestions: the old one is rejected only where the new one succeeded.

    ``fresh`` has the suggestion columns plus ``old_id`` and ``error``.
    """
    good = fresh.where(F.col("error").isNull())
    swapped = good.select(F.col("old_id").alias("id")).distinct().withColumn("_swap", F.lit(True))
    old = suggestions.join(swapped, "id", "left").withColumn(
        "status",
        F.when(F.col("_swap") & (F.col("status") == "pending"), "rejected").otherwise(F.col("status")),
    )
    return enqueue(old.drop("_swap"), good.drop("old_id", "error"))


def queue_stats(suggestions: DataFrame, tracking: DataFrame) -> DataFrame:
    tracked = tracking.agg(F.count(F.lit(1)).alias("n"))
    return suggestions.agg(
        *[F.count_if(F.col("status") == s).alias(f"suggestions_{s}") for s in ("pending", "approved", "rejected")]
    ).withColumn("tracked_documents", tracked.scalar())


def eligible_documents(docs: DataFrame, inbox_tag: int | None) -> DataFrame:
    """Number of documents outside the inbox, the denominator of the indexing progress."""
    from foliant.sources.documents import has_tag

    return docs.agg(F.count_if(~has_tag(inbox_tag)).alias("eligible"))


# --- display --------------------------------------------------------------------------------


def _field_key(field: str) -> Column:
    if field == "tags":
        return F.coalesce(F.to_json(F.array_sort(F.coalesce("tags", F.array().cast("array<string>")))), F.lit("[]"))
    if field == "custom_fields":
        return F.to_json(F.coalesce("custom_fields", F.create_map().cast("map<string,string>")))
    return F.coalesce(F.to_json(F.struct(F.col(field).alias("v"))), F.lit("{}"))


def stack_suggestions(suggestions: DataFrame) -> DataFrame:
    """Identical suggestions of a document as one row: the newest id, its time, ``copies``, ``varying``.

    ``varying`` lists the fields that differ within the document. Everything is
    a plain aggregate, so a document with very many suggestions still combines
    on the map side; no list per document is built.
    """
    keys = {f"_{f}": _field_key(f) for f in FIELDS}
    keyed = suggestions.withColumns(keys)
    newest = F.struct("created_at", "id")
    stacks = keyed.groupBy("document_id", *keys).agg(
        F.max_by(newest, newest).alias("_n"), F.count(F.lit(1)).alias("copies")
    )
    varying = [
        F.when(F.min(f"_{f}") != F.max(f"_{f}"), F.lit(f)) for f in FIELDS
    ]
    per_doc = stacks.groupBy("document_id").agg(F.array_compact(F.array(*varying)).alias("varying"))
    return stacks.join(per_doc, "document_id").select(
        "document_id", F.col("_n.id").alias("id"), F.col("_n.created_at").alias("created_at"), "copies", "varying"
    )


def final_tags(
    current: Column, suggested: Column, overrides: Column, keep_current: Column
) -> Column:
    """Tags an approval would write, in order of first appearance.

    ``overrides`` maps a tag to true (keep or add) or false (drop) and wins;
    otherwise a suggested tag is kept, and a current one when ``keep_current``.
    """
    forced = F.map_keys(F.map_filter(overrides, lambda _, on: on))
    every = F.array_distinct(F.concat(current, suggested, forced))
    return F.filter(
        every,
        lambda t: F.coalesce(
            F.try_element_at(overrides, t),
            F.array_contains(suggested, t) | (keep_current & F.array_contains(current, t)),
        ),
    )


# --- resolving names for writing --------------------------------------------------------------


def creation_permissions(policies: DataFrame) -> DataFrame:
    """(policy_id, entity_type, may_create): one row per type, custom fields never.

    ``policies`` has a policy column per type; each type follows only its own.
    """
    kinds = ("tags", "correspondents", "document_types", "storage_paths")
    flags = [
        F.struct(F.lit(k).alias("entity_type"), F.coalesce(F.col(f"{k}_policy") == "allow_new", F.lit(False)).alias("may_create"))
        for k in kinds
    ]
    flags.append(F.struct(F.lit("custom_fields").alias("entity_type"), F.lit(False).alias("may_create")))
    return policies.select("policy_id", F.explode(F.array(*flags)).alias("_f")).select("policy_id", "_f.*")


SINGLE = ("correspondent", "document_type", "storage_path")


def resolve_entities(suggestions: DataFrame, entities: DataFrame, may_create: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """Names to ids, ignoring case: (id, tag_ids, *_id) and the names to create.

    An unknown name is listed for creation when its type allows it and dropped
    otherwise. ``tag_ids`` is NULL for NULL tags and empty for an empty list.
    """
    dim = (
        entities.where(F.col("name") != "")
        .groupBy("entity_type", F.lower("name").alias("_key"))
        .agg(F.max("entity_id").alias("entity_id"))
    )
    item = lambda kind, pos, name: F.struct(F.lit(kind).alias("entity_type"), pos.alias("pos"), name.alias("name"))
    listed = F.concat(
        F.coalesce(F.transform("tags", lambda t, i: item("tag", i, t)), F.array().cast("array<struct<entity_type:string,pos:int,name:string>>")),
        F.array(*[item(k, F.lit(0), F.col(k)) for k in SINGLE]),
    )
    names = (
        suggestions.select("id", F.explode(listed).alias("_n"))
        .select("id", "_n.*")
        .where(F.coalesce(F.col("name") != "", F.lit(False)))
        .withColumn("_key", F.lower("name"))
        .join(dim, ["entity_type", "_key"], "left")
    )
    known = names.where(F.col("entity_id").isNotNull())
    tag = F.when(F.col("entity_type") == "tag", F.struct("pos", "entity_id"))
    ids = known.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(tag)), lambda s: s["entity_id"]).alias("_tags"),
        *[F.max(F.when(F.col("entity_type") == k, F.col("entity_id"))).alias(f"{k}_id") for k in SINGLE],
    )
    resolved = (
        suggestions.select("id", "document_id", "tags")
        .join(ids, "id", "left")
        .withColumn(
            "tag_ids",
            F.when(F.col("tags").isNotNull(), F.coalesce("_tags", F.array().cast("array<bigint>"))),
        )
        .drop("_tags", "tags")
    )
    allowed = [k for k, ok in may_create.items() if ok]
    create = (
        names.where(F.col("entity_id").isNull() & F.col("entity_type").isin(allowed))
        .groupBy("entity_type", "_key")
        .agg(F.min("name").alias("name"))
        .drop("_key")
    )
    return resolved, create


def merge_tags(resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """Existing tag ids first, then the suggested ones, each once."""
    existing = docs.select("document_id", F.col("tag_ids").alias("_old"))
    merged = F.array_distinct(F.concat(F.coalesce("_old", F.array().cast("array<bigint>")), "tag_ids"))
    return resolved.join(existing, "document_id", "left").withColumn("tag_ids", merged).drop("_old")


def _number(text: Column) -> Column:
    """The number that ``text`` spells, NULL if it is none; type suffixes as in 12d are not part of a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _plain(number: Column) -> Column:
    """Decimal notation, one digit after the point at least, as far as 38 digits hold it."""
    digits = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    exponent = number.cast("string").contains("E") & (F.abs(number) < 1e18) & (F.abs(number) >= 1e-3)
    return F.when(exponent, plain).otherwise(number.cast("string"))


def coerce_value(value: Column, data_type: Column) -> Column:
    """Custom-field text in the form the archive expects; what cannot be read stays as given."""
    text = F.trim(value)
    money = _number(F.replace(text, F.lit(","), F.lit(".")))
    number = _number(text)
    finite = F.abs(number) < 9e18  # false for infinities, NULL or false for what is not a number
    truncated = F.when(finite & ~F.isnan(number), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
    truncated = truncated.cast("string")
    truth = F.lower(value).isin("true", "1", "yes", "on").cast("string")
    return (
        F.when(data_type == "monetary", F.coalesce(F.when(money.isNotNull(), F.format_string("%.2f", money)), value))
        .when(data_type == "integer", F.coalesce(truncated, value))
        .when(data_type == "float", F.coalesce(_plain(number), value))
        .when(data_type == "boolean", truth)
        .otherwise(value)
    )


def resolve_custom_fields(suggestions: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, field_id, value): custom fields by case-insensitive name, values coerced; unknown ones dropped."""
    dim = definitions.groupBy(F.lower("name").alias("_key")).agg(
        F.max_by(F.struct("field_id", F.coalesce("data_type", F.lit("string")).alias("data_type")), "field_id").alias("_d")
    )
    entries = suggestions.select("id", F.explode("custom_fields").alias("_name", "_value"))
    joined = entries.withColumn("_key", F.lower("_name")).join(dim, "_key")
    value = F.when(F.col("_value").isNotNull(), coerce_value(F.col("_value"), F.col("_d.data_type")))
    return joined.select("id", F.col("_d.field_id").alias("field_id"), value.alias("value"))

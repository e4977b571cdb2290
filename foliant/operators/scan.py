"""Mismatch scan: which documents should gain, lose or change an entity.

Entities: (entity_type, entity_id, name, vector); chunks: ``schemas.CHUNK``;
assignments: (entity_type, entity_id, document_id) from the document table,
which is the truth; the chunk payload is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.ranking import blocked_row_number
from foliant.functions.vectors import cosine, on_grid, unit_score
from foliant.operators.retrieval import POINT, nearest, with_payload
from foliant.session import broadcast_if_small, cut

KEY = ["entity_type", "entity_id"]
PAIR = [*KEY, "document_id"]
SINGLE_VALUED = ("correspondent", "document_type")
MIN_COHORT = 10
EVIDENCE_CHARS = 300


@dataclass(frozen=True)
class ScanParams:
    top_k: int = 100
    add: float = 0.80
    remove: float = 0.35
    percentile: int = 10
    min_chunks: int = 2
    max_suggestions: int | None = None


# --- which entities -----------------------------------------------------------------


def eligible(state: DataFrame, inbox_tag: int | None) -> DataFrame:
    """Entities to scan: not excluded, not the inbox tag, with a stored vector."""
    is_inbox = (F.col("entity_type") == "tag") & (F.col("entity_id") == F.lit(inbox_tag).cast("long"))
    return state.where(
        ~F.coalesce("excluded", F.lit(False))
        & ~F.coalesce(is_inbox, F.lit(False))
        & F.col("embedding_stored")
        & F.col("vector").isNotNull()
    )


def needs_rescan(state: DataFrame, tracking: DataFrame) -> DataFrame:
    """Entities never scanned, described since, or older than the newest re-embed of any document."""
    latest = tracking.agg(F.max("last_embedded_at")).scalar()
    marked = state.withColumn("_latest", latest)
    newer = lambda c: F.coalesce(F.col(c) > F.col("last_scanned_at"), F.lit(False))
    return marked.where(
        F.col("last_scanned_at").isNull() | newer("description_updated_at") | newer("_latest")
    ).drop("_latest")


# --- evidence -------------------------------------------------------------------------


def assignments(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, entity_id, document_id) of the given entities, from the document table."""
    parts = []
    if "tag_ids" in docs.columns:
        parts.append(
            docs.select(F.lit("tag").alias("entity_type"), F.explode(F.array_distinct("tag_ids")).alias("entity_id"), "document_id")
        )
    for kind in SINGLE_VALUED:
        if f"{kind}_id" in docs.columns:
            parts.append(
                docs.where(F.col(f"{kind}_id").isNotNull()).select(
                    F.lit(kind).alias("entity_type"), F.col(f"{kind}_id").alias("entity_id"), "document_id"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(entities.select(*KEY), KEY, "left_semi")


def scan_hits(chunks: DataFrame, entities: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` best chunks of every entity, all entities in one scan of the chunk table."""
    hits = nearest(chunks.where(F.col("document_id") != 0), entities, top_k, tuple(KEY))
    payload = [c for c in ("passage", "title", *SINGLE_VALUED) if c in chunks.columns]
    return with_payload(hits, chunks, *payload)


def scan_scores(hits: DataFrame, add: float) -> DataFrame:
    """Per (entity, document): best score with its passage and title, and supporting chunks.

    ``payload_name`` is the single-valued name carried by the last chunk seen.
    """
    first = F.struct(F.col("score"), -F.col("rank"))
    payload = F.when(F.col("entity_type") == "correspondent", F.col("correspondent")).when(
        F.col("entity_type") == "document_type", F.col("document_type")
    )
    return (
        hits.withColumn("_payload", F.coalesce(payload, F.lit("")))
        .groupBy(*PAIR)
        .agg(
            F.max("score").alias("score"),
            F.max_by(F.substring("passage", 1, EVIDENCE_CHARS), first).alias("best_passage"),
            F.max_by("title", first).alias("title"),
            F.count_if(F.col("score") >= add).alias("supporting"),
            F.max_by("_payload", "rank").alias("payload_name"),
        )
    )


def cohort_scores(chunks: DataFrame, entities: DataFrame, assigned: DataFrame) -> DataFrame:
    """(entity, document, score) for every assigned document, scored among its own cohort.

    Chunks meet entities by an equi-join on what the payload carries (tag id
    or name), so the work is linear in the chunk table. A document's best chunk
    that carries the entity counts; a document without one scores 0.
    """
    with_cohort = assigned.select(*KEY).distinct()
    wanted = entities.select(*KEY, "name", F.col("vector").alias("_ev")).join(with_cohort, KEY, "left_semi")
    wanted = broadcast_if_small(cut(wanted))
    base = chunks.where(F.col("vector").isNotNull() & (F.col("document_id") != 0))
    carried = [F.transform(F.array_distinct("tag_ids"), lambda t: _use("tag", t.cast("string")))]
    carried += [F.array(_use(kind, F.col(kind))) for kind in SINGLE_VALUED if kind in chunks.columns]
    uses = base.select(*POINT, "vector", F.explode(F.concat(*carried)).alias("_u")).select(
        *POINT, "vector", "_u.entity_type", "_u._ref"
    )
    named = wanted.withColumn(
        "_ref", F.when(F.col("entity_type") == "tag", F.col("entity_id").cast("string")).otherwise(F.col("name"))
    )
    scored = uses.join(named, ["entity_type", "_ref"]).select(
        *PAIR, on_grid(cosine("vector", "_ev")).alias("cosine")
    )
    reached = scored.groupBy(*PAIR).agg(F.max("cosine").alias("cosine"))
    return (
        assigned.join(reached, PAIR, "left")
        .withColumn("score", F.coalesce(unit_score("cosine"), F.lit(0.0)))
        .select(*PAIR, "score")
    )


def _use(kind: str, ref: Column) -> Column:
    return F.struct(F.lit(kind).alias("entity_type"), ref.alias("_ref"))


def cohort_percentiles(scores: DataFrame, min_cohort: int = MIN_COHORT) -> DataFrame:
    """Adds ``percentile``: 100 * position / (n - 1) by ascending score, ties by document id.

    Cohorts below ``min_cohort`` are left out. Positions are distinct on ties,
    unlike ``percent_rank``. A cohort may hold a large share of all documents,
    so positions are counted in blocks of score and id.
    """
    sizes = scores.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cohort)
    placed = blocked_row_number(
        scores.withColumn("_s", F.round("score", 12)),
        KEY,
        {"_band": F.floor(F.col("_s") * 4096)},
        {"_score": F.col("_s"), "_ids": F.floor(F.col("document_id") / 65_536)},
        [F.col("_s"), F.col("document_id")],
        "_pos",
    )
    return (
        placed.join(sizes, KEY)
        .withColumn("percentile", F.lit(100.0) * (F.col("_pos") - 1) / (F.col("_n") - 1))
        .drop("_s", "_pos", "_n")
    )


# --- classification ----------------------------------------------------------------------


def _joined(scores: DataFrame, assigned: DataFrame, percentiles: DataFrame) -> DataFrame:
    """One row per (entity, document) that is scored or assigned."""
    sizes = assigned.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_assigned"))
    marked = assigned.withColumn("_has", F.lit(True))
    return (
        scores.join(marked, PAIR, "full_outer")
        .join(percentiles.select(*PAIR, "percentile"), PAIR, "left")
        .join(sizes, KEY, "left")
        .withColumn("_has", F.coalesce("_has", F.lit(False)))
        .withColumn("_assigned", F.coalesce("_assigned", F.lit(0)))
    )


def _mismatch(p: ScanParams) -> Column:
    """Why an assigned document no longer fits; the first rule that holds."""
    deep_enough = F.lit(p.top_k) >= 3 * F.greatest("_assigned", F.lit(1))
    return (
        F.when(F.col("score") < p.remove, "low_score")
        .when(F.col("score").isNull() & deep_enough, "absent")
        .when(F.col("percentile") <= p.percentile, "cohort_bottom")
    )


def _supported(p: ScanParams) -> Column:
    return (F.col("score") >= p.add) & (F.col("supporting") >= p.min_chunks)


OUTPUT = [
    *PAIR, "action", "score", "cohort_percentile", "distance", "reason",
    "replacement_entity_id", "replacement_score", "best_passage", "title",
]


def classify_multi(scores: DataFrame, assigned: DataFrame, percentiles: DataFrame, p: ScanParams) -> DataFrame:
    """add / remove actions for tags; scores between the two thresholds yield nothing."""
    best = F.coalesce("score", F.lit(0.0))
    rows = _joined(scores, assigned, percentiles).withColumn("reason", F.when(F.col("_has"), _mismatch(p)))
    action = F.when(~F.col("_has") & _supported(p), "add").when(F.col("reason").isNotNull(), "remove")
    return (
        rows.withColumn("action", action)
        .where(F.col("action").isNotNull())
        .withColumns(
            {
                "distance": F.when(F.col("action") == "add", best - p.add).otherwise(p.remove - best),
                "cohort_percentile": F.when(F.col("action") == "remove", F.col("percentile")),
                "score": best,
                "replacement_entity_id": F.lit(None).cast("long"),
                "replacement_score": F.lit(None).cast("double"),
            }
        )
        .select(*OUTPUT)
    )


def competitors(scores: DataFrame) -> DataFrame:
    """The two best entities per (type, document): (entity_type, document_id, first, second)."""
    window = Window.partitionBy("entity_type", "document_id").orderBy(F.desc(F.round("score", 12)), "entity_id")
    item = F.struct("entity_id", "score")
    return (
        scores.withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= 2)
        .groupBy("entity_type", "document_id")
        .agg(
            F.max(F.when(F.col("_n") == 1, item)).alias("first"),
            F.max(F.when(F.col("_n") == 2, item)).alias("second"),
        )
    )


def competitor_best(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best other entity of the same type for each (entity, document) in ``pairs``."""
    other = F.when(F.col("first.entity_id") != F.col("entity_id"), F.col("first")).otherwise(F.col("second"))
    return (
        pairs.select(*PAIR)
        .join(competitors(scores), ["entity_type", "document_id"])
        .withColumn("_o", other)
        .where(F.col("_o").isNotNull())
        .select(*PAIR, F.col("_o.entity_id").alias("other_id"), F.col("_o.score").alias("other_score"))
    )


def incumbents(scores: DataFrame, assigned: DataFrame) -> DataFrame:
    """(entity_type, document_id, incumbent): the assigned scanned entity, or -1.

    -1 stands for a name in the chunk payload that no scanned entity accounts
    for; it still blocks an add.
    """
    held = assigned.groupBy("entity_type", "document_id").agg(F.max("entity_id").alias("_held"))
    carried = scores.groupBy("entity_type", "document_id").agg(
        F.bool_or(F.col("payload_name") != "").alias("_carried")
    )
    value = F.coalesce("_held", F.when(F.col("_carried"), F.lit(-1).cast("long")))
    return (
        held.join(carried, ["entity_type", "document_id"], "full_outer")
        .withColumn("incumbent", value)
        .where(F.col("incumbent").isNotNull())
        .select("entity_type", "document_id", "incumbent")
    )


def classify_single(scores: DataFrame, assigned: DataFrame, percentiles: DataFrame, p: ScanParams) -> DataFrame:
    """add / replace / review actions for single-valued fields.

    A mismatching incumbent is replaced when another entity clears the add
    threshold and beats it; otherwise it is put up for review.
    """
    best = F.coalesce("score", F.lit(0.0))
    rows = (
        _joined(scores, assigned, percentiles)
        .join(incumbents(scores, assigned), ["entity_type", "document_id"], "left")
        .withColumn("reason", F.when(F.col("_has"), _mismatch(p)))
    )
    kept = rows.where(
        F.col("reason").isNotNull() | (~F.col("_has") & F.col("incumbent").isNull() & _supported(p))
    )
    wins = (F.col("other_score") >= p.add) & (F.col("other_score") > best)
    action = (
        F.when(~F.col("_has"), "add").when(F.coalesce(wins, F.lit(False)), "replace").otherwise("review")
    )
    replaced = lambda c: F.when(F.col("action") == "replace", F.col(c))
    return (
        kept.join(competitor_best(scores, assigned), PAIR, "left")
        .withColumn("action", action)
        .withColumns(
            {
                "distance": F.when(F.col("action") == "add", best - p.add)
                .when(F.col("action") == "replace", F.col("other_score") - best)
                .otherwise(p.remove - best),
                "cohort_percentile": F.when(F.col("action") != "add", F.col("percentile")),
                "score": best,
                "replacement_entity_id": replaced("other_id"),
                "replacement_score": replaced("other_score"),
            }
        )
        .select(*OUTPUT)
    )


# --- candidates -------------------------------------------------------------------------------


def active_dismissals(dismissals: DataFrame, as_of: Column, resuggest_days: int = 0) -> DataFrame:
    """Dismissals in force as (entity, document, kind); replace and review are one kind."""
    rows = dismissals.where(F.col("action") != "dedup")
    if resuggest_days > 0:
        cutoff = as_of - F.make_dt_interval(days=F.lit(resuggest_days))
        rows = rows.where(~F.coalesce(F.col("dismissed_at") < cutoff, F.lit(False)))
    return rows.select(*PAIR, action_kind().alias("kind")).distinct()


def action_kind() -> Column:
    return F.when(F.col("action").isin("replace", "review"), "keep_incumbent").otherwise(F.col("action"))


def mark_skipped(actions: DataFrame, dismissals: DataFrame, pending: DataFrame) -> DataFrame:
    """Adds ``skipped``: dismissed, else pending (the document has an open suggestion), else NULL."""
    return (
        actions.withColumn("kind", action_kind())
        .join(dismissals.withColumn("_d", F.lit(True)), [*PAIR, "kind"], "left")
        .join(pending.select("document_id").distinct().withColumn("_p", F.lit(True)), "document_id", "left")
        .withColumn("skipped", F.when(F.col("_d"), "dismissed").when(F.col("_p"), "pending"))
        .drop("kind", "_d", "_p")
    )


def scan_candidates(
    chunks: DataFrame,
    entities: DataFrame,
    docs: DataFrame,
    dismissals: DataFrame,
    pending: DataFrame,
    params: ScanParams,
) -> DataFrame:
    """All actions the scan finds, with names, titles and the ``skipped`` mark.

    The chunk table is read twice whatever the number of entities: once for the
    nearest chunks of all of them, once for the cohorts. Both small results are
    cut, since several branches use them.
    """
    entities = cut(entities.select(*KEY, "name", "vector"))
    assigned = cut(assignments(docs, entities))
    scores = cut(scan_scores(scan_hits(chunks, entities, params.top_k), params.add))
    percentiles = cut(cohort_percentiles(cohort_scores(chunks, entities, assigned)))
    is_tag = F.col("entity_type") == "tag"
    split = lambda df, tag: df.where(is_tag if tag else ~is_tag)
    actions = classify_multi(*[split(df, True) for df in (scores, assigned, percentiles)], params).unionByName(
        classify_single(*[split(df, False) for df in (scores, assigned, percentiles)], params)
    )
    names = entities.select(*KEY, "name")
    titled = (
        actions.join(names.withColumnRenamed("name", "entity_name"), KEY)
        .join(
            names.select("entity_type", F.col("entity_id").alias("replacement_entity_id"), F.col("name").alias("replacement_entity_name")),
            ["entity_type", "replacement_entity_id"],
            "left",
        )
        .join(docs.select("document_id", F.col("title").alias("_title")), "document_id", "left")
        .withColumn("document_title", F.coalesce("title", "_title", F.lit("")))
        .withColumn("best_passage", F.coalesce("best_passage", F.lit("")))
        .drop("title", "_title")
    )
    rounded = titled.withColumns(
        {
            "score": F.round("score", 4),
            "cohort_percentile": F.round("cohort_percentile", 1),
            "replacement_score": F.round("replacement_score", 4),
        }
    )
    # The result is small and read several times (cap, grouping, summary).
    return cut(mark_skipped(rounded, dismissals, pending))


def kept(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("skipped").isNull()).drop("skipped")


def action_order() -> list[Column]:
    return [F.desc(F.round("distance", 12)), F.col("entity_type"), F.col("entity_id"), F.col("action")]


def cap_documents(candidates: DataFrame, max_documents: int | None) -> DataFrame:
    """Actions of the documents with the best evidence, all without a number; every action of a kept document stays."""
    if max_documents is None:
        return candidates
    best = candidates.groupBy("document_id").agg(F.max(F.round("distance", 12)).alias("_best"))
    chosen = best.orderBy(F.desc("_best"), "document_id").limit(max_documents)
    return candidates.join(chosen.select("document_id"), "document_id", "left_semi")


def capped_count(candidates: DataFrame, max_documents: int | None) -> DataFrame:
    return candidates.agg(_beyond(F.count_distinct("document_id"), max_documents).alias("capped"))


def _beyond(documents: Column, most: int | None) -> Column:
    return F.lit(0).cast("long") if most is None else F.greatest(documents - most, F.lit(0)).cast("long")


def apply_actions(candidates: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Actions re-checked against the current documents, one row per document.

    ``docs``: current (document_id, title, tag_ids, correspondent_id,
    document_type_id); ``names``: the entity dimension. An action is stale when
    its tag is already there or gone, or the field's value changed. Output:
    title, base_tags, tags, correspondent, document_type and the valid actions
    in order of distance; documents left with none are dropped. The last valid
    add or replace of a field decides it.
    """
    columns = set(docs.columns)
    current = docs.select(
        "document_id",
        "title",
        "tag_ids",
        *[
            (F.col(f"{k}_id") if f"{k}_id" in columns else F.lit(None).cast("long")).alias(f"{k}_id")
            for k in SINGLE_VALUED
        ],
    ).join(candidates.select("document_id").distinct(), "document_id", "left_semi")
    tag_names = names.where(F.col("entity_type") == "tag").select(F.col("entity_id").alias("_t"), F.col("name").alias("_tn"))
    base = (
        current.select("document_id", F.posexplode("tag_ids").alias("_pos", "_t"))
        .join(tag_names, "_t")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_tn"))).alias("_b"))
        .select("document_id", F.transform("_b", lambda s: s["_tn"]).alias("base_tags"))
    )
    state = current.join(base, "document_id", "left").withColumn(
        "base_tags", F.coalesce("base_tags", F.array().cast("array<string>"))
    )
    for kind in SINGLE_VALUED:
        single = names.where(F.col("entity_type") == kind).select(
            F.col("entity_id").alias(f"{kind}_id"), F.col("name").alias(f"_{kind}")
        )
        state = state.join(single, f"{kind}_id", "left")

    has_tag = F.array_contains("base_tags", F.col("entity_name"))
    field_id = F.when(F.col("entity_type") == "correspondent", F.col("correspondent_id")).when(
        F.col("entity_type") == "document_type", F.col("document_type_id")
    )
    action, is_tag = F.col("action"), F.col("entity_type") == "tag"
    valid = (
        F.when(is_tag & (action == "add"), ~has_tag)
        .when(is_tag & (action == "remove"), has_tag)
        .when(action == "add", field_id.isNull())
        .otherwise(F.coalesce(field_id == F.col("entity_id"), F.lit(False)))
    )
    new_name = F.when(~is_tag & (action == "add"), F.col("entity_name")).when(
        ~is_tag & (action == "replace"), F.col("replacement_entity_name")
    )
    item = F.struct(
        (-F.round("distance", 12)).alias("order"),
        "entity_type",
        "entity_id",
        "action",
        "entity_name",
        "score",
        "cohort_percentile",
        "reason",
        "best_passage",
        "replacement_entity_id",
        "replacement_entity_name",
        "replacement_score",
        new_name.alias("new_name"),
    )
    # A document has at most a few actions per scanned entity, so this list is short.
    grouped = (
        candidates.join(state, "document_id")
        .where(valid)
        .groupBy("document_id")
        .agg(
            F.array_sort(F.collect_list(item)).alias("actions"),
            *[F.first(c).alias(c) for c in ("title", "base_tags", "_correspondent", "_document_type")],
        )
    )
    picked = lambda act: F.transform(
        F.filter("actions", lambda a: (a["entity_type"] == "tag") & (a["action"] == act)), lambda a: a["entity_name"]
    )

    def decided(kind: str) -> Column:
        named = F.filter("actions", lambda a: (a["entity_type"] == kind) & a["new_name"].isNotNull())
        last = F.try_element_at(named, F.lit(-1))
        return F.coalesce(last["new_name"], F.col(f"_{kind}"))

    added = F.concat(F.col("base_tags"), F.array_distinct(picked("add")))
    return grouped.select(
        "document_id",
        "title",
        "base_tags",
        F.filter(added, lambda t: ~F.array_contains(picked("remove"), t)).alias("tags"),
        decided("correspondent").alias("correspondent"),
        decided("document_type").alias("document_type"),
        F.transform("actions", lambda a: a.dropFields("order", "new_name")).alias("actions"),
    )


def build_suggestions(applied: DataFrame, at: Column, provider: str, model: str) -> DataFrame:
    """One pending suggestion per document; the id depends on content, so a rerun repeats it."""
    evidence = F.struct("actions", "base_tags", at.alias("scanned_at"))
    return applied.select(
        F.sha2(F.concat_ws("|", "document_id", F.to_json("actions"), at.cast("string")), 256).alias("id"),
        "document_id",
        F.lit("pending").alias("status"),
        at.alias("created_at"),
        "title",
        "tags",
        "correspondent",
        "document_type",
        F.lit(None).cast("string").alias("storage_path"),
        F.create_map().cast("map<string,string>").alias("custom_fields"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit("grooming").alias("analysis_mode"),
        evidence.alias("evidence"),
    )


def scan_summary(candidates: DataFrame, applied: DataFrame, max_documents: int | None) -> DataFrame:
    """One row: applied actions by kind, skipped and capped counts."""
    done = applied.select(F.explode("actions").alias("a")).agg(
        *[
            F.count_if(F.col("a.action") == action).alias(name)
            for action, name in (("add", "added"), ("remove", "removed"), ("replace", "replaced"), ("review", "review"))
        ]
    )
    skipped = candidates.agg(
        F.count_if(F.col("skipped") == "dismissed").alias("skipped_dismissed"),
        F.count_if(F.col("skipped") == "pending").alias("skipped_pending"),
        _beyond(F.count_distinct(F.when(F.col("skipped").isNull(), F.col("document_id"))), max_documents).alias("capped"),
    )
    both = done.unionByName(skipped, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def stamp_scanned(state: DataFrame, entity_types: list[str], at: Column) -> DataFrame:
    """Sets ``last_scanned_at`` on all non-excluded entities of the scanned types."""
    scanned = F.col("entity_type").isin(entity_types) & ~F.coalesce("excluded", F.lit(False))
    return state.withColumn("last_scanned_at", F.when(scanned, at).otherwise(F.col("last_scanned_at")))

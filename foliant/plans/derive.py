"""Tables derived from the given ones, each with its SQL twin in ``derive_sql``.

Ids are shifted by one because document id 0 means "no document".
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.session import ensure_checkpoint_dir, spread
from foliant.sources import store

INBOX, QUALITY, TOXIC, BLANK = 100, 101, 102, 103


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hours(n: Column) -> Column:
    """A duration of ``n`` whole hours."""
    return F.make_dt_interval(
        days=F.floor(n / 24).cast("int"), hours=F.pmod(n, F.lit(24)).cast("int")
    )


def stamp(column: str) -> Column:
    """Text form of a timestamp, to the second."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- documents ---------------------------------------------------------------


def document(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with tag ids, single-valued ids (some unset or unknown) and custom fields."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    spread_docs = spread(docs)
    first = docs.groupBy("source").agg((F.min("doc_id") + 1).alias("correspondent_id"))
    types = docs.groupBy("lang").agg((F.min("doc_id") + 1).alias("document_type_id"))
    d = spread_docs.join(labels, "doc_id", "left").join(first, "source").join(types, "lang")
    tag = lambda test, tid: F.when(test, F.lit(tid).cast("long"))
    document_id = F.col("doc_id") + 1
    created = ntz("2024-01-01 00:00:00") + hours(F.col("doc_id") % 8760)
    entry = lambda field, value: F.struct(
        F.lit(field).cast("long").alias("field"), value.cast("string").alias("value")
    )
    return d.select(
        document_id.alias("document_id"),
        F.concat("source", F.lit(" #"), document_id).alias("title"),
        F.when(F.col("doc_id") % 31 == 9, F.lit("")).otherwise(F.col("text")).alias("content"),
        F.array_compact(
            F.array(
                tag(F.col("doc_id") % 17 == 0, INBOX),
                tag(F.col("quality") == 1, QUALITY),
                tag(F.col("toxic") == 1, TOXIC),
                tag(F.col("doc_id") % 23 == 2, BLANK),
            )
        ).alias("tag_ids"),
        F.when(F.col("doc_id") % 13 != 5, F.col("correspondent_id")).alias("correspondent_id"),
        F.when(F.col("doc_id") % 19 == 4, F.lit(-7).cast("long"))
        .otherwise(F.col("document_type_id"))
        .alias("document_type_id"),
        F.array(
            entry(1, F.col("n_chars")),
            entry(2, F.when(F.col("doc_id") % 3 == 0, F.col("lang"))),
            entry(9, F.lit("x")),
        ).alias("custom_fields"),
        created.alias("created"),
        created.alias("added"),
        (created + hours(F.col("doc_id") % 5)).alias("modified"),
    )


def entity(spark: SparkSession, sf: str) -> DataFrame:
    """Entity dimension of the documents: tags, correspondents, types, storage paths."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    tags = (
        docs.join(labels, "doc_id", "left")
        .select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.when(F.col("doc_id") % 17 == 0, F.struct(F.lit(INBOX).alias("i"), F.lit("inbox").alias("n"))),
                        F.when(F.col("quality") == 1, F.struct(F.lit(QUALITY).alias("i"), F.lit("quality").alias("n"))),
                        F.when(F.col("toxic") == 1, F.struct(F.lit(TOXIC).alias("i"), F.lit("toxic").alias("n"))),
                        F.when(F.col("doc_id") % 23 == 2, F.struct(F.lit(BLANK).alias("i"), F.lit("").alias("n"))),
                    )
                )
            ).alias("t")
        )
        .groupBy(F.col("t.i").cast("long").alias("entity_id"), F.col("t.n").alias("name"))
        .agg(F.count(F.lit(1)).alias("document_count"))
        .select(F.lit("tag").alias("entity_type"), "entity_id", "name", "document_count")
    )

    def single(kind: str, column: str) -> DataFrame:
        return docs.groupBy(F.col(column).alias("name")).agg(
            (F.min("doc_id") + 1).alias("entity_id"), F.count(F.lit(1)).alias("document_count")
        ).select(F.lit(kind).alias("entity_type"), "entity_id", "name", "document_count")

    paths = table(spark, sf, "region").select(
        F.lit("storage_path").alias("entity_type"),
        (F.col("r_regionkey") + 1).cast("long").alias("entity_id"),
        F.col("r_name").alias("name"),
        F.lit(0).cast("long").alias("document_count"),
    )
    return (
        tags.unionByName(single("correspondent", "source"))
        .unionByName(single("document_type", "lang"))
        .unionByName(paths)
    )


def custom_field(spark: SparkSession, sf: str) -> DataFrame:
    """Custom-field definitions: one per nation, with its data type by key."""
    kinds = F.array(*[F.lit(k) for k in ("monetary", "integer", "float", "boolean", "string")])
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf, "nation").select(
        (key + 1).alias("field_id"),
        F.col("n_name").alias("name"),
        F.when(key % 6 != 5, F.get(kinds, (key % 6).cast("int"))).alias("data_type"),
    )


# --- vectors -----------------------------------------------------------------


#: Embeddings whose ids are sent to the scan of the texts, so that texts without one are not shuffled.
SENT_IDS = 1_000_000


def chunk_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table over the given embeddings, two chunks per document."""
    e = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("long").alias("half"), "vec_id", "embedding", "label"
    )
    doc = Window.partitionBy("half")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    if e.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(e.select("vec_id")), "vec_id", "left_semi")
    label = F.max(F.when(F.col("vec_id") % 2 == 0, F.col("label"))).over(doc).cast("long")
    d = (
        e.withColumn("label", label)
        .withColumn("document_id", F.col("half") + 1)
        .join(texts, "vec_id", "left")
    )
    return d.select(
        "document_id",
        (F.col("vec_id") % 2).alias("chunk_index"),
        F.lit(2).cast("long").alias("total_chunks"),
        F.concat_ws("_", "document_id", F.col("vec_id") % 2).alias("chunk_id"),
        F.coalesce("text", F.lit("")).alias("passage"),
        F.concat(F.lit("doc "), "document_id").alias("title"),
        F.array(F.col("label") + 1, F.col("document_id") % 5 + 11).alias("tag_ids"),
        F.array(
            F.concat(F.lit("tag"), F.col("label") + 1),
            F.concat(F.lit("tag"), F.col("document_id") % 5 + 11),
        ).alias("tags"),
        F.concat(F.lit("c"), "label").alias("correspondent"),
        F.when(F.col("document_id") % 7 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("t"), F.col("label") % 4))
        .alias("document_type"),
        F.create_map(
            F.lit("batch"),
            F.when(F.col("document_id") % 9 == 0, F.lit(" ")).otherwise(
                F.concat(F.lit("b"), F.col("document_id") % 4)
            ),
        ).alias("custom_fields"),
        F.col("embedding").alias("vector"),
    )


#: Tables that queries of one application share, by its id, their name and the folder of their source.
_STORED: dict[tuple[str, str, str], str] = {}


def shared_path(spark: SparkSession, sf: str, name: str) -> str:
    """A folder for a table that is built once in an application and then read by many queries."""
    key = (spark.sparkContext.applicationId, name, sf)
    return _STORED.setdefault(key, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")


def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """``chunk_vec`` as a stored table with locations, written by the first query that reads it."""
    path = shared_path(spark, sf, "chunks")
    if not store.versions(spark, path):
        store.write_version(chunk_vec(spark, sf), path, buckets=16)
    return store.read_located(spark, path)


def query_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Every given embedding as a query."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )


def entity_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Scan entities: the mean vector of each label, as a tag and as a correspondent."""
    means = (
        table(spark, sf, "embeddings")
        .select(F.col("label").cast("long").alias("label"), F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select("label", F.transform("v", lambda s: s["x"]).alias("vector"))
    )
    kinds = F.array(F.lit("tag"), F.lit("correspondent"))
    return means.select(
        F.explode(kinds).alias("entity_type"),
        (F.col("label") + 1).alias("entity_id"),
        F.col("label"),
        "vector",
    ).select(
        "entity_type",
        "entity_id",
        F.when(F.col("entity_type") == "tag", F.concat(F.lit("tag"), "entity_id"))
        .otherwise(F.concat(F.lit("c"), "label"))
        .alias("name"),
        "vector",
    )


def archive(spark: SparkSession, sf: str) -> DataFrame:
    """The document table behind ``chunk_vec``: the truth for assignments.

    Every sixth document has no correspondent although its chunks still carry one;
    every eighth has a correspondent and a tag that none of its chunks carries.
    """
    c = chunk_vec(spark, sf)
    drifted = F.col("document_id") % 8 == 5
    after = F.col("tag_ids")[0] % 10 + 1
    return c.where(F.col("chunk_index") == 0).select(
        "document_id",
        "title",
        F.when(drifted, F.array_distinct(F.array_append("tag_ids", after))).otherwise(F.col("tag_ids")).alias("tag_ids"),
        F.when(F.col("document_id") % 6 != 0, F.when(drifted, after).otherwise(F.col("tag_ids")[0])).alias("correspondent_id"),
    )


# --- queue, audit, tracking ---------------------------------------------------


def suggestion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view", "signup"))
    document_id = F.col("event_id") % 300 + 1
    grooming = F.col("event_id") % 3 == 0
    user = F.col("user_id")
    tags = F.array_compact(
        F.array(
            F.when(user % 4 != 3, F.concat(F.lit("tag"), user % 4)),
            F.when(user % 2 == 0, F.lit("Quality")),
            F.when(user % 4 == 1, F.lit("toxic")),
        )
    )
    action = F.when(F.col("event_id") % 2 == 0, F.lit("add")).otherwise(F.lit("remove"))
    return e.select(
        F.col("event_id").alias("id"),
        document_id.alias("document_id"),
        F.when(F.col("event_id") % 10 < 7, F.lit("pending"))
        .when(F.col("event_id") % 10 < 9, F.lit("approved"))
        .otherwise(F.lit("rejected"))
        .alias("status"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("Title "), F.col("event_id") % 5).alias("title"),
        tags.alias("tags"),
        F.when(user % 3 > 0, F.concat(F.lit("SRC"), user % 25)).alias("correspondent"),
        F.get(F.array(F.lit("EN"), F.lit("fr"), F.lit("it")), (user % 3).cast("int")).alias("document_type"),
        F.when(user % 5 == 0, F.lit("asia")).alias("storage_path"),
        F.create_map(F.concat(F.lit("Nation_"), user % 30), F.col("value").cast("string")).alias("custom_fields"),
        F.when(F.col("event_id") % 5 == 1, F.repeat(F.concat(F.lit("read "), user % 9, F.lit(" ")), F.lit(100))).alias("extracted_content"),
        F.when(F.col("event_id") % 2 == 1, F.repeat(F.lit("old "), F.lit(200))).alias("original_content"),
        F.when(grooming, F.lit("grooming")).otherwise(F.lit("ocr")).alias("analysis_mode"),
        F.when(
            grooming,
            F.array(
                F.struct(
                    action.alias("action"),
                    F.lit("tag").alias("entity_type"),
                    (user % 10 + 1).alias("entity_id"),
                    F.lit(None).cast("long").alias("replacement_entity_id"),
                ),
                F.struct(
                    F.lit("replace").alias("action"),
                    F.lit("correspondent").alias("entity_type"),
                    F.when(user % 7 > 0, user % 7).alias("entity_id"),
                    (user % 7 + 1).alias("replacement_entity_id"),
                ),
            ),
        ).alias("actions"),
    )


def decision(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions in event order: purchase approves, error rejects the suggestion before it."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("decision_id"),
        (F.col("event_id") - F.col("user_id") % 3 - 1).alias("suggestion_id"),
        F.when(F.col("event_type") == "purchase", F.lit("approve"))
        .otherwise(F.lit("reject"))
        .alias("verdict"),
        F.concat(F.lit("user:"), "user_id").alias("change_source"),
        F.col("ts").alias("decided_at"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Title "), F.col("event_id") % 5)).alias("edit_title"),
        F.when(F.col("event_id") % 4 == 1, F.array(F.lit("tag0"), F.lit("Quality"))).alias("edit_tags"),
        F.when(F.col("event_id") % 3 == 1, F.lit("SRC7")).alias("edit_correspondent"),
        (F.col("event_id") % 2 == 0).alias("apply_content"),
    )


AUDIT_FIELDS = ("title", "tags", "correspondent", "document_type", "storage_path", "_event")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.array(*[F.lit(f) for f in AUDIT_FIELDS])
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") + 1).alias("document_id"),
        F.concat(F.lit("Report "), F.col("user_id") % 12).alias("document_title"),
        F.get(fields, (F.col("event_id") % 6).cast("int")).alias("field_name"),
        F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("long").cast("string")).alias("previous_value"),
        (F.floor("value") + 1).cast("long").cast("string").alias("new_value"),
        F.concat(F.lit("user:"), F.col("user_id") % 20).alias("change_source"),
        F.col("event_type").alias("action_type"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("s"), F.col("event_id") % 40)).alias("session_id"),
        F.col("ts").alias("changed_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("suggestion_id"),
    )


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking rows of two thirds of the documents, and of some that no longer exist."""
    docs = table(spark, sf, "documents")
    d = docs.select((F.col("doc_id") + 1).alias("document_id"), F.col("doc_id"))
    gone = table(spark, sf, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("document_id"), F.lit(0).cast("long").alias("doc_id")
    )
    d = d.where(F.col("document_id") % 3 > 0).unionByName(gone)
    modified = ntz("2024-01-01 00:00:00") + hours(F.col("doc_id") % 8760) + hours(F.col("doc_id") % 5)
    shift = F.pmod("document_id", F.lit(3)).cast("long") - 1
    return d.select(
        "document_id",
        ntz("2024-01-01 00:00:00").alias("first_seen_at"),
        F.when(F.pmod("document_id", F.lit(5)) > 0, ntz("2024-02-01 00:00:00")).alias("last_analyzed_at"),
        F.when(
            F.pmod("document_id", F.lit(7)) == 0, ntz("2024-02-01 00:00:00") + hours(F.pmod("document_id", F.lit(100)))
        ).alias("reembed_dirty_since"),
        F.when(
            F.pmod("document_id", F.lit(11)) > 0,
            F.when(shift < 0, modified - hours(F.lit(1))).otherwise(modified + hours(shift)),
        ).alias("last_embedded_at"),
    )


def webhook_body(spark: SparkSession, sf: str) -> DataFrame:
    """Webhook payloads in nine shapes, some of them unusable."""
    target = (F.col("event_id") % 1000).cast("string")
    kind = F.col("event_id") % 9
    object_ = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    by_id = object_(F.lit('"document_id": '), target)
    url = object_(F.lit('"doc_url": "http://host/documents/'), target, F.lit('/details"'))
    body = (
        F.when(kind == 0, by_id)
        .when(kind == 1, object_(F.lit('"id": '), target))
        .when(kind == 2, url)
        .when(kind == 3, F.concat(F.lit('"{\\"document_id\\": '), target, F.lit('}"')))
        .when(kind == 4, F.concat(F.lit("not json "), target))
        .when(kind == 5, F.concat(F.lit("["), target, F.lit("]")))
        .when(kind == 6, object_(F.lit('"title": "t'), target, F.lit('"')))
        .when(kind == 7, object_(F.lit('"doc_url": "http://host/files/'), target, F.lit('"')))
        .otherwise(object_(F.lit('"document_id": "'), target, F.lit('"')))
    )
    return table(spark, sf, "events").select("event_id", "ts", body.alias("body"))


# --- conversations ------------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a time per turn; some turns are blanked."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_no"),
        "role",
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 3, F.lit("  ")).otherwise(F.col("text")).alias("content"),
        (ntz("2024-01-01 00:00:00") + hours((F.col("conv_id") * 2 + F.col("turn")) % 8760)).alias("ts"),
    )


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """A prior summary for the conversations whose first turn is long enough."""
    first = table(spark, sf, "conversations").where(F.col("turn") == 0)
    return first.where(F.length("text") > 150).select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("Earlier: "), "role").alias("summary")
    )


def memory_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Stored memories: the even embeddings."""
    e = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == 0)
    return e.select(
        F.col("vec_id").alias("memory_id"),
        F.concat(F.lit("memory "), "vec_id").alias("text"),
        F.col("embedding").cast("array<double>").alias("vector"),
        (ntz("2024-01-01 00:00:00") + hours(F.col("vec_id") % 8760)).alias("created_at"),
    )


def fact_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in arrival order: the odd embeddings, and a near copy of every embedding."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = e.select(
        (F.col("vec_id") * 2 + 1).alias("fact_id"),
        F.transform(
            "v", lambda x, i: F.when(i == F.col("vec_id") % 64, x + F.lit(0.01)).otherwise(x)
        ).alias("vector"),
    )
    plain = e.where(F.col("vec_id") % 2 == 1).select((F.col("vec_id") * 2).alias("fact_id"), F.col("v").alias("vector"))
    return plain.unionByName(near).select(
        "fact_id", F.concat(F.lit("fact "), "fact_id").alias("text"), "vector"
    )


# --- entities ----------------------------------------------------------------------


def entity_name(spark: SparkSession, sf: str) -> DataFrame:
    """Part, brand and type names, each with perturbed copies."""
    p = table(spark, sf, "part")

    def kind(column: str, code: int) -> DataFrame:
        return p.groupBy(F.col(column).alias("base")).agg((F.min("p_partkey") * 3 + code).alias("k"))

    base = kind("p_name", 0).unionByName(kind("p_brand", 1)).unionByName(kind("p_type", 2))
    variants = F.array(
        F.col("base"),
        F.upper("base"),
        F.regexp_replace("base", "e", "é"),
        F.concat("base", F.lit("s")),
        F.expr("substring(base, 1, length(base) - 1)"),
        F.concat(F.lit(" "), "base", F.lit(" ")),
    )
    return base.select("k", F.posexplode(variants).alias("v", "name")).select(
        F.lit("tag").alias("entity_type"),
        (F.col("k") * 6 + F.col("v") + 1).alias("entity_id"),
        "name",
        F.lit(None).cast("array<double>").alias("vector"),
        F.when(F.col("k") % 2 == 0, F.lit("text")).alias("description"),
        (F.col("v") % 2 == 0).alias("embedding_stored"),
    )


def vector_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with vectors: the facts of ``fact_vec``, half of them tags."""
    kind = F.when(F.col("fact_id") % 8 < 6, F.lit("tag")).otherwise(F.lit("correspondent"))
    return fact_vec(spark, sf).select(
        kind.alias("entity_type"),
        (F.col("fact_id") + 1).alias("entity_id"),
        F.substring(F.sha2(F.col("fact_id").cast("string"), 256), 1, 12).alias("name"),
        "vector",
        F.when(F.col("fact_id") % 3 == 0, F.lit("text")).alias("description"),
        (F.col("fact_id") % 2 == 0).alias("embedding_stored"),
    )


def similarity_link(spark: SparkSession, sf: str) -> DataFrame:
    """Links between customers that share supplier nations through orders: a sparse id graph.

    Every order links its customer to the order's key modulo the customers, so
    that components of all sizes appear.
    """
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    return o.select(
        F.col("o_custkey").alias("a"),
        F.floor(F.col("o_custkey") * 0.5 + F.col("o_orderkey") % 3).cast("long").alias("b"),
    )


def entity_state(spark: SparkSession, sf: str) -> DataFrame:
    """Stored entity rows over the customers, with flags by key."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    at = lambda n: ntz("2024-01-01 00:00:00") + hours(n)
    return c.select(
        F.when(k % 3 == 0, "correspondent").otherwise("tag").alias("entity_type"),
        (k + 1).alias("entity_id"),
        F.when(k % 10 == 0, F.concat("c_name", F.lit(" old"))).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 < 3, F.concat(F.lit("About "), "c_mktsegment")).alias("description"),
        F.when(k % 4 == 1, F.lit("user")).when(k % 4 == 2, F.lit("llm")).alias("description_source"),
        (k % 8 == 7).alias("excluded"),
        F.when(k % 5 > 0, F.array(F.col("c_acctbal"), F.lit(1.0))).alias("vector"),
        (k % 5 > 1).alias("embedding_stored"),
        F.when(k % 5 > 0, F.when(k % 7 == 0, F.lit("old")).otherwise(F.lit("m1"))).alias("embed_model"),
        F.when(k % 6 > 0, at(k % 700)).alias("description_updated_at"),
        F.when(k % 9 > 0, at(k % 650 + 24 * 200)).alias("last_scanned_at"),
    )


def entity_source(spark: SparkSession, sf: str) -> DataFrame:
    """What the archive currently lists: most customers, and the suppliers as new ones."""
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 11 < 10)
    s = table(spark, sf, "supplier")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 3 == 0, "correspondent").otherwise("tag").alias("entity_type"),
        (k + 1).alias("entity_id"),
        F.col("c_name").alias("name"),
        (k % 50).alias("document_count"),
    ).unionByName(
        s.select(
            F.lit("document_type").alias("entity_type"),
            (F.col("s_suppkey") + 1).alias("entity_id"),
            F.col("s_name").alias("name"),
            F.lit(0).cast("long").alias("document_count"),
        )
    )


def dismissal(spark: SparkSession, sf: str) -> DataFrame:
    actions = F.array(*[F.lit(a) for a in ("add", "remove", "replace", "review", "dedup")])
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "tag").otherwise("correspondent").alias("entity_type"),
        (F.col("user_id") % 10 + 1).alias("entity_id"),
        F.when(F.col("event_id") % 5 == 4, F.lit(0).cast("long")).otherwise(F.col("event_id") % 300 + 1).alias("document_id"),
        F.get(actions, (F.col("event_id") % 5).cast("int")).alias("action"),
        F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 14 + 1).alias("other_entity_id"),
        F.when(F.col("event_id") % 40 > 0, F.col("ts")).alias("dismissed_at"),
    )


def pending_document(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a pending suggestion naming one correspondent."""
    s = suggestion(spark, sf)
    return s.where((F.col("status") == "pending") & (F.col("correspondent") == "SRC7")).select("document_id").distinct()


def current_document(spark: SparkSession, sf: str) -> DataFrame:
    """The archive after the scan: some documents changed meanwhile."""
    d = archive(spark, sf)
    return d.select(
        "document_id",
        "title",
        F.when(F.col("document_id") % 8 == 3, F.slice("tag_ids", 2, 1))
        .when(F.col("document_id") % 8 == 5, F.concat("tag_ids", F.array(F.lit(3).cast("long"))))
        .otherwise(F.col("tag_ids"))
        .alias("tag_ids"),
        F.when(F.col("document_id") % 9 == 2, F.lit(4).cast("long")).otherwise(F.col("correspondent_id")).alias("correspondent_id"),
    )


def scan_name(spark: SparkSession, sf: str) -> DataFrame:
    """Names of everything the chunk payload mentions: scanned entities and the plain tags."""
    scanned = entity_vec(spark, sf).select("entity_type", "entity_id", "name")
    tags = chunk_vec(spark, sf).select(F.explode(F.arrays_zip("tag_ids", "tags")).alias("t")).select(
        F.lit("tag").alias("entity_type"), F.col("t.tag_ids").alias("entity_id"), F.col("t.tags").alias("name")
    )
    return scanned.unionByName(tags).distinct()

"""Document and entity scans: selection, name resolution, filtering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import schemas

PAGE_LIMIT = 100


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.DOCUMENT, fmt)


def has_tag(tag_id: int | None) -> Column:
    if tag_id is None:
        return F.lit(False)
    return F.coalesce(F.array_contains("tag_ids", F.lit(tag_id).cast("long")), F.lit(False))


def to_index(docs: DataFrame, complete: DataFrame, inbox_tag: int | None) -> DataFrame:
    """Documents still to index: not in the inbox, not complete, with content."""
    return docs.where(~has_tag(inbox_tag) & (F.col("content") != "")).join(
        complete.select("document_id"), "document_id", "left_anti"
    )


def inbox(docs: DataFrame, inbox_tag: int | None) -> DataFrame:
    """Ids of inbox documents; every document when no inbox tag is configured."""
    picked = docs if inbox_tag is None else docs.where(has_tag(inbox_tag))
    return picked.select("document_id")


def entities_of(entities: DataFrame, entity_type: str) -> DataFrame:
    """(entity_id, name) of one type; nameless rows are dropped."""
    return entities.where((F.col("entity_type") == entity_type) & (F.col("name") != "")).select(
        "entity_id", "name"
    )


def custom_fields(definitions: DataFrame) -> DataFrame:
    return definitions.select(
        "field_id", "name", F.coalesce("data_type", F.lit("")).alias("data_type")
    )


def resolve_names(docs: DataFrame, entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds tags, correspondent, document_type and custom_fields by name.

    Unknown or nameless tags are dropped, a missing single value becomes '',
    and a custom field is kept when its name is known and its value not null.
    The name tables join by id without a hint: AQE broadcasts them when their
    measured size allows it and shuffles otherwise.
    """
    named = entities.where(F.col("name") != "")
    tag = named.where(F.col("entity_type") == "tag").select(
        F.col("entity_id").alias("_tag"), F.col("name").alias("_tag_name")
    )
    field = definitions.select(F.col("field_id").alias("_field"), F.col("name").alias("_field_name")).where(
        F.col("_field_name") != ""
    )
    tags = (
        docs.select("document_id", F.posexplode("tag_ids").alias("_pos", "_tag"))
        .join(tag, "_tag")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_tag_name"))).alias("_tags"))
        .select("document_id", F.transform("_tags", lambda s: s["_tag_name"]).alias("tags"))
    )
    fields = (
        docs.select("document_id", F.posexplode("custom_fields").alias("_pos", "_cf"))
        .where(F.col("_cf.value").isNotNull())
        .withColumn("_field", F.col("_cf.field"))
        .join(field, "_field")
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_field_name", "_cf.value"))).alias("_fields"))
        .select(
            "document_id",
            F.map_from_entries(
                F.transform("_fields", lambda s: F.struct(s["_field_name"], s["value"]))
            ).alias("_cf_map"),
        )
    )

    def single(kind: str) -> DataFrame:
        return named.where(F.col("entity_type") == kind).select(
            F.col("entity_id").alias(f"{kind}_id"), F.col("name").alias(kind)
        )

    return (
        docs.join(tags, "document_id", "left")
        .join(fields, "document_id", "left")
        .join(single("correspondent"), "correspondent_id", "left")
        .join(single("document_type"), "document_type_id", "left")
        .withColumns(
            {
                "tags": F.coalesce("tags", F.array().cast("array<string>")),
                "custom_fields": F.coalesce("_cf_map", F.create_map().cast("map<string,string>")),
                "correspondent": F.coalesce("correspondent", F.lit("")),
                "document_type": F.coalesce("document_type", F.lit("")),
            }
        )
        .drop("_cf_map")
    )


def filter_documents(
    docs: DataFrame,
    tag_ids: list[int] | None = None,
    correspondent_ids: list[int] | None = None,
    document_type_ids: list[int] | None = None,
    query: str | None = None,
    custom_field_values: dict[int, str] | None = None,
) -> DataFrame:
    """Documents meeting every given filter; each list means any of its ids."""
    out = docs
    if tag_ids:
        wanted = F.array(*[F.lit(t).cast("long") for t in tag_ids])
        out = out.where(F.arrays_overlap("tag_ids", wanted))
    if correspondent_ids:
        out = out.where(F.col("correspondent_id").isin(correspondent_ids))
    if document_type_ids:
        out = out.where(F.col("document_type_id").isin(document_type_ids))
    if query:
        term = F.lit(query.lower())
        out = out.where(F.lower("content").contains(term) | F.lower("title").contains(term))
    for field, value in (custom_field_values or {}).items():
        out = out.where(
            F.exists("custom_fields", lambda e: (e["field"] == field) & (e["value"] == value))
        )
    return out


def page(rows: DataFrame, order: list[Column], page_no: int, page_size: int, limit: int = PAGE_LIMIT) -> DataFrame:
    """One page of an ordered listing; the planner turns it into a bounded top-k."""
    if page_no < 1 or not 1 <= page_size <= limit:
        raise ValueError(f"need page >= 1 and 1 <= page size <= {limit}")
    return rows.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def modified_since(docs: DataFrame, day: str) -> DataFrame:
    """Documents modified on or after ``day``; a plain range on the column, so files are pruned."""
    start = F.lit(f"{day} 00:00:00").cast(docs.schema["modified"].dataType)
    return docs.where(F.col("modified") >= start).orderBy(F.desc("modified"), "document_id")

"""Webhook payload parsing, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def webhook_events(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Adds ``document_id`` and ``reason``; rows with a reason belong in quarantine.

    The body may be an object, or a JSON string holding one. ``document_id``
    or ``id`` is taken first (a zero counts as missing), then the number in
    ``doc_url``. Steps are separate columns, so each text is parsed once.
    """
    zero = F.lit(0).cast("bigint")
    number = lambda name: F.nullif(F.trim(F.col(f"_f.{name}")).try_cast("bigint"), zero)
    in_url = F.regexp_extract("_f.doc_url", r"/documents/(\d+)", 1).try_cast("bigint")
    is_object = F.startswith("_kind", F.lit("OBJECT"))
    document_id = F.coalesce(number("document_id"), number("id"), F.nullif(in_url, zero))
    reason = (
        F.when(F.col("_kind").isNull(), "invalid_json")
        .when(~is_object, "unexpected_type")
        .when(F.col("document_id").isNull(), "no_document_id")
    )
    # Only a body that starts with a quote can be a doubly encoded one.
    quoted = F.startswith(F.ltrim(column), F.lit('"'))
    inner = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "string")
    return (
        bodies.withColumn("_text", F.when(quoted, inner).otherwise(F.col(column)))
        .withColumn("_kind", F.schema_of_variant(F.try_parse_json("_text")))
        .withColumn("_f", F.when(is_object, F.from_json("_text", "document_id string, id string, doc_url string")))
        .withColumn("document_id", document_id)
        .withColumn("reason", reason)
        .drop("_text", "_kind", "_f")
    )


def form_events(forms: DataFrame) -> DataFrame:
    """The form variant: fields as a map, ids also under ``pk`` or in a nested ``document`` object."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    direct = F.coalesce(*[F.trim(field(n)).try_cast("bigint") for n in ("document_id", "id", "pk")])
    nested = F.coalesce(
        *[F.get_json_object(field("document"), p).try_cast("bigint") for p in ("$.id", "$.document_id")]
    )
    document_id = F.nullif(F.coalesce(direct, nested), F.lit(0).cast("bigint"))
    return forms.withColumns(
        {"document_id": document_id, "reason": F.when(document_id.isNull(), "no_document_id")}
    )


def reindex_requests(events: DataFrame) -> DataFrame:
    """One request per document with its latest event: several edits cost one re-embedding."""
    return events.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("ts").alias("ts"))

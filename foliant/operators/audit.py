"""Audit rows: recording, querying, export and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_RETENTION_DAYS, RETENTION_DAYS = 30, 180
EXPORT_COLUMNS = (
    "id", "document_id", "document_title", "field_name", "previous_value", "new_value",
    "change_source", "action_type", "session_id", "changed_at", "suggestion_id",
)


def record_changes(changes: DataFrame, at: Column) -> DataFrame:
    """One row per entry of ``changes`` (field -> previous, new); equal values are recorded too."""
    return changes.select(
        *[c for c in changes.columns if c != "changes"], F.explode("changes").alias("field_name", "_v")
    ).select(
        *[c for c in changes.columns if c != "changes"],
        "field_name",
        F.col("_v.previous").alias("previous_value"),
        F.col("_v.new").alias("new_value"),
        F.lit("field_change").alias("action_type"),
        at.alias("changed_at"),
    )


def record_events(events: DataFrame) -> DataFrame:
    """Event rows; a missing document is 0, the system itself."""
    return events.withColumns(
        {
            "document_id": F.coalesce("document_id", F.lit(0).cast("long")),
            "field_name": F.lit("_event"),
            "previous_value": F.lit(None).cast("string"),
        }
    )


def query(
    audit: DataFrame,
    document_id: int | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
    change_source: str | None = None,
    action_type: str | None = None,
    field_name: str | None = None,
    title_pattern: str | None = None,
) -> DataFrame:
    """Rows meeting every given condition; dates are inclusive, the title is an unescaped ILIKE.

    All conditions are plain column predicates, so they reach the scan and
    prune the date partitions of the stored table.
    """
    out = audit
    for column, value in (
        ("document_id", document_id), ("change_source", change_source),
        ("action_type", action_type), ("field_name", field_name),
    ):
        if value is not None:
            out = out.where(F.col(column) == value)
    if date_from is not None:
        out = out.where(F.col("changed_at") >= date_from)
    if date_to is not None:
        out = out.where(F.col("changed_at") <= date_to)
    if title_pattern is not None:
        out = out.where(F.col("document_title").ilike(f"%{title_pattern}%"))
    return out


def export_rows(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest rows first, in export column order and with ISO times; all of them unless a limit is given."""
    newest = audit.orderBy(F.desc("changed_at"), F.desc("id"))
    newest = newest if limit is None else newest.limit(limit)
    return newest.select(
        *[
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == "changed_at" else F.col(c)
            for c in EXPORT_COLUMNS
        ]
    )


def export(audit: DataFrame, path: str, fmt: str = "csv", limit: int | None = None) -> None:
    """Writes the export as CSV with a header and empty strings for NULL, or as JSON.

    The rows are range-sorted: part files in name order hold them newest first.
    """
    rows = export_rows(audit, limit)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    else:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def retain(audit: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days``; a row exactly at the cutoff stays."""
    if days < MIN_RETENTION_DAYS:
        raise ValueError(f"retention must be at least {MIN_RETENTION_DAYS} days")
    return audit.where(F.col("changed_at") >= as_of - F.make_dt_interval(days=F.lit(days)))

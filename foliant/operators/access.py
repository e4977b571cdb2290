"""Permission tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ("can_access", "can_view_queue", "can_approve", "can_analyze", "can_discover", "can_settings", "can_groom")


def effective_permissions(users: DataFrame, sync_admins: bool, grooming_enabled: bool) -> DataFrame:
    """Flags after the admin rule; grooming also needs the feature switched on."""
    admin = F.coalesce("admin", F.lit(False)) & F.lit(sync_admins)
    granted = {f: F.coalesce(f, F.lit(False)) | admin for f in FLAGS}
    granted["can_groom"] = granted["can_groom"] & F.lit(grooming_enabled)
    return users.withColumns(granted)


def merged_users(users: DataFrame, source: DataFrame, sync_admins: bool) -> DataFrame:
    """Recorded users with the admin rule applied, and source users without a record, denied everything."""
    admin = F.coalesce("admin", F.lit(False)) & F.lit(sync_admins)
    recorded = users.withColumns(
        {**{f: F.coalesce(f, F.lit(False)) | admin for f in FLAGS}, "has_record": F.lit(True)}
    ).select("username", "admin", *FLAGS, "has_record")
    others = (
        source.where(F.coalesce("username", F.lit("")) != "")
        .groupBy("username")
        .agg(F.bool_or(F.coalesce("is_superuser", F.lit(False)) | F.coalesce("is_staff", F.lit(False))).alias("admin"))
        .join(users.select("username"), "username", "left_anti")
        .withColumns({**{f: F.lit(False) for f in FLAGS}, "has_record": F.lit(False)})
        .select("username", "admin", *FLAGS, "has_record")
    )
    return recorded.unionByName(others).orderBy(F.lower("username"), "username")

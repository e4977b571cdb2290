"""Durable tables on plain parquet: versions, bucketed upserts, change logs.

One writer per table, any number of readers. Nothing here reads and overwrites the
same files in one plan, and every step can be repeated after a failure.

``v=3`` is a full version, ``v=3.2`` its second upsert: only the buckets that upsert
wrote, and a manifest of the folders that hold all others. Committed files never change.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
BUCKETS_KEY = "buckets"


# --- tables with versions ---------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _snapshots(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Committed (version, upsert), oldest first; upsert 0 is the full version. A folder counts once its job has committed."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        version, _, upsert = status.getPath().getName().removeprefix("v=").partition(".")
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if version.isdigit() and fs.exists(done):
            found.append((int(version), int(upsert or 0)))
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed full versions of a table, oldest first."""
    return [version for version, upsert in _snapshots(spark, path) if not upsert]


def _folder(snapshot: tuple[int, int]) -> str:
    version, upsert = snapshot
    return f"v={version}.{upsert}" if upsert else f"v={version}"


def _manifest(spark: SparkSession, path: str, snapshot: tuple[int, int]):
    return _files(spark, f"{path}/{_folder(snapshot)}/_manifest")


def _places(spark: SparkSession, path: str, snapshot: tuple[int, int], buckets: int) -> dict[int, str]:
    """The folder of each bucket in a snapshot; a bucket without rows has a folder without files, or none."""
    own = dict.fromkeys(range(buckets), _folder(snapshot))
    if not snapshot[1]:
        return own
    fs, file = _manifest(spark, path, snapshot)
    stream = fs.open(file)
    try:
        return own | {int(b): folder for b, folder in json.loads(stream.readLine()).items()}
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest snapshot. The frame keeps reading it, whatever is written meanwhile, until ``expire`` removes it."""
    found = _snapshots(spark, path)
    if not found:
        return None
    version = f"{path}/v={found[-1][0]}"
    if not found[-1][1]:
        return spark.read.parquet(version)
    places = _places(spark, path, found[-1], _bucket_count(spark, version))
    there = {folder: _bucket_folders(spark, f"{path}/{folder}") for folder in set(places.values())}
    parts = [f"{path}/{folder}/bucket={b}" for b, folder in sorted(places.items()) if b in there[folder]]
    if not parts:
        return spark.read.parquet(version).where(F.lit(False))
    return spark.read.option("basePath", path).parquet(*parts).drop("v")


def _bucket_folders(spark: SparkSession, folder: str) -> set[int]:
    fs, root = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}


def read_located(spark: SparkSession, path: str) -> DataFrame | None:
    """As ``read_current``; the bucket column says how many buckets there are, so that rows can be fetched by location."""
    found = _snapshots(spark, path)
    if not found:
        return None
    buckets = _bucket_count(spark, f"{path}/v={found[-1][0]}")
    return read_current(spark, path).withMetadata("bucket", {BUCKETS_KEY: buckets})


def buckets_of(df: DataFrame) -> int | None:
    """The number of buckets of a table read by ``read_located``."""
    return df.schema["bucket"].metadata.get(BUCKETS_KEY) if "bucket" in df.columns else None


def write_version(df: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Full rewrite into a new version; readers switch when its commit marker appears.

    ``buckets`` is the unit of later upserts and is fixed per version (kept in
    the name of a marker file). Choose it so that a bucket is about a gigabyte.
    """
    spark = df.sparkSession
    found = _snapshots(spark, path)
    version = found[-1][0] + 1 if found else 1
    fs, root = _new_folder(spark, f"{path}/v={version}")
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, f"_buckets.{buckets}")).close()
    _bucketed(df, buckets).write.mode("append").partitionBy("bucket").parquet(f"{path}/v={version}")
    return version


def _new_folder(spark: SparkSession, folder: str):
    fs, root = _files(spark, folder)
    if fs.exists(root):  # left over from a write that never committed
        fs.delete(root, True)
    fs.mkdirs(root)
    return fs, root


def _bucket_count(spark: SparkSession, table: str) -> int:
    fs, root = _files(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return next((int(n.split(".")[1]) for n in names if n.startswith("_buckets.")), BUCKETS)


def _bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their bucket, gathered by bucket; a bucket beyond the advisory size is split over tasks, however large.

    Files are sorted by document, so that row groups outside the wanted documents are skipped.
    """
    dealt = df.withColumn("bucket", bucket("document_id", buckets)).hint("rebalance", "bucket")
    return dealt.sortWithinPartitions("bucket", *[c for c in ("document_id", "chunk_index") if c in df.columns])


def bucket(column: str = "document_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


# --- chunk table ------------------------------------------------------------------------------


def upsert(current: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """The chunk table after replacing all chunks of the ``touched`` documents by ``new``.

    A touched document without new chunks (empty text) disappears.
    """
    return current.join(touched.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, touched: DataFrame, staging: str | None = None) -> None:
    """Durable upsert that reads only the buckets the documents fall into and writes them anew beside the old ones.

    ``new`` holds chunks of ``touched`` documents only. Readers see the table before or after the upsert: it
    exists from the commit marker of its folder on, and no file of an earlier snapshot changes. A failed
    upsert leaves nothing that counts, and a repeated one ends in the same rows. ``expire`` removes
    what no later snapshot needs. ``staging`` is not needed any more.
    """
    version, last = _snapshots(spark, path)[-1]
    buckets = _bucket_count(spark, f"{path}/v={version}")
    # At most one value per bucket, whatever the number of documents.
    hit = [r[0] for r in touched.select(bucket(buckets=buckets)).distinct().collect()]
    if not hit:
        return
    current = read_current(spark, path).where(F.col("bucket").isin(hit)).drop("bucket")
    merged = _bucketed(upsert(current, new, touched), buckets)
    others = {b: folder for b, folder in _places(spark, path, (version, last), buckets).items() if b not in set(hit)}
    following = (version, last + 1)
    _new_folder(spark, f"{path}/{_folder(following)}")
    fs, file = _manifest(spark, path, following)
    stream = fs.create(file)
    stream.writeBytes(json.dumps(others))
    stream.close()
    merged.write.mode("append").partitionBy("bucket").parquet(f"{path}/{_folder(following)}")


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all snapshots but the last ``keep``, and the buckets that only those used.

    Markers go first, so that an interrupted call leaves no snapshot that looks whole; a repeated call ends the work.
    """
    if keep < 1:
        raise ValueError("at least the current snapshot stays")
    found = _snapshots(spark, path)
    used: dict[str, set[int]] = {}
    for snapshot in found[-keep:]:
        buckets = _bucket_count(spark, f"{path}/v={snapshot[0]}")
        for b, folder in _places(spark, path, snapshot, buckets).items():
            used.setdefault(folder, set()).add(b)
        used.setdefault(f"v={snapshot[0]}", set())  # it names the number of buckets
    fs, root = _files(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for snapshot in found[:-keep]:
        fs.delete(path_of(f"{path}/{_folder(snapshot)}/_SUCCESS"), False)
    kept = {_folder(s) for s in found[-keep:]}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("v=") or name in kept:
            continue
        if name not in used:
            fs.delete(status.getPath(), True)
            continue
        there = _bucket_folders(spark, f"{path}/{name}")
        unused = sorted(there - used[name])
        for b in unused if used[name] & there or "." in name else unused[1:]:  # an empty table keeps one for its schema
            fs.delete(path_of(status.getPath(), f"bucket={b}"), True)


# --- change logs ----------------------------------------------------------------------------------


def current(log: DataFrame, keys: Sequence[str], version: Sequence[str], deleted: str | None = None) -> DataFrame:
    """Latest row per key of an append-only log; deleted keys are left out.

    An aggregate, not a window: the latest row is chosen on the map side, so a
    key with a long history does not gather in one task.
    """
    others = [c for c in log.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.struct(*version))
    out = log.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*")
    if deleted:
        out = out.where(~F.coalesce(deleted, F.lit(False))).drop(deleted)
    return out


def compact(spark: SparkSession, log_path: str, out_path: str, keys: Sequence[str], version: Sequence[str]) -> None:
    """Rewrites a log as its latest rows, deletions included, under a new path."""
    current(spark.read.parquet(log_path), keys, version).write.mode("overwrite").parquet(out_path)


# --- day partitions ------------------------------------------------------------------------------


def append_days(df: DataFrame, path: str, column: str = "changed_at") -> None:
    """Appends rows to a table partitioned by the day of ``column``."""
    df.withColumn("day", F.to_date(column)).write.mode("append").partitionBy("day").parquet(path)


def drop_before(spark: SparkSession, path: str, cutoff: datetime, staging: str, column: str = "changed_at") -> None:
    """Removes rows strictly older than ``cutoff``: whole days by deleting their directories.

    Only the day of the cutoff is rewritten, through ``staging``.
    """
    fs, root = _files(spark, path)
    edge = cutoff.date().isoformat()
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < edge:
            fs.delete(status.getPath(), True)
    boundary = f"{path}/day={edge}"
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(boundary)):
        return
    spark.read.parquet(boundary).where(F.col(column) >= F.lit(cutoff)).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").parquet(boundary)


# --- migration -----------------------------------------------------------------------------------------


def from_legacy(points: DataFrame) -> DataFrame:
    """Older chunk rows (lists and maps as JSON text) in the current layout; broken JSON counts as empty."""
    strings = F.coalesce(F.from_json("tags_json", "array<string>"), F.array().cast("array<string>"))
    ids = F.coalesce(F.from_json("tag_ids_json", "array<bigint>"), F.array().cast("array<bigint>"))
    fields = F.coalesce(F.from_json("custom_fields_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return points.where(F.col("vector").isNotNull()).select(
        "document_id",
        "chunk_index",
        "total_chunks",
        F.col("id").alias("chunk_id"),
        F.coalesce("document", F.lit("")).alias("passage"),
        "title",
        strings.alias("tags"),
        ids.alias("tag_ids"),
        "correspondent",
        "document_type",
        fields.alias("custom_fields"),
        "vector",
    )


#: Decisions on moving vectors: load the rows, nothing to do, or embed anew.
LOAD, DONE, REINDEX = "load", "done", "reindex"


def migration(source: DataFrame | None, destination: DataFrame | None, layouts_match: bool = True) -> DataFrame:
    """One row (decision, rows_before, rows_after, detail) on copying vectors without embedding them again.

    Counts decide: rows are loaded from a filled source into an empty destination
    only; where the source cannot be read in this layout, or fails to be read,
    the documents need a new index.
    """
    spark = SparkSession.active()
    size = lambda df: 0 if df is None else df.count()
    before, after, trouble = size(source), size(destination), "" if source is not None and layouts_match else "other layout"
    if not trouble and before and not after:
        try:
            from_legacy(source).write.format("noop").mode("overwrite").save()
        except PySparkException as error:
            trouble = f"unreadable: {error}"[:200]
    counts = spark.range(1).select(F.lit(before).cast("long").alias("rows_before"), F.lit(after).cast("long").alias("rows_after"), F.lit(trouble).alias("detail"))
    decision = F.when(F.col("detail") != "", REINDEX).when((F.col("rows_before") > 0) & (F.col("rows_after") == 0), LOAD).otherwise(DONE)
    return counts.select(decision.alias("decision"), "*")


def migrate(source: DataFrame | None, destination: DataFrame | None, layouts_match: bool = True) -> tuple[DataFrame | None, str]:
    """(rows to load if any, decision) of ``migration``."""
    decision = migration(source, destination, layouts_match).first()["decision"]
    return (from_legacy(source) if decision == LOAD else None), decision


def migrate_memories(source: DataFrame | None, destination: DataFrame | None) -> DataFrame | None:
    """Memories to copy, best effort: none when there is nothing to copy or something is there already."""
    if source is None or source.isEmpty() or (destination is not None and not destination.isEmpty()):
        return None
    return source.where(F.col("vector").isNotNull())

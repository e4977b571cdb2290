"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "foliant", master: str | None = None, **conf: object
) -> SparkSession:
    """A session with the settings the jobs rely on; anything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder: on a cluster that folder would not be
    visible to the other machines.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and drop its lineage.

    Used where several branches read one expensive result, and between rounds
    of an iteration. Checkpoint files survive the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """A broadcast hint behind a row check; a larger table joins by shuffle.

    The check reads at most ``max_rows`` + 1 rows. Use it on stored or cut
    tables, where that read is cheap.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Repartitions an input too small to occupy all cores, ahead of CPU-heavy expressions.

    Decided from the planner's size estimate, without running anything: below
    one split per core a scan leaves cores idle, and moving so little data is
    cheap. A large input already has more splits than cores and is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(str(spark.conf.get("spark.sql.files.maxPartitionBytes")).rstrip("bB") or 0)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size < cores * split else df

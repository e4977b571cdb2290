"""Reading, clash-free columns and tables in the shared folder, for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Folders of the tables written inside the innermost ``collecting``.
_made: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder of spark.checkpoint.dir and read back.

    It cuts the lineage: lost executors cost a read, not a second computation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders of the tables that are written inside, for ``discard`` once nothing reads them."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``stored``; ``paths`` is empty afterwards."""
    while paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def doc_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that no other column of the input can clash with its own."""
    have = set(docs.columns)
    return docs.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def drawn(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hash of ``by``.

    A count and the hash's even spread bound what tasks hand on: rows beyond the share of the
    hash's range that holds ``n`` rows (and ten standard deviations) are dropped at once.
    """
    share = (n + 10 * n**0.5 + 10) / max(1, df.count())
    place = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    near = df.withColumn("_place", place).where(F.col("_place") < int(min(1.0, share) * (1 << 40)))
    return near.orderBy("_place", *by).limit(n).drop("_place")


def fold_of(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; 0 is the held-out fold."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def broadcast_checked(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A broadcast hint when a count (at most ``rows`` + 1 rows read) proves it small; else a shuffle join.

    For tables of a few numbers a row: half a million rows stay below some tens of MB.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

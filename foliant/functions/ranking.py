"""Top-n and exact row numbers that never put one hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt_on: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """Rows with ``row_number() <= n`` per ``keys``, numbered in ``rank``.

    The first window ranks inside (keys, salt), so a key holding a large share
    of the rows is spread over ``salts`` tasks; Spark's WindowGroupLimit also
    cuts each input partition to n rows before that shuffle. The second window
    sees at most n * salts rows per key. With one salt, for keys with few rows each, the second window ranks alone.
    """
    final = Window.partitionBy(*keys).orderBy(*order)
    if salts > 1:
        df = _within_salts(df, keys, order, n, salt_on, salts)
    return (
        df.withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("long"))
    )


def _within_salts(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_on: Sequence[str], salts: int
) -> DataFrame:
    """The n first rows per (keys, salt)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_on]), F.lit(salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(local))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )


def blocked_row_number(
    df: DataFrame,
    keys: Sequence[str],
    coarse: dict[str, Column],
    fine: dict[str, Column],
    order: Sequence[Column],
    out: str = "row_number",
) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` in blocks.

    ``coarse`` and ``fine`` are block columns that must agree with ``order``:
    sorting by (coarse, fine, order) has to equal sorting by ``order``. Block
    sizes are counted with map-side aggregation, turned into starting offsets
    by two running sums (over coarse blocks, and over fine blocks inside one
    coarse block) and added to the position inside the block. No task holds
    more than one fine block, or the list of blocks of one coarse block.
    """
    coarse_cols, fine_cols = list(coarse), list(fine)
    blocked = df.withColumns({**coarse, **fine})
    fine_keys = [*keys, *coarse_cols, *fine_cols]
    sizes = blocked.groupBy(*fine_keys).agg(F.count(F.lit(1)).alias("_n"))

    before = (Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, F.lit(0)).orderBy(*coarse_cols).rowsBetween(*before)
    inside = Window.partitionBy(*keys, *coarse_cols).orderBy(*fine_cols).rowsBetween(*before)
    coarse_start = (
        sizes.groupBy(*keys, *coarse_cols)
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_coarse_start", F.coalesce(F.sum("_n").over(whole), F.lit(0)))
        .drop("_n")
    )
    starts = sizes.withColumn("_fine_start", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop(
        "_n"
    )
    starts = starts.join(coarse_start, [*keys, *coarse_cols])
    position = F.row_number().over(Window.partitionBy(*fine_keys).orderBy(*order))
    return (
        blocked.withColumn("_position", position)
        .join(starts, fine_keys)
        .withColumn(
            out, (F.col("_position") + F.col("_fine_start") + F.col("_coarse_start")).cast("long")
        )
        .drop("_position", "_fine_start", "_coarse_start", *coarse_cols, *fine_cols)
    )


def id_blocks(column: str, fine: int = 65_536, coarse: int = 65_536) -> tuple[dict, dict]:
    """Block columns for an ordering by one integer id."""
    fine_block = F.floor(F.col(column) / fine)
    return (
        {"_coarse": F.floor(F.col(column) / (fine * coarse))},
        {"_fine": fine_block},
    )

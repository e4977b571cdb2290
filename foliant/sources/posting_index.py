"""A stored sparse index: impact-ordered postings in blocks, and a search that stops early.

Under one folder lie

- ``postings``, partitioned by a hash of the term: blocks of up to ``BLOCK`` entries of one term and stratum in
  falling order of their frequency, each with its largest one;
- ``terms``, partitioned alike: number of chunks, largest frequency and first block of each term and stratum;
- ``forward``: the term table bucketed by document, from which exact scores are read by location;
- ``size``: the number of chunks. Written last, it marks the index as complete.

A score is the sum of (frequency in the chunk x frequency in the query x idf). No frequency exceeds its block's
largest one, so sums of these bound what a chunk can still get. A stratum holds chunks of like length (by a factor of
the square root of two): a few very long chunks would lift the bounds of all others otherwise.

1. the first blocks of a query's terms give partial scores; their n-th is a bar that the n-th best chunk reaches;
2. strata whose terms together stay below the bar are left out, in the others terms that together stay below it
   (those of stop words, mostly) make no candidates, nor do blocks and entries that stay below it with all
   other terms at their largest;
3. candidates whose partial score cannot reach the bar go; the rest are scored exactly.

The result is that of the exhaustive sum. Rounding is met by ``SLACK``, a share of the bar.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.ranking import salted_top_n
from foliant.session import cut
from foliant.sources import store

POINT = ("document_id", "chunk_index")
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
#: Folders of terms; about one for a gigabyte of postings.
TERM_BUCKETS = 64
SLACK = 1e-9
BLOCKS = (
    "term string, stratum int, block long, max_tf long, n long, "
    "entries array<struct<document_id: long, chunk_index: long, tf: long>>"
)
#: Chunks a query's bar is read from, as a multiple of the wanted ones.
HEADS = 40
#: Share of the entries beyond which bounds are not worth their passes.
WHOLE = 0.25


@dataclass(frozen=True)
class PostingIndex:
    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def forward(self) -> DataFrame:
        return store.read_located(self.spark, f"{self.path}/forward")

    @property
    def total(self) -> int:
        return self.spark.read.parquet(f"{self.path}/size").first()["total"]


def exists(spark: SparkSession, path: str) -> bool:
    fs, marker = store._files(spark, f"{path}/size/_SUCCESS")
    return fs.exists(marker)


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted entries (term, stratum, block, tf, point); one that an Arrow batch cuts becomes two."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        changed[0] = True
        for key in ("term", "stratum", "block"):
            column = batch.column(key)
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(changed)
        end = np.append(start[1:], batch.num_rows)
        names = [*POINT, "tf"]
        entries = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
        first = batch.select(["term", "stratum", "block", "tf"]).take(pa.array(start))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, batch.num_rows).astype(np.int32)), entries)
        yield pa.RecordBatch.from_arrays([*first.columns, pa.array(end - start), lists], names=["term", "stratum", "block", "max_tf", "n", "entries"])


def with_stratum(terms: DataFrame) -> DataFrame:
    """(document_id, chunk_index, term, tf, stratum) of a term table."""
    length = F.sum("tf").over(Window.partitionBy(*POINT))
    return terms.select(*POINT, "term", F.col("tf").cast("long").alias("tf")).withColumn("stratum", F.floor(2 * F.log2(length)).cast("int"))


def build(terms: DataFrame, total: DataFrame, path: str, buckets: int = TERM_BUCKETS, doc_buckets: int = store.BUCKETS) -> PostingIndex:
    """Indexes a term table (document_id, chunk_index, term, tf); ``total`` is a one-row count of the indexed chunks.

    Terms of a chunk that lie in one partition (as ``chunking.sparse_terms`` leaves them) get their stratum without a shuffle;
    ``forward`` is written first and then read for the postings. Entries are sorted by ranges of (term, frequency), so a
    term that stands in every chunk is spread over tasks; each of these makes and writes its blocks.
    """
    spark = terms.sparkSession
    rows = with_stratum(terms)
    version = store.write_version(rows, f"{path}/forward", doc_buckets)
    order = ["term", "stratum", F.desc("tf"), *POINT]
    stored = spark.read.schema(rows.schema).parquet(f"{path}/forward/v={version}")
    placed = stored.select(*rows.columns).repartitionByRange(*order).sortWithinPartitions(*order)
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
    blocks = placed.select("term", "stratum", block, "tf", *POINT).mapInArrow(_gathered, BLOCKS)
    dealt = blocks.withColumn("bucket", _term_bucket(buckets)).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stats = spark.read.schema(dealt.schema).parquet(f"{path}/postings").groupBy("bucket", "term", "stratum")
    stats = stats.agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("block").alias("first_block"))
    stats.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    total.select(F.col("total").cast("long").alias("total"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/size")
    return PostingIndex(spark, path)


def _by_location(side: DataFrame, small: bool) -> DataFrame:
    """The smaller side of a join with a partitioned table; the filter lets the join prune partitions."""
    kept = side.where(F.col("bucket") >= 0)
    return F.broadcast(kept) if small else kept


def weights(index: PostingIndex, query_terms: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, bucket, term, stratum, w, ub, df, first_block) of the query terms that the index has, and whether they are few."""
    size = index.spark.read.parquet(f"{index.path}/size").first()
    asked = cut(query_terms.select("query_id", "term", "tf").withColumn("bucket", _term_bucket(size["buckets"])))
    small = asked.limit(200_001).count() <= 200_000
    known = index.terms.join(_by_location(asked, small), ["bucket", "term"])
    in_all = F.sum("df").over(Window.partitionBy("query_id", "term"))  # a row for each stratum
    idf = F.log((F.lit(size["total"]) - in_all + 0.5) / (in_all + 0.5) + 1)
    w = F.col("tf") * idf
    return cut(known.select("query_id", "bucket", "term", "stratum", w.alias("w"), (w * F.col("max_tf")).alias("ub"), F.col("df"), "first_block")), small


def essential_terms(index: PostingIndex, weighted: DataFrame, small: bool, n: int) -> DataFrame:
    """The rows of ``weighted`` that can make candidates, with their query's ``bar`` and, by stratum, the sum ``all`` of all bounds.

    The bar is read in the strata with the largest sums, as many as hold ``HEADS * n`` chunks.
    """
    of_stratum = Window.partitionBy("query_id", "stratum")  # a query's terms
    known = weighted.withColumns({"all": F.sum("ub").over(of_stratum), "_sum": F.sum("ub").over(of_stratum.orderBy("ub", "term"))})
    known = cut(known)
    strata = known.groupBy("query_id", "stratum").agg(F.max("all").alias("all"), F.max("df").alias("chunks"))
    falling = Window.partitionBy("query_id").orderBy(F.desc("all"), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("chunks").over(falling), F.lit(0))
    top = strata.withColumn("_before", before).where(F.col("_before") < HEADS * n).select("query_id", "stratum")
    chosen = cut(known.join(top, ["query_id", "stratum"]))
    heads = index.postings.join(_by_location(chosen.select("query_id", "bucket", "term", "stratum", "w", "first_block"), small), ["bucket", "term", "stratum"])
    heads = heads.where(F.col("block") == F.col("first_block"))
    first = heads.select("query_id", "w", F.explode("entries").alias("e")).groupBy("query_id", "e.document_id", "e.chunk_index")
    partial = first.agg(F.sum(F.col("w") * F.col("e.tf")).alias("score"))
    best = salted_top_n(partial, ["query_id"], [F.desc("score"), *[F.col(k) for k in POINT]], n, POINT)
    bars = best.where(F.col("rank") == n).select("query_id", (F.col("score") * (1 - SLACK)).alias("bar"))
    barred = known.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    return cut(barred.where(F.col("_sum") * (1 + SLACK) >= F.col("bar")).drop("_sum", "first_block"))


def candidates(index: PostingIndex, essential: DataFrame, small: bool) -> DataFrame:
    """(query_id, document_id, chunk_index): every chunk that can reach its query's bar."""
    reach = lambda own: (own + F.col("all") - F.col("ub")) * (1 + SLACK) >= F.col("bar")
    blocks = index.postings.join(_by_location(essential.drop("df"), small), ["bucket", "term", "stratum"]).where(reach(F.col("w") * F.col("max_tf")))
    entries = blocks.select("query_id", "w", "ub", "all", "bar", F.explode("entries").alias("e")).where(reach(F.col("w") * F.col("e.tf")))
    seen = entries.groupBy("query_id", "e.document_id", "e.chunk_index").agg(
        F.sum(F.col("w") * F.col("e.tf") - F.col("ub")).alias("short"), F.max("all").alias("all"), F.max("bar").alias("bar")
    )
    return seen.where((F.col("short") + F.col("all")) * (1 + SLACK) >= F.col("bar")).select("query_id", *POINT)


def search(index: PostingIndex, query_terms: DataFrame, n: int) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank): the n best chunks of each query (query_id, term, tf).

    Where the bounds leave more than ``WHOLE`` of the entries (n close to the number of chunks), all of them are summed instead.
    """
    weighted, small = weights(index, query_terms)
    essential = essential_terms(index, weighted, small, n)
    own = weighted.groupBy("query_id", "term").agg(F.first("w").alias("w"))  # the same in all strata
    wanted_terms = own.select("term").distinct()
    met = index.forward.join(F.broadcast(wanted_terms) if small else wanted_terms, "term", "left_semi")
    left, every = (x.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for x in (essential, weighted))
    on = ["term"]
    if left <= WHOLE * every:
        found = cut(candidates(index, essential, small))
        wanted = found.withColumn("bucket", store.bucket("document_id", store.buckets_of(index.forward)))
        met, on = met.join(_by_location(wanted, found.limit(100_001).count() <= 100_000), ["bucket", *POINT]), ["query_id", "term"]
    scored = met.join(F.broadcast(own) if small else own, on).groupBy("query_id", *POINT).agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
    order = [F.desc("_s"), *[F.col(k) for k in POINT]]
    return salted_top_n(scored.withColumn("_s", F.round("score", 9)), ["query_id"], order, n, POINT).drop("_s")

"""A corpus pipeline of the llm operators: each stage filters or cuts documents, the last packs what is left.

``STAGES`` are applied in order; a stage gets its predecessor's rows, written as Parquet and
read again. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, line_dedup, near_dup, packing, toxicity
from foliant.llm.common import collecting, discard, stored, table
from foliant.llm.queries import tokenizer_path
from foliant.plans.registry import query

#: Learned weights, sketches and packing are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
#: Tables inside the latest stage, on which its result may still depend.
_inner: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage begins when its predecessor's rows are written, so the tables inside the predecessor are deleted then."""

    @wraps(work)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _inner)
        with collecting() as made:
            try:
                return work(spark, docs, sf_dir)
            finally:
                _inner.extend(made)

    return run_one


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the bar of their language."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur in others; a document that held nothing else goes."""
    left = line_dedup.drop_recurring(docs, "_dropped").where((F.col("_dropped") == 0) | (F.trim("text") != "")).drop("_dropped")
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return near_dup.keep_one(docs, words=5, percent=80)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stored(work(spark, docs, sf_dir), name)
    discard(spark, _inner)
    return docs

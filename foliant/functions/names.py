"""Name normalisation, similarity and an exact candidate join for near-equal names."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import broadcast_if_small, cut

EPS = 1e-9


#: Every character that combines with the one before it.
MARKS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]")


@F.pandas_udf(T.StringType())
def normalise_name(names: pd.Series) -> pd.Series:
    """Stripped, case-folded, decomposed and without combining marks; NULL for NULL."""
    return names.str.strip().str.casefold().str.normalize("NFKD").str.replace(MARKS, "", regex=True)


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    matcher = SequenceMatcher(None)
    for left, right in batches:
        out, last = [], None
        for a, b in zip(left, right):
            # The matcher indexes its second text; keep that index across a run.
            if b != last:
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching characters of two normalised names; not symmetric in general."""
    return _ratio(a, b)


def _chars(name: Column) -> Column:
    """Characters numbered by occurrence, so that set intersection counts a multiset."""
    letters = F.split(name, "")
    return F.transform(
        letters,
        lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda o: o == c))),
    )


def similar_names(names: DataFrame, threshold: float, scope: str = "entity_type", name: str = "norm") -> DataFrame:
    """(scope, a, b, forward, backward) for distinct names whose ratio reaches ``threshold``.

    ``names`` holds distinct (scope, name) rows; a pair is returned once, with
    the ratio in both argument orders, if either reaches the threshold.

    No pair is missed: see ``piece_sides``. A multiset bound on common
    characters is tested inside the join, before a pair is written, and only
    the rest reaches the Python matcher.
    """
    left, probe = piece_sides(names, threshold, scope, name)
    shared = F.size(F.array_intersect("chars_a", "chars_b"))
    bound = 2 * shared >= F.lit(threshold) * (F.col("la") + F.col("lb")) - EPS
    ordered = (F.col("la") < F.col("lb")) | (F.col("a") < F.col("b"))
    pairs = (
        left.join(probe, PIECE)
        .where(ordered & bound)
        .select("scope", "a", "b")
        .distinct()
    )
    rated = pairs.withColumns(
        {"forward": name_similarity("a", "b"), "backward": name_similarity("b", "a")}
    )
    return rated.where(F.greatest("forward", "backward") >= threshold).withColumnRenamed("scope", scope)


#: Key of the piece join.
PIECE = ["scope", "la", "lb", "i", "piece"]


def piece_sides(names: DataFrame, threshold: float, scope: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The shorter and the longer names of similar pairs by ``PIECE``; similar names meet in one at least.

    A ratio of t over lengths la <= lb leaves at most (1 - t)(la + lb) unmatched
    characters, and as many as la + lb modulo 2. So of d + 1 pieces of the shorter
    name, d the largest such number, one occurs unchanged in the longer, moved by at most the
    surplus of insertions or deletions. Pieces are cut for each two lengths, since fewer
    and so longer ones do for lengths that are close: names of 12 characters meet in pieces of 4.
    """
    if threshold <= 2 / 3:
        raise ValueError("the piece join needs a threshold above 2/3")
    la, lb, i = F.col("la"), F.col("lb"), F.col("i")
    most = F.floor(F.lit(1 - threshold) * (la + lb) + EPS)
    edits = most - F.pmod(most + la + lb, F.lit(2))
    pieces = F.col("d") + 1
    start = lambda n: F.floor(n * la / pieces)

    base = names.select(
        F.col(scope).alias("scope"), F.col(name).alias("name"), F.length(name).cast("long").alias("len")
    ).where(F.col("len") > 0)
    base = base.withColumn("chars", _chars(F.col("name")))

    # Only lengths that occur are paired; there are few, whatever the table size.
    lengths = base.select("scope", "len").distinct()
    close = (
        lengths.withColumnRenamed("len", "la")
        .join(lengths.withColumnRenamed("len", "lb"), "scope")
        .where(la <= lb)
        .withColumns({"d": edits, "grown": lb - la})
        .where(F.col("d") >= F.col("grown"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d"))))
        .withColumns({"from": start(i), "width": start(i + 1) - start(i)})
    )
    close = broadcast_if_small(cut(close))
    piece = lambda at: F.substring("name", (at + 1).cast("int"), F.col("width").cast("int")).alias("piece")
    left = base.withColumnRenamed("len", "la").join(close, ["scope", "la"]).select(
        "scope", "la", "lb", "i", piece(F.col("from")), F.col("name").alias("a"), F.col("chars").alias("chars_a")
    )
    lo = F.greatest(F.col("from") - (F.col("d") - F.col("grown")) / 2, F.lit(0)).cast("long")
    hi = F.least(F.col("from") + (F.col("d") + F.col("grown")) / 2, lb - F.col("width")).cast("long")
    probe = (
        base.withColumnRenamed("len", "lb")
        .join(close.withColumns({"lo": lo, "hi": hi}).where("hi >= lo"), ["scope", "lb"])
        .withColumn("at", F.explode(F.sequence("lo", "hi")))
        .select("scope", "la", "lb", "i", piece(F.col("at")), F.col("name").alias("b"), F.col("chars").alias("chars_b"))
        .distinct()
    )
    return left, probe

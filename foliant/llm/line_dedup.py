"""Lines that recur across documents, found with a log-template tree and dropped. DataFrame functions only.

A line descends a tree of fixed depth: its number of words, then its first two words.
In the leaf it carries the key of its own template (fields with a digit are variable),
and, from ``LONG`` words on, four wider ones in which one quarter of the remaining words
is variable too. A template recurs when it is found in documents with different texts:

- a line of 8 words or more, in two documents;
- a shorter line, of 3 words at least, in ``SHORT_DOCS`` documents;
- a wider template, in ``WIDE_DOCS`` documents.

A recurring line stays in one text (the one with the smallest hash, and its exact copies)
and is dropped from all others. Copies are left to document-level deduplication: where two texts
share three lines or more and these hold 70 % of the words of **both**, the second text keeps them, so
that near copies stay recognisable. A line that is equal but for a quarter of its words, or short, counts
as shared from two texts on. A notice that fills less of either text is dropped, however often it occurs.

Only hashes of lines are shuffled before the dropped positions meet the texts; a hot line
is counted map-side, and its rows are joined by a shuffle that can be split.

Defined results: a null text stays null and has no lines; an empty text stays empty;
equal rows are treated alike; rows with a null id take part; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, stored

SHORTEST = 3
FULL = 8
LONG = 12
LEADING = 2
SHORT_DOCS = 20
WIDE_DOCS = 10
COPY_LINES = 3
COPY_PERCENT = 70
GAP = r"[ \t\x0B\f\r]+"


def _identity() -> list[Column]:
    """Columns that tell rows of ``docs`` apart (96 bits): equal rows may share them."""
    return [F.xxhash64("doc_id", "text").alias("row_id"), F.hash("text", "doc_id").alias("row_check")]


def line_keys(text: Column) -> Column:
    """For each line of ``text``: (number of words, template keys: the narrow one first); no keys for short lines."""
    masked = F.transform(
        F.split(text, "\n"),
        lambda line: F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \t]*[0-9][^ \t]*", "<*>")).otherwise(line),
    )
    words = F.transform(masked, lambda line: F.split(F.trim(line), GAP))

    def keys(line: Column) -> Column:
        n = F.size(line)
        part = F.ceil((n - LEADING) / 4).cast("int")
        narrow = F.xxhash64(F.lit(0), line)
        wide = [
            F.xxhash64(F.lit(j + 1), n, F.slice(line, F.lit(1), LEADING + part * j), F.slice(line, LEADING + 1 + part * (j + 1), n))
            for j in range(4)
        ]
        return (
            F.when(n < SHORTEST, F.array().cast("array<bigint>"))
            .when(n < LONG, F.array(narrow))
            .otherwise(F.array(narrow, *wide))
        )

    return F.transform(words, lambda line: F.struct(F.size(line).alias("words"), keys(line).alias("keys")))


def shared(keyed: DataFrame) -> DataFrame:
    """(key, home, drops): template keys found in different texts, with the least hash of their texts.

    ``drops`` says whether the key is found in enough documents for its lines to stay in that text alone.
    ``keyed``: (text_hash, lines) with the lines of ``line_keys``. A document counts once for a key.
    """

    def tagged(line: Column) -> Column:
        return F.transform(
            line["keys"], lambda key, i: F.struct(key.alias("key"), (i > 0).alias("wide"), (line["words"] >= FULL).alias("full"))
        )

    found = keyed.select("text_hash", F.explode(F.array_distinct(F.flatten(F.transform("lines", tagged)))).alias("line"))
    counted = found.groupBy("line.key").agg(
        F.count(F.lit(1)).alias("docs"),
        F.min("text_hash").alias("home"),
        F.max("text_hash").alias("last"),
        F.max("line.wide").alias("wide"),
        F.max("line.full").alias("full"),
    )
    enough = F.when(F.col("wide"), WIDE_DOCS).when(F.col("full"), 2).otherwise(SHORT_DOCS)
    return counted.where(F.col("home") != F.col("last")).select("key", "home", (F.col("docs") >= enough).alias("drops"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(row_id, row_check, gone): positions of the lines to drop, for the rows that lose any."""
    row = ["row_id", "row_check"]
    total = F.aggregate("lines", F.lit(0), lambda n, line: n + line["words"]).alias("all_words")
    read = docs.where(F.col("text").isNotNull()).select(
        *_identity(), F.xxhash64("text").alias("text_hash"), line_keys(F.col("text")).alias("lines")
    )
    keyed = stored(read.select("*", total), "lines")
    own = keyed.select(*row, "text_hash", "all_words", F.posexplode("lines").alias("at", "line")).select(
        *row, "text_hash", "all_words", "at", "line.words", F.explode("line.keys").alias("key")
    )
    elsewhere = own.join(shared(keyed), "key").where(F.col("home") != F.col("text_hash")).repartition(*row)
    lines = elsewhere.groupBy(*row, "at").agg(
        F.min("home").alias("home"), F.max("words").alias("words"), F.max("all_words").alias("all_words"), F.max("drops").alias("drops")
    )
    taken = stored(
        lines.groupBy(*row, "home").agg(
            F.collect_list(F.when(F.col("drops"), F.col("at"))).alias("at"),
            F.count(F.lit(1)).alias("n"),
            F.sum("words").alias("words"),
            F.max("all_words").alias("all_words"),
        ),
        "taken",
    )
    # With most of its words from one text, a row has one such text at most.
    most = lambda words: 100 * F.col("words") >= COPY_PERCENT * F.col(words)
    homes = keyed.groupBy(F.col("text_hash").alias("home")).agg(F.max("all_words").alias("home_words"))
    kin = taken.where((F.col("n") >= COPY_LINES) & most("all_words")).select(*row, "home", "words").join(homes, "home")
    kin = kin.where(most("home_words")).select(*row, F.col("home").alias("kin"))
    left = taken.where(F.size("at") > 0).join(kin, row, "left").where(~F.col("home").eqNullSafe(F.col("kin")))
    return left.groupBy(*row).agg(F.flatten(F.collect_list("at")).alias("gone"))


def drop_recurring(docs: DataFrame, dropped: str | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; ``dropped`` names a column for the number of lines lost."""
    gone = dropped_lines(doc_rows(docs, "doc_id", "text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_identity())
    joined = rows.join(gone, ["row_id", "row_check"], "left")
    left = F.array_join(
        F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n"
    )
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != dropped]
    if dropped:
        columns.append(F.coalesce(F.size(F.array_distinct("gone")), F.lit(0)).alias(dropped))
    return joined.select(*columns)

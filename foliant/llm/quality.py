"""Quality rules with thresholds from the data. DataFrame functions only.

Base counts of each text, then ratios of them; for every language and source, a mergeable
quantile sketch of each ratio: counts in logarithmic buckets, which give any quantile within
``ACCURACY`` of its value and are merged by adding. A group of fewer than ``ENOUGH`` rows takes the
sketch of its language, and that of all rows where the language is small too. A ratio's
limit lies ``SPREADS`` middle spreads beyond the median on the logarithmic scale; no constant bounds it.
Ratios of counts have half an occurrence added, so that texts without any have a place
on that scale, which depends on their length; a single occurrence is never too many.
Rows meet the limits of their group in a join whose limit side has a row for each group.

Defined results: a null or empty text has no words and fails the base rule; a null language or
source is a group of its own; equal rows are judged alike; an empty table gives no rows; extra
columns are kept by ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, stored

ACCURACY = 0.005
ENOUGH = 200
SPREADS = 3
MIN_WORDS = 50
_SPACES = " \t\n\u000b\f\r"
_LOG = math.log((1 + ACCURACY) / (1 - ACCURACY))
_TINY = 1e-10
#: Two buckets: a narrower spread is not told from none.
LEAST = math.exp(2 * _LOG)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the list."""

    def count(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_bound(ordered, covered))

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when(
                    (x["w"] == F.get(ordered, i - 1)["w"]) | (x["w"] == F.get(ordered, i + 1)["w"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _bound(hashes, lambda h: F.when(F.size(h) < 3, F.lit(0)).otherwise(_bound(windows(h), count)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    filled = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
    parts = doc_rows(docs, "doc_id", "text", "lang", "source").select("doc_id", "lang", "source", text.alias("text"), words.alias("words"), filled.alias("lines"))

    counts = parts.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    share = lambda n, of: (F.col(n) + 0.5) / (F.col(of) + 1)
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    }


#: What a ratio counts, where one is always allowed.
COUNTED = {"symbol_share": "n_symbols", "dup_line_share": "n_dup_lines", "repeat_share": "n_repeat_words"}


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the quantile sketches of all rows that pass the base rule; merged by adding n."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in ratios().items()]))
    bucket = F.ceil(F.log(F.greatest(F.col("value"), F.lit(_TINY)) / F.lit(_TINY)) / F.lit(_LOG)).cast("int")
    passed = rows.where(~F.col("base_failed")).select("lang", "source", values.alias("v")).select("lang", "source", "v.*")
    return passed.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """(keys, rule, rows and a column for each of ``points``) from sketches merged over everything but ``keys``."""
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group)})
    value = F.lit(_TINY) * F.exp(F.col("bucket") * F.lit(_LOG)) * F.lit(1 - ACCURACY)
    found = [F.min(F.when(F.col("upto") >= F.col("rows") * p, value)).alias(name) for name, p in points.items()]
    return ranked.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), *found)


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, one upper limit for each rule), a row for each language and source."""
    points = {"low": 0.25, "middle": 0.5, "high": 0.75}
    own = quantiles(sketches, ["lang", "source"], points)
    lang = quantiles(sketches, ["lang"], points)
    both = quantiles(sketches, [], points)
    tagged = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    lang, both = tagged(lang, "lang"), tagged(both, "all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_lang")) & (F.col("rule") == F.col("lang_rule"))).join(
        both, F.col("rule") == F.col("all_rule")
    )
    limit = F.lit(0.0)
    for tag in ("all", "lang", ""):
        c = lambda name, tag=tag: F.col(f"{tag}_{name}" if tag else name)
        value = c("middle") * F.pow(F.greatest(c("high") / c("low"), F.lit(LEAST)), F.lit(SPREADS))
        limit = value if tag == "all" else F.when(c("rows") >= ENOUGH, value).otherwise(limit)
    named = joined.select("lang", "source", "rule", limit.alias("value"))
    columns = [F.max(F.when(F.col("rule") == rule, F.col("value"))).alias(f"max_{rule}") for rule in ratios()]
    return named.groupBy("lang", "source").agg(*columns)


def judged(docs: DataFrame) -> DataFrame:
    """The measures of each row, its group's limits and ``kept``."""
    rows = stored(measured(docs), "measures")
    bars = limits(sketch(rows)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = rows.join(
        bars, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    inside = ~F.col("base_failed")
    for rule, value in ratios().items():
        allowed = value <= F.col(f"max_{rule}")
        if rule in COUNTED:
            allowed = allowed | (F.col(COUNTED[rule]) <= 1)
        inside = inside & F.coalesce(allowed, F.lit(True))
    return joined.withColumn("kept", inside).drop("of_lang", "of_source")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; a repeated id goes when all its rows do."""
    good = judged(docs).where("kept").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi").select(*docs.columns)

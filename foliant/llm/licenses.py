"""Licence notices in paragraphs (lines): a trained classifier, an unknown class, a check against templates.

Features are the words and word pairs of the licence templates below, but for those that are common
in ordinary lines. A multinomial logistic regression is fitted on altered copies of the templates
and a bounded sample of the corpus's lines (``SAMPLE`` rows). Every line of every text is scored by
SQL functions: its words meet the feature table (under ``FEATURES`` rows, broadcast), weights are
summed by line, and a softmax follows. Only lines with a feature are shuffled.

A line is a notice when another class than "none" is likelier. It is ``confirmed`` when its
probability reaches the bar, calibrated so that at most ``FALSE_RATE`` of held-out ordinary lines do, and it
shares ``SHARE`` of the features of some template of its family; otherwise the family is ``unknown``.

Defined results: null and empty texts have no notices; equal rows give equal results each; a line
without any feature is no notice; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, drawn

SAMPLE = 4000
FEATURES = 2000
VARIANTS = 24
FALSE_RATE = 0.001
SHARE = 0.6
NONE = "none"

#: Usual short notices and opening sentences of public licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    ),
}


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(line: Column) -> Column:
    """The distinct words and word pairs of ``line``."""
    pairs = lambda w: F.concat(w, F.transform(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"])))
    return F.array_distinct(F.element_at(F.transform(F.array(words_of(line)), pairs), 1))


@dataclass
class Model:
    """Feature weights by class, intercepts, the bar, and the features of each template."""

    classes: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    bar: float
    templates: list[tuple[str, list[int]]]


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("text")) for family, texts in TEMPLATES.items() for text in texts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def sample_lines(docs: DataFrame) -> DataFrame:
    """(text): at most ``SAMPLE`` lines of the corpus, one of a document, drawn by a hash of its id and text."""
    hashed = doc_rows(docs, "doc_id", "text").where("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    lines = F.split("text", "\n")
    line = F.get(lines, F.pmod(F.col("h"), F.size(lines).cast("long")).cast("int"))
    return drawn(hashed.drop("doc_id"), SAMPLE, "h").select(line.alias("text"))


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    known = _templates(spark).select("family", "text", grams_of(F.col("text")).alias("grams"))
    templates = known.collect()
    own = sorted({g for r in templates for g in r["grams"]})
    lines = sample_lines(docs).select(grams_of(F.col("text")).alias("grams"), F.col("text")).collect()  # SAMPLE lines at most
    strong = {g for g in own if " " in g}
    ordinary = [r for r in lines if len(strong.intersection(r["grams"])) < 2]
    seen: dict[str, int] = {}
    for row in ordinary:
        for gram in row["grams"]:
            seen[gram] = seen.get(gram, 0) + 1
    vocabulary = [g for g in own if seen.get(g, 0) <= max(2, 0.002 * len(ordinary))][:FEATURES]
    classes = [NONE, *TEMPLATES]
    kept = F.filter(F.split("text", " "), lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(7)) != 0)
    altered = (
        _templates(spark).select("family", "text", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))).alias("variant"))
        .withColumn("text", F.when(F.col("variant") == 0, F.col("text")).otherwise(F.array_join(kept, " ")))
        .select("family", grams_of(F.col("text")).alias("grams"), F.pmod("variant", F.lit(2)).alias("held"))
    )
    rows = [Row(family=NONE, grams=r["grams"], held=i % 2) for i, r in enumerate(ordinary)]
    rows += [Row(family=NONE, grams=[g], held=0) for g in vocabulary if " " not in g]
    examples = altered.unionByName(spark.createDataFrame(rows, "family string, grams array<string>, held int"))
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").transform(examples.withColumn("label", number.cast("double"))).cache()
    fitted = LogisticRegression(maxIter=40, regParam=0.002, family="multinomial").fit(vectors.where("held = 0"))
    top = fitted.transform(vectors.where(f"held = 1 and family = '{NONE}'")).select("probability").collect()
    likely = sorted((max(r["probability"].toArray()[1:]) for r in top), reverse=True)
    allowed = int(FALSE_RATE * len(likely))
    bar = max(0.5, likely[allowed] if allowed < len(likely) else 0.5)
    vectors.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    place = {g: i for i, g in enumerate(vocabulary)}
    return Model(
        classes,
        {g: [float(x) for x in matrix[:, i]] for g, i in place.items()},
        [float(x) for x in fitted.interceptVector],
        float(bar),
        [(r["family"], sorted(place[g] for g in r["grams"] if g in place)) for r in templates],
    )


def notices(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, family, probability, template_share, status) for each line that is a licence notice."""
    spark = docs.sparkSession
    rows = [(g, i, w) for i, (g, w) in enumerate(model.weights.items())]
    features = F.broadcast(spark.createDataFrame(rows, "gram string, feature int, weights array<double>"))
    lines = doc_rows(docs, "doc_id", "text").select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "content")
    )
    words = lines.select("doc_id", "row", "line", F.split("content", r"[^\p{L}\p{N}]+").alias("words"))
    words = words.withColumn("next", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))))
    pairs = words.select("doc_id", "row", "line", F.explode(F.arrays_zip("words", "next")).alias("p"))
    grams = pairs.select("doc_id", "row", "line", F.explode(F.array(F.col("p.words"), F.concat_ws(" ", "p.words", "p.next"))).alias("gram"))
    sums = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(len(model.classes))]
    met = grams.join(features, "gram").groupBy("row", "line", "feature").agg(F.first("doc_id").alias("doc_id"), F.first("weights").alias("weights"))
    scored = met.groupBy("row", "line").agg(F.first("doc_id").alias("doc_id"), F.collect_list("feature").alias("features"), *sums)
    logits = F.array(*[F.col(f"s{k}") + F.lit(b) for k, b in enumerate(model.intercepts)])
    placed = scored.select("doc_id", "line", "features", logits.alias("logits"))
    peak = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logits")))
    best = placed.withColumn("class", (F.array_position("logits", peak) - 1).cast("int")).where(F.col("class") != 0)
    share = F.lit(0.0)
    for family, own in model.templates:
        if own:
            part = F.size(F.array_intersect("features", F.array(*map(F.lit, own)))) / F.lit(float(len(own)))
            share = F.greatest(share, F.when(F.col("class") == model.classes.index(family), part).otherwise(F.lit(0.0)))
    judged = best.select("doc_id", "line", "class", (F.lit(1.0) / total).alias("probability"), share.alias("template_share"))
    good = (F.col("probability") >= model.bar) & (F.col("template_share") >= SHARE)
    return judged.select(
        "doc_id",
        "line",
        F.when(good, F.element_at(F.array(*map(F.lit, model.classes)), F.col("class") + 1)).otherwise(F.lit("unknown")).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round("template_share", 6).alias("template_share"),
        F.when(good, F.lit("confirmed")).otherwise(F.lit("unknown")).alias("status"),
    )

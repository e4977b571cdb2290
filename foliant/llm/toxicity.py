"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of letters and digits; its embedding is the sum of three rows of one
hashed table: the word and its first four and six bytes, so that inflected forms share
a stem. Filters of widths one to three run over all words of a text, each filter's
largest response feeds a logistic unit. Fitting takes a bounded sample of labelled
texts; scoring reads every text whole. Thresholds for a decision are calibrated by
language over all labelled rows outside the held-out fold; the score itself never sees
the language.

Defined results: a null or empty text has no words and gets the score of all-zero
responses; repeated rows get the same score each; without labelled rows of both classes
every score is the neutral 0.25; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from foliant.llm.common import doc_rows, drawn, fold_of
from foliant.llm.words import batches, word_hashes

BUCKETS = 1 << 16
DIMS = 8
FILTERS = 4
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
NEUTRAL = 0.25
#: Words of a long text that are scored at once.
CHUNK = 1 << 18


@dataclass
class Model:
    """Embeddings (BUCKETS x DIMS), a tap matrix for each width, and the output unit. About 2 MB, whatever the data."""

    table: np.ndarray
    taps: list[np.ndarray]  # by width: (width, DIMS, FILTERS)
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers of the word and its two prefixes, word offsets of n + 1 texts)."""
    hashes, offsets = word_hashes(texts, letters=True, prefixes=PREFIXES)
    return (hashes >> np.uint64(48)).astype(np.uint16), offsets


def _responses(model: Model, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest response of each filter per text; a filter wider than a text gives 0."""
    if len(offsets) == 2 and len(ids) > CHUNK:  # one long text: the largest over overlapping pieces
        step, lap = CHUNK - max(WIDTHS), max(WIDTHS) - 1
        pieces = (ids[a : a + step + lap] for a in range(0, len(ids), step))
        return np.max([_responses(model, x, np.array([0, len(x)])) for x in pieces], axis=0)
    pooled = np.zeros((len(offsets) - 1, FILTERS * len(WIDTHS)), np.float32)
    words = model.table[ids[:, 0]] + model.table[ids[:, 1]] + model.table[ids[:, 2]]
    lengths = np.diff(offsets)
    for k, width in enumerate(WIDTHS):
        have = np.flatnonzero(lengths >= width)
        if not len(have):
            continue
        n = len(words) - width + 1
        z = words[:n] @ model.taps[k][0]
        for tap in range(1, width):
            z += words[tap : n + tap] @ model.taps[k][tap]
        z += model.shift[k]
        for back in range(1, width):  # windows across the end of a text
            across = offsets[1:] - back
            z[across[(across >= 0) & (across < n)]] = -1e9
        pooled[have, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, offsets[have], axis=0), 0)
    return pooled


def _winners(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _responses, with the word where each filter's window begins; text by text, for fitting."""
    texts = len(offsets) - 1
    pooled = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
    places = np.full(pooled.shape, -1, np.int64)
    words = model.table[ids[:, 0]] + model.table[ids[:, 1]] + model.table[ids[:, 2]]
    for k, width in enumerate(WIDTHS):
        n = len(words) - width + 1
        if n <= 0:
            continue
        z = sum(words[tap : n + tap] @ model.taps[k][tap] for tap in range(width)) + model.shift[k]
        for t in range(texts):
            a, b = offsets[t], offsets[t + 1] - width + 1
            if b > a:
                best = z[a:b].argmax(axis=0)
                value = z[a + best, np.arange(FILTERS)]
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[t, columns] = np.maximum(value, 0)
                places[t, columns] = np.where(value > 0, a + best, -1)
    return pooled, places


def train(ids: list[np.ndarray], labels: np.ndarray, epochs: int = 4, seed: int = 5) -> Model:
    """Fits the network by stochastic gradient steps with per-weight step sizes.

    The table starts from smoothed log odds of each bucket on one half of the texts;
    the gradient steps then use the other half, so that words seen once cannot
    stand in for the label.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(ids))
    first, second = order[: len(order) // 2], order[len(order) // 2 :]
    seen = np.zeros((2, BUCKETS))
    for i in first:
        seen[labels[i], np.unique(ids[i])] += 1
    groups = np.array([max(1, (labels[first] == y).sum()) for y in (0, 1)])
    odds = np.log((seen[1] + 1) / (groups[1] + 2)) - np.log((seen[0] + 1) / (groups[0] + 2))
    odds[seen.sum(axis=0) < 4] = 0
    size = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32),
        [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, -0.2, np.float32) for _ in WIDTHS],
        np.full(size, 0.3, np.float32),
        -1.0,
    )
    model.table[:, 0] = np.clip(odds, -4, 4) / 4
    for taps in model.taps:
        taps[:, 0, :] = np.abs(taps[:, 0, :]) + 0.5
    memory = [np.full_like(a, 1e-3) for a in (model.table, *model.taps, *model.shift, model.out)]
    bias_memory = 1e-3
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    for epoch in range(epochs):
        rate = 0.03 / (1 + epoch)
        second = rng.permutation(second)
        for at in range(0, len(second), 32):
            some = second[at : at + 32]
            offsets = np.concatenate([[0], np.cumsum([len(ids[i]) for i in some])])
            rows = np.concatenate([ids[i] for i in some]) if offsets[-1] else np.zeros((0, 3), np.uint16)
            pooled, places = _winners(model, rows, offsets)
            p = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
            error = ((p - labels[some]) * weight[labels[some]] / len(some)).astype(np.float32)
            down = error[:, None] * model.out * (places >= 0)
            grads = [np.zeros_like(a) for a in (*model.taps, *model.shift)]
            touched, pushes = [], []
            for k, width in enumerate(WIDTHS):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                t, f = np.nonzero(places[:, columns] >= 0)
                if not len(t):
                    continue
                g, where = down[:, columns][t, f], places[:, columns][t, f]
                np.add.at(grads[len(WIDTHS) + k], f, g)
                for tap in range(width):
                    used = rows[where + tap]
                    words = model.table[used].sum(axis=1)
                    np.add.at(grads[k][tap].T, f, g[:, None] * words)
                    touched.append(used.ravel())
                    pushes.append(np.repeat(g[:, None] * model.taps[k][tap][:, f].T, 3, axis=0))
            steps = [*grads, pooled.T @ error]
            for param, memo, grad in zip([*model.taps, *model.shift, model.out], memory[1:], steps, strict=True):
                memo += grad * grad
                param -= rate * grad / np.sqrt(memo)
            bias_memory += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / bias_memory**0.5
            if touched:
                where, back = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(where), DIMS), np.float32)
                np.add.at(grad, back, np.concatenate(pushes))
                memory[0][where] += grad * grad
                model.table[where] -= rate * grad / np.sqrt(memory[0][where])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5000, longest: int = 20_000) -> Model | None:
    """A model from at most ``sample`` labelled texts (half of each class at most) of up to ``longest`` words.

    These two are the bounds of the fitting sample; the rows are drawn by a hash of
    their id. Rows of the held-out fold, null labels and repeated ids (the larger
    label counts) are settled before. None without texts of both classes.
    """
    marks = (
        doc_rows(labels, "doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    clean, toxic = (drawn(marks.where(F.col("toxic") == y), sample // 2, "doc_id") for y in (0, 1))
    texts = doc_rows(docs, "doc_id", "text").join(F.broadcast(clean.unionByName(toxic)), "doc_id")

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            ids, offsets = features(batch.column(batch.schema.get_field_index("text")))
            packed = [ids[a:b].tobytes() if b - a <= longest else None for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("toxic")), pa.array(packed, pa.binary())],
                ["doc_id", "toxic", "ids"],
            )

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(encode, "doc_id long, toxic int, ids binary").where("ids is not null").collect()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    labels_of = np.array([int(r["toxic"]) for r in rows], int)
    if len(set(labels_of.tolist())) < 2:
        return None
    return train([np.frombuffer(r["ids"], np.uint16).reshape(-1, 1 + len(PREFIXES)) for r in rows], labels_of)


def score_texts(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(texts), NEUTRAL)
    ids, offsets = features(texts)
    pooled = _responses(model, ids, offsets)
    return 1 / (1 + np.exp(-(pooled @ model.out + model.bias).astype(np.float64)))


def with_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, so that no column can clash, and its score from 0 to 1.

    Only texts are sent to Python and only scores come back; the rows wait in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            rows = [pa.record_batch([array], ["text"])]
            scores = [score_texts(shared.value, some.column(0)) for some in batches(rows, "text", 1 << 20)]
            yield pa.array(np.concatenate([np.zeros(0), *scores]))

    of_text = F.arrow_udf(score, "double", PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of_text(text).alias("score"))


def thresholds(scored: DataFrame, labels: DataFrame, false_rate: float = 0.01) -> dict[str, float]:
    """By language, the lowest bar (of 100 steps, 0.2 at least) that at most ``false_rate`` of clean labelled rows reach.

    Counts cover all labelled rows outside the held-out fold; a language without
    such rows has no entry (use 0.5).
    """
    marks = doc_rows(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = (
        scored.select("row.doc_id", F.coalesce(F.col("row.lang"), F.lit("")).alias("lang"), F.floor(F.col("score") * 100).cast("int").alias("step"))
        .where(fold_of("doc_id") != 0)
        .join(marks, "doc_id")
        .where(F.col("toxic") == 0)
        .groupBy("lang", "step")
        .count()
        .groupBy("lang")
        .agg(F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("steps"))
    )
    bars = {}
    for row in counts.collect():  # a row for each language
        total, above = sum(row["steps"].values()), 0
        bar = 101
        while bar > 20 and above + row["steps"].get(bar - 1, 0) <= false_rate * total:
            bar -= 1
            above += row["steps"].get(bar, 0)
        bars[row["lang"]] = min(bar, 100) / 100
    return bars


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the bar of their language."""
    model = fit(docs, labels)
    if model is None:
        return docs
    bars = thresholds(with_scores(doc_rows(docs, "doc_id", "text", "lang"), model), labels)
    bar = F.lit(0.5)
    for lang, value in sorted(bars.items()):
        bar = F.when(F.coalesce(F.col("row.lang"), F.lit("")) == lang, F.lit(value)).otherwise(bar)
    return with_scores(docs, model).where(F.col("score") < bar).select("row.*")

"""Importance resampling: draw the documents that look most like a target, with hashed n-gram weights.

1. Words (runs of letters, digits and non-ASCII characters) and their pairs are hashed into
   buckets; a task sums its counts in one array and hands on an array of ``BUCKETS`` counts.
2. A bucket's gain is the scaled log ratio of its smoothed shares in target and corpus; a
   document's weight is the floored mean of its features' gains, read from an array.
3. Weight plus Gumbel noise, drawn from the id, is the score; the highest scores are a sample
   without replacement in proportion to the weights.
4. The cutoff is bracketed by a quantile sketch (``percentile_approx``). Exact counts outside
   the bracket validate it, or the next wider one of a ladder; the bracket is bracketed again
   until at most ``SORTED`` rows are left, and only these are sorted.
5. Drawn rows are dealt out by ranges of their order, so that a rank is a place in a range plus
   the counts of those before.

Defined results: a null text has no features and weight 0, as an empty one; repeated rows are
scored and drawn one by one, those of an equal score in the order of doc_id, then of their place
in the stored table; a row without id has a weight but no score, is not counted among the
eligible ones and is never drawn; an empty table gives no rows, an empty target flat gains; extra
columns are ignored. Texts are read whole, in slices.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, stored
from foliant.llm.words import batches, text_buffer

BUCKETS = 10_000
SCALE = 1000
#: Rows that are sorted to read the cutoff.
SORTED = 100_000
#: Inverse of the sketch's error, as a share of the rows.
ACCURACY = 10_000
SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
SHORT = 64

_ALL = np.uint32(0xFFFFFFFF)
_word_byte = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_table = _byte_table()


def _zeros(state: np.ndarray) -> np.ndarray:
    return _table[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """[n][k][b]: what byte b at place k of a checksum becomes when n zero bytes follow."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = _zeros(out[n])
    return out


_shift = _shift_tables()


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word of ``data``."""
    sizes = ends - starts
    out = np.full(len(starts), _ALL)
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    order = order[np.count_nonzero(sizes > SHORT) :]
    left = sizes[order]
    for j in range(int(left[0]) if len(left) else 0):
        order = order[: np.count_nonzero(left > j)]
        left = left[: len(order)]
        state = out[order]
        out[order] = _table[(state ^ data[starts[order] + j]) & np.uint32(255)] ^ (state >> np.uint32(8))
    out ^= _ALL
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def pair_checksums(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of "first second": the first's checksum is carried over a space and ``sizes`` bytes of the second."""
    state = first ^ _ALL
    spaced = _table[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ _ALL
    n = np.minimum(sizes, SHORT)
    out = second.copy()
    for k in range(4):
        out ^= _shift[n, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(spaced[i]))
    return out


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: owners and buckets of words, owners and buckets of pairs. Slices end at word ends."""
    raw, places = text_buffer(texts)
    at, last, last_owner = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    while at < len(raw):
        to = min(at + SLICE, len(raw))
        text_end = int(places[np.searchsorted(places, to)])
        while to < text_end and _word_byte[raw[to]]:
            gap = np.flatnonzero(~_word_byte[raw[to : min(to + 4096, text_end)]])
            to = to + int(gap[0]) if len(gap) else min(to + 4096, text_end)
        data = _lower[raw[at:to]]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _word_byte[data]
        begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = places[np.searchsorted(places, at, "right") : np.searchsorted(places, to)] - at  # texts that touch
        begin[cuts] |= inside[1:-1][cuts]
        stop[cuts - 1] |= inside[1:-1][cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        owner = np.searchsorted(places, starts + at, "right") - 1
        own = word_checksums(data, starts, ends)
        before, before_owner = np.concatenate([last, own[:-1]]), np.concatenate([last_owner, owner[:-1]])
        skip = len(own) - len(before)  # the first word of all has none before it
        same = np.flatnonzero(before_owner == owner[skip:])
        here = same + skip
        pairs = pair_checksums(before[same], own[here], (ends - starts)[here], data, starts[here])
        yield owner, own % np.uint32(BUCKETS), owner[here], pairs % np.uint32(BUCKETS)
        if len(own):
            last, last_owner = own[-1:], owner[-1:]
        at = to


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all rows of ``texts`` (a column ``text``) in each bucket; ``BUCKETS`` sums reach the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches(rows, "text", 2 << 20):
            for _, words, _, pairs in features(batch.column(0)):
                total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    sums = doc_rows(texts, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * log ratio) of the smoothed shares in ``target`` and ``corpus``."""
    total, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = (target + 1.0) * total / ((corpus + 1.0) * wanted)
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in batches(rows, "text", 2 << 20):
            n = batch.num_rows
            words, pairs, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, own, pair_owner, pair in features(batch.column(1)):
                words += np.bincount(owner, minlength=n)
                pairs += np.bincount(pair_owner, minlength=n)
                sums += np.bincount(owner, gain[own], n).astype(np.int64) + np.bincount(pair_owner, gain[pair], n).astype(np.int64)
            count = words + pairs
            weight = np.where(count > 0, sums // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return doc_rows(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def score(weight: Column, doc_id: Column, seed: int) -> Column:
    """Weight plus Gumbel noise in units of 1 / SCALE; the noise depends on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))
    return weight + F.floor(noise)


def cutoff(rows: DataFrame, keys: list[str], k: int, enough: int = SORTED) -> tuple:
    """The ``keys`` of the k-th row of ``rows`` in their ascending order (1 <= k <= number of rows).

    ``keys`` are whole numbers that together tell rows apart. Each turn reads narrow rows twice: for the sketch, and for
    exact counts below and inside each bracket of the ladder. The last bracket runs from the least to the largest
    value, so that one always holds the k-th row. Its two ends are settled by counts; the values between them,
    or the rows of one value by their next key, are what is left.
    """
    fixed: list = []
    left = rows
    while True:
        key = F.col(keys[len(fixed)])
        total = left.count()
        if total <= enough:
            return tuple(left.select(*keys).orderBy(*keys).offset(k - 1).limit(1).first())
        steps = [2.0 ** (2 * j + 1) / ACCURACY for j in range(8)]
        wanted = [min(1.0, max(0.0, k / total + side * s)) for s in steps for side in (-1, 1)]
        sketch = left.agg(F.percentile_approx(key, wanted, ACCURACY).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        ladder = [*zip(sketch["q"][::2], sketch["q"][1::2]), (sketch["lo"], sketch["hi"])]
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        tests = [t for lo, hi in ladder for t in (key < lo, key == lo, (key > lo) & (key < hi), key == hi)]
        found = list(left.agg(*[count(t).alias(f"c{i}") for i, t in enumerate(tests)]).first())
        for i, (lo, hi) in enumerate(ladder):
            below, low, between, high = found[4 * i : 4 * i + 4]
            high = high if hi != lo else 0
            if below < k <= below + low + between + high:
                break
        if k <= below + low:
            left, k = left.where(key == lo), k - below
            fixed.append(lo)
        elif k > below + low + between:
            left, k = left.where(key == hi), k - below - low - between
            fixed.append(hi)
        else:
            left, k = left.where((key > lo) & (key < hi)), k - below - low
        if len(fixed) == len(keys):
            return tuple(fixed)


def up_to(keys: list[str], values: tuple) -> Column:
    """Whether a row's ``keys`` come at or before ``values``."""
    out = F.lit(True)
    for name, value in reversed(list(zip(keys, values))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` (from 1) in the ascending order of ``keys``: ranges of the order are sorted side by side."""
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_place", 33)
    before, starts = 0, []
    for row in placed.groupBy(part.alias("_part")).count().orderBy("_part").collect():  # a row for each range
        starts.append((row["_part"], before))
        before += row["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + inside + 1).drop("_part", "_before", "_place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, enough: int = SORTED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``; ``rank`` is null for undrawn rows.

    ``percent`` of the rows with an id and at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", score(F.col("weight"), F.col("doc_id"), seed))
    keyed = stored(scored.withColumns({"_down": -F.col("score"), "_row": F.monotonically_increasing_id()}), "scored")
    keys = ["_down", "doc_id", "_row"]
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    k = percent * keyed.where(eligible).count() // 100
    none = F.lit(None).cast("long")
    if not k:
        return keyed.drop("_down", "_row").withColumn("rank", none)
    taken = eligible & up_to(keys, cutoff(keyed.where(eligible).select(*keys), keys, k, enough))
    drawn = ranked(keyed.where(taken), keys)
    return drawn.unionByName(keyed.where(~F.coalesce(taken, F.lit(False))).withColumn("rank", none)).drop("_down", "_row")

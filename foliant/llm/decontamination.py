"""Benchmark passages in documents, found by latent semantic retrieval and confirmed on the words.

1. Document frequencies of the benchmark's words over all passages of the corpus (runs of
   ``PASSAGE`` words) give TF-IDF weights; words in over 1 % of the passages weigh nothing.
2. A randomised decomposition of the TF-IDF matrix: one more pass sums A'(A W) for a random
   W, every task for its own passages. The items' own directions come first, exactly, then
   the corpus's leading ones: ``RANK`` dimensions, so an item keeps its whole length.
3. Every window of two half passages of every text meets every item in that space; the
   cosine uses the window's full norm. Windows at ``COSINE`` or above are candidates.
4. Independent of weights and bars, the rarest words of each item lead to the runs of half
   passages that hold as many of them as any confirmed copy must: further candidates, so that
   items of common words, long ones (of which a window is a small part) and short ones (a small
   part of a window), and other copies that the space ranks too low, are found as well.
5. A candidate is confirmed by the longest common subsequence of words about the window,
   and by the part of it that falls on the item's answer (what follows the last question
   mark, else its last fifth).

Items come in blocks of at most ``RANK``, each with three passes (rows are fetched ``ITEMS`` at a
time); a block's word table has at most ``BUCKETS`` rows, so broadcasts have one bound (about
30 MB) for any corpus or benchmark.

Defined results: null or empty texts and items match nothing; items under ``SHORT`` words
must be found word by word; repeated rows give one pair; an empty corpus or benchmark gives
no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, stored
from foliant.llm.words import batches, mix, word_hashes

PASSAGE = 32
HALF = PASSAGE // 2
RANK = 224
EXTRA = 8
BUCKETS = 1 << 15
ITEMS = 20_000
COMMON = 0.01
COSINE = 0.4
LCS = 0.7
LCS_ALONE = 0.85
ANSWER = 0.5
SHORT = 5


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    answers: list[int]  # words of the answer, at the end
    vocabulary: np.ndarray  # sorted hashes of all items' words

    @property
    def buckets(self) -> int:
        return min(len(self.vocabulary), BUCKETS)

    def columns(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that an item has, their bucket)."""
        heads = np.zeros(1 << 18, bool)
        heads[self.vocabulary >> np.uint64(46)] = True
        have = np.flatnonzero(heads[hashes >> np.uint64(46)])
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes[have]), len(self.vocabulary) - 1)
        same = self.vocabulary[spot] == hashes[have]
        have, spot = have[same], spot[same]
        return have, spot if len(self.vocabulary) <= BUCKETS else (mix(hashes[have]) % np.uint64(BUCKETS)).astype(np.int64)


def read_items(rows: list) -> Items:
    ids, words, answers = [], [], []
    for row in rows:
        text = row["text"] or ""
        hashes, _ = word_hashes(pa.array([text]), letters=True)
        if row["item_id"] is None or not len(hashes):
            continue
        tail = text.rpartition("?")[2] if "?" in text.rstrip()[:-1] else ""
        answer = len(word_hashes(pa.array([tail]), letters=True)[0]) if tail.strip() else 0
        ids.append(row["item_id"]), words.append(hashes), answers.append(answer or -(-len(hashes) // 5))
    return Items(ids, words, answers, np.unique(np.concatenate([np.zeros(0, np.uint64), *words])))


def _passages(offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(half passage of each word, text of each half passage); half passages do not cross texts."""
    lengths = np.diff(offsets)
    halves = -(-lengths // HALF)
    first = np.concatenate([[0], np.cumsum(halves)])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return first[owner] + (np.arange(words) - offsets[owner]) // HALF, np.repeat(np.arange(len(lengths)), halves)


def _frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """(passages that have each bucket's word, number of passages)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches(rows, "text", 2 << 20):
            hashes, offsets = word_hashes(batch.column(0), letters=True)
            half, _ = _passages(offsets, len(hashes))
            have, column = shared.value.columns(hashes)
            pairs = np.unique(half[have] * BUCKETS + column)
            counts[:-1] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            counts[-1] += half[-1] + 1 if len(half) else 0
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    found = np.zeros(BUCKETS + 1, np.int64)
    summed = doc_rows(docs, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # BUCKETS + 1 rows at most
        found[row["bucket"]] = row["n"]
    return found[:-1], int(found[-1])


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, sums of ``values``) over runs of equal, sorted ``rows``."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts], np.add.reduceat(values, starts, axis=0)


def _random(rows: int, size: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((rows, size), np.float32)


def _corpus_sums(docs: DataFrame, items: Items, weight: np.ndarray, size: int) -> np.ndarray:
    """A'(A W) for the TF-IDF matrix A of all half passages."""
    shared = docs.sparkSession.sparkContext.broadcast((items, weight))

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        random, total = _random(items.buckets, size), np.zeros((items.buckets, size), np.float32)
        for batch in batches(rows, "text", 1 << 20):
            hashes, offsets = word_hashes(batch.column(0), letters=True)
            half, _ = _passages(offsets, len(hashes))
            have, column = items.columns(hashes)
            keep = weight[column] > 0
            half, column = half[have][keep], column[keep]
            for at in range(0, len(column), 1 << 16):
                own, c = half[at : at + (1 << 16)], column[at : at + (1 << 16)]
                value = weight[c][:, None]
                passages, mapped = _sums(own, value * random[c])
                order = np.argsort(c, kind="stable")
                part = mapped[np.searchsorted(passages, own[order])]
                part *= value[order]
                buckets, sums = _sums(c[order], part)
                total[buckets] += sums
        some = np.flatnonzero(total.any(axis=1))
        total, buckets = total[some], some.astype(np.int32)
        for at in range(0, len(buckets), 2000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[at : at + 2000]), pa.array([v.tobytes() for v in total[at : at + 2000]], pa.binary())], ["bucket", "sums"]
            )

    def merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[bucket] = sums.get(bucket, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
        if sums:
            values = pa.array([v.tobytes() for v in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["bucket", "sums"])

    kind = "bucket int, sums binary"
    rows = doc_rows(docs, "text").mapInArrow(partial, kind).repartition("bucket").mapInArrow(merged, kind).collect()
    total = np.zeros((items.buckets, size))
    for row in rows:  # BUCKETS rows at most
        total[row["bucket"]] = np.frombuffer(row["sums"], np.float64)
    return total


def latent_space(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passages by bucket, IDF weight by bucket, word vectors scaled by it, items' vectors of unit norm)."""
    counts, passages = _frequencies(docs, items)
    weight = np.log((passages + 1) / (counts + 0.5)).astype(np.float32)
    weight[counts > max(COMMON * passages, 20)] = 0
    weight = np.maximum(weight, 0)[: items.buckets]
    size = RANK + EXTRA
    total = _corpus_sums(docs, items, weight, size)
    rows = [items.columns(w)[1] for w in items.words]
    tfidf = np.zeros((len(rows), len(np.unique(np.concatenate(rows)))), np.float32)
    used = np.unique(np.concatenate(rows))
    for i, columns in enumerate(rows):
        np.add.at(tfidf[i], np.searchsorted(used, columns), weight[columns])
    span, length, _ = np.linalg.svd(tfidf.T.astype(np.float64), full_matrices=False)
    own = np.zeros((items.buckets, int((length > 1e-6 * max(length.max(), 1e-9)).sum())))
    own[used] = span[:, : own.shape[1]]
    random = _random(items.buckets, size)
    shift = 1e-6 * np.linalg.norm(total) + 1e-9
    total = total + shift * random
    core = random.T.astype(np.float64) @ total
    value, vector = np.linalg.eigh((core + core.T) / 2)
    root = vector / np.sqrt(np.maximum(value, shift * 1e-6 + 1e-12))
    led = total @ root
    rest, length, _ = np.linalg.svd(led - own @ (own.T @ led), full_matrices=False)
    rest = rest[:, length > 1e-6 * np.linalg.norm(led)][:, : RANK - own.shape[1]]
    basis = np.concatenate([own, rest], axis=1).astype(np.float32)
    targets = tfidf @ basis[used]
    return counts, weight, basis * weight[:, None], targets / np.maximum(np.linalg.norm(targets, axis=1), 1e-9)[:, None]


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of ``item``."""
    bits: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        bits[word] = bits.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in text.tolist():
        if hit := bits.get(word, 0) & row:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _span(n: int) -> int:
    """Words that a confirmed item of ``n`` words lies in."""
    return n + n // 4 + 2


def confirm(item: np.ndarray, answer: int, text: np.ndarray) -> tuple[float, float, int] | None:
    """(share of the item, share of its answer, place) where ``text`` holds it best; None where not confirmed."""
    n = len(item)
    if n < SHORT:
        for at in range(len(text) - n + 1):
            if (text[at : at + n] == item).all():
                return 1.0, 1.0, at
        return None
    width, best = _span(n), (0.0, 0.0, 0)
    known = np.isin(text, item)
    for at in range(0, max(1, len(text) - width + max(1, n // 4)), max(1, n // 4)):
        if known[at : at + width].sum() >= LCS * n:
            piece = text[at : at + width]
            found = (common_words(item, piece) / n, common_words(item[n - answer :], piece) / answer, at)
            best = max(best, found)
    share, answered, _ = best
    return best if share >= LCS_ALONE or share >= LCS and answered >= ANSWER else None


def _least_words(items: Items, weight: np.ndarray) -> int:
    """Weighted words that some window on a confirmed item has at least: a share of 1 - LCS of its words may be others'."""
    least = np.inf
    for words in items.words:
        known, n = int((weight[items.columns(words)[1]] > 0).sum()), len(words)
        least = min(least, (known - (1 - LCS) * n) * min(1, HALF / n))
    return max(1, int(least))


@dataclass
class RareWords:
    """Items by their rarest words; a confirmed copy has ``least`` of them in ``reach`` half passages."""

    starts: np.ndarray  # by bucket, into ``owners``
    owners: np.ndarray
    least: np.ndarray  # by item, as ``reach``
    reach: np.ndarray

    def runs(self, column: np.ndarray, half: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first half passage, the one after the last); ``ends``: by half passage, the first one of the next text."""
        n = self.starts[column + 1] - self.starts[column]
        column, half, n = column[n > 0], half[n > 0], n[n > 0]
        place = np.arange(n.sum()) + np.repeat(self.starts[column] - (np.cumsum(n) - n), n)
        most = len(ends) + 1
        keys, counts = np.unique(self.owners[place] * most + np.repeat(half, n), return_counts=True)
        item, first = keys // most, keys % most
        last = np.minimum(first + self.reach[item], ends[first])
        upto = np.concatenate([[0], np.cumsum(counts)])
        held = upto[np.searchsorted(keys, item * most + last)] - upto[:-1]
        hit = np.flatnonzero(held >= self.least[item])
        item, first, last = item[hit], first[hit], last[hit]
        apart = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (first >= np.concatenate([[0], last[:-1]])) | (ends[first] != np.concatenate([[0], ends[first[:-1]]])))
        stop = np.append(apart[1:], len(item)) - 1 if len(item) else apart
        yield from zip(item[apart].tolist(), first[apart].tolist(), last[stop].tolist())


def rare_words(items: Items, counts: np.ndarray) -> RareWords:
    """Of an item, n - need words may be missing: of any n - need + least of its words, ``least`` are there."""
    buckets, owners, least, reach = [], [], [], []
    for i, words in enumerate(items.words):
        n = len(words)
        need = math.ceil(LCS * n - 1e-9) if n >= SHORT else n
        least.append(max(1, need // 3) if n >= SHORT else n), reach.append((HALF + _span(n) - 2) // HALF + 1)
        column = items.columns(words)[1]
        some = np.unique(column[np.argsort(counts[column], kind="stable")[: n - need + least[-1]]])
        buckets.append(some), owners.append(np.full(len(some), i))
    column, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (buckets, owners))
    starts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=items.buckets))])
    return RareWords(starts, owner[np.argsort(column, kind="stable")], np.array(least), np.array(reach))


def _search(docs: DataFrame, items: Items) -> DataFrame:
    counts, weight, vectors, targets = latent_space(docs, items)
    least = _least_words(items, weight)
    shared = docs.sparkSession.sparkContext.broadcast((items, weight, vectors, targets, rare_words(items, counts)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, vectors, targets, rare = shared.value
        for batch in batches(rows, "text", 2 << 20):
            hashes, offsets = word_hashes(batch.column(1), letters=True)
            half, owner = _passages(offsets, len(hashes))
            have, column = items.columns(hashes)
            first = np.searchsorted(owner, np.arange(len(offsets)))
            runs: dict[tuple[int, int], list] = {}
            for item, a, b in rare.runs(column, half[have], first[owner + 1]):
                runs.setdefault((int(owner[a]), item), []).append((a, b))
            live = weight[column] > 0
            have, column = have[live], column[live]
            places = half[have]
            near: dict[tuple[int, int], list] = {}
            step = 8192
            for at in range(0, len(owner), step):
                to = min(at + step + 1, len(owner))
                a, b = np.searchsorted(places, [at, to])
                if a == b:
                    continue
                c, place = column[a:b], places[a:b] - at
                counts, norms = np.bincount(place, minlength=to - at), np.bincount(place, weight[c].astype(np.float64) ** 2, to - at)
                joined = np.append(owner[at : to - 1] == owner[at + 1 : to], False)
                counts[:-1] += counts[1:] * joined[:-1]
                live = np.flatnonzero(counts[: min(step, to - at)] >= least)
                sums = np.zeros((to - at + 1, vectors.shape[1]), np.float32)
                rows, values = _sums(place, vectors[c])
                sums[rows] = values
                norms[:-1] += norms[1:] * joined[:-1]
                windows = sums[live] + sums[live + 1] * joined[live, None]
                cosine = windows @ targets.T / np.sqrt(norms[live])[:, None].astype(np.float32)
                for window, item in zip(*np.nonzero(cosine >= COSINE)):
                    key = (int(owner[at + live[window]]), int(item))
                    near.setdefault(key, []).append((at + int(live[window]), float(cosine[window, item])))
            out: list[list] = [[], [], [], [], [], []]
            for text, item in dict.fromkeys([*near, *runs]):
                n, best, done = len(items.words[item]), None, -1
                for window, cosine in near.get((text, item), []):
                    place = (window - first[text]) * HALF
                    lo, hi = max(0, place - n, done), min(offsets[text + 1] - offsets[text], place + PASSAGE + n)
                    found = confirm(items.words[item], items.answers[item], hashes[offsets[text] + lo : offsets[text] + hi])
                    if found and (best is None or found[0] > best[0]):
                        best = (found[0], found[1], cosine, int(lo + found[2]))
                for a, b in runs.get((text, item), []):
                    if best and best[0] == 1:
                        break
                    step, words = max(1, n // 4), hashes[offsets[text] : offsets[text + 1]]
                    lo = max(0, (a - first[text]) * HALF - _span(n)) // step * step
                    found = confirm(items.words[item], items.answers[item], words[lo : (b - first[text]) * HALF + _span(n)])
                    if found and (best is None or found[0] > best[0]):
                        at = int(lo + found[2])
                        c = items.columns(words[at : at + PASSAGE])[1]
                        norm = max(float(np.linalg.norm(weight[c])), 1e-9)
                        best = (found[0], found[1], float(vectors[c].sum(axis=0) @ targets[item]) / norm, at)
                if best:
                    for values, value in zip(out, (batch.column(0)[text].as_py(), items.ids[item], best[2], best[0], best[1], best[3])):
                        values.append(value)
            names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "word"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    kind = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, word long"
    return doc_rows(docs, "doc_id", "text").mapInArrow(run, kind)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, word): a row for each document and item it holds."""
    wanted = doc_rows(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    blocks = -(-wanted.count() // ITEMS)
    found = docs.sparkSession.createDataFrame(
        [], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, word long"
    )
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = sorted(some.collect(), key=lambda r: (r["item_id"], r["text"]))  # ITEMS rows, more or less
        for at in range(0, len(rows), RANK):
            items = read_items(rows[at : at + RANK])
            if items.ids:
                found = found.unionByName(_search(docs, items))
    best = F.max(F.struct("lcs_share", "answer_share", "cosine", "word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share", "best.word"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    dirty = stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)

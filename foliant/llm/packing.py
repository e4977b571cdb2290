"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths is packed, so the plan has one size for any corpus:
it has at most ``capacity`` rows, whatever the number of pieces. A pattern is filled
greedily (the longest unpacked length that fits, again and again); then its smallest
piece gives way to the two unpacked ones that fit the gap left by it more tightly, if
there are such. A pattern is used as often as the counts allow before the next one is
made. Pieces get their places by their rank among those of the same length, counted in
salted blocks.

Defined results: a null or empty text is the end id alone; a text of more ids than fit
is cut into full pieces, the last may be shorter; equal rows are packed one by one; an
empty table gives no rows; extra columns of ``docs`` are ignored, extra columns of
pieces are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from foliant.llm.common import doc_rows, stored
from foliant.llm.words import batches, text_buffer, word_hashes

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that one task ranks; a longer run is dealt over several.
RANKED = 50_000
#: Slots of a worker's table of words (of two words for one slot, the later stays), and the ids
#: it may hold before it starts anew: about 100 MB.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
REMEMBERED = 12_000_000


_kind = np.full(256, 2, np.uint8)  # punctuation
_kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 1  # letters
_kind[ord("0") : ord("9") + 1] = 3


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the tokenizer parts words of Latin letters, punctuation and digits; other words stay whole."""
    kind = _kind[data]
    odd = (data == ord("'")) | (data >= 0xC0) & (data != 0xC3)
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    before = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    whole = before[ends] > before[starts]
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts[~whole]] += 1
    depth[ends[~whole]] -= 1
    inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
    cut = np.zeros(len(data), bool)
    cut[1:] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))
    cut[starts] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by a public tokenizer, each word encoded once and remembered.

    The tokenizer parts text at white space, and letters, punctuation and digits, before
    anything else, so that ids do not depend on neighbours. Words meet a table of hashes (64
    bits); new ones of Latin letters go to the tokenizer's model in lower case and many at a
    time, a token with the end-of-word mark ends each; all others take the whole tokenizer.
    Texts with a special token's opening take it as a whole.
    """

    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = map(chr, range(0xC0, 0x100))
        self.letters = str.maketrans({c: to_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """An empty table: by slot the word's hash, and place and number of its ids."""
        self.keys, self.starts, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of ``words``."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if self.PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            text = " ".join([words[i] for i in some]).lower()
            ids = np.array(self.bare.encode_batch_fast([text if text.isascii() else text.translate(self.letters)], add_special_tokens=False)[0].ids, np.uint32)
            for i, own in zip(some, np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1)):
                out[i] = own
        rest = [i for i, own in enumerate(out) if own is None]
        for i, found in zip(rest, self.whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(found.ids, np.uint32)
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without special ids."""
        hashes, offsets, starts, ends = word_hashes(texts, spans=True, parts=_parts)
        if self.filled > REMEMBERED:
            self.forget()
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        start, count = self.starts[slots], self.counts[slots]
        missing = np.flatnonzero(self.keys[slots] != hashes)
        if len(missing):
            fresh, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw = text_buffer(texts)[0].tobytes()
            where = missing[first]
            made = self._encoded([raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            sizes = np.array([len(m) for m in made])
            places = self.filled + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            need = self.filled + int(sizes.sum())
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(need, 2 * len(self.ids)) - len(self.ids), np.uint32)])
            self.ids[self.filled : need] = np.concatenate(made)
            self.filled = need
            slots = (fresh >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[slots], self.starts[slots], self.counts[slots] = fresh, places, sizes
            start[missing], count[missing] = places[back], sizes[back]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        flat = self.ids[np.repeat(start - total[:-1], count) + np.arange(total[-1])].astype("<u4").tobytes()
        cuts = (4 * total[offsets]).tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        special = np.flatnonzero(pc.match_substring(texts, "<|").fill_null(False).to_numpy(zero_copy_only=False))
        for i in special.tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each task."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and the end id, cut where they exceed ``capacity``."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path)(batch.column(1))):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, piece, start, len(own) // 4, own)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        encoder.cache_clear()  # the worker lives on, for other stages

    return doc_rows(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the patterns that together use up ``counts`` (length: number of pieces)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    patterns = []
    while left.any():
        free = left.copy()
        inside: list[int] = []
        gap = capacity

        def take(length: int) -> None:
            nonlocal gap
            free[length] -= 1
            gap -= length
            inside.append(length)

        def fill() -> None:
            while gap > 0 and len(fitting := np.flatnonzero(free[: gap + 1])):
                longest = int(fitting[-1])
                for _ in range(min(int(free[longest]), gap // longest)):
                    take(longest)

        fill()
        while gap > 0 and len(inside) > 1:
            smallest = min(inside)
            pair = _tightest_pair(free, gap + smallest)
            if sum(pair) <= smallest:
                break
            inside.remove(smallest)
            free[smallest] += 1
            gap += smallest
            take(pair[0])
            take(pair[1])
            fill()
        used = np.bincount(inside, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        patterns.append((times, sorted(inside, reverse=True)))
    return patterns


def _tightest_pair(free: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum up to ``room``; (0, 0) if no two fit."""
    have = np.flatnonzero(free[:room])
    if not len(have):
        return 0, 0
    below = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
    other = below[room - have]
    once = (other == have) & (free[have] < 2)
    other = np.where(once, below[np.maximum(have - 1, 0)], other)
    sums = np.where(other > 0, have + other, 0)
    best = int(sums.argmax())
    return (int(have[best]), int(other[best])) if sums[best] else (0, 0)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more) with their ``sequence_id`` and ``offset``."""
    pieces = stored(pieces.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    if not counts:
        return pieces.drop("_id").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    base, total = {}, 0
    for length in sorted(counts):
        base[length], total = total, total + counts[length]
    given = dict(base)
    slots = []  # first global rank, times, length, first sequence, offset
    sequence = 0
    for times, inside in best_two_fit(counts, capacity):
        offset, at = 0, 0
        while at < len(inside):
            length, copies = inside[at], inside.count(inside[at])
            slots.append((given[length], times, length, sequence, offset))
            given[length] += times * copies
            offset += length * copies
            at += copies
        sequence += times
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(sorted(slots), np.int64))

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, times, length, sequence, offset = shared.value.T
        for batch in rows:
            rank = batch.column(1).to_numpy()
            slot = np.searchsorted(first, rank, "right") - 1
            turn = rank - first[slot]
            found = sequence[slot] + turn % times[slot], offset[slot] + turn // times[slot] * length[slot]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["_id", "sequence_id", "offset"])

    placed = _ranked(pieces.select("_id", "length"), counts, base).mapInArrow(place, "_id long, sequence_id long, offset long")
    return pieces.join(placed, "_id").drop("_id")


def _ranked(pieces: DataFrame, counts: dict[int, int], base: dict[int, int]) -> DataFrame:
    """(_id, rank) of ``pieces`` (_id, length): ranks are gapless from 0, ordered by length."""
    spark = pieces.sparkSession
    rows = [(length, base[length], -(-count // RANKED)) for length, count in counts.items()]
    known = spark.createDataFrame(rows, "length long, base long, parts int")
    dealt = pieces.join(F.broadcast(known), "length").withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("_id")
    numbered = dealt.withColumn("number", F.row_number().over(within)).join(starts, ["length", "part"])
    return numbered.select("_id", (F.col("base") + F.col("before") + F.col("number") - 1).alias("rank"))

"""Hashes of the words of many texts at once, for the operators that run in Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D; only A-Z are folded. The
work is done on the UTF-8 buffer of an Arrow array, in slices cut at word ends, so
the memory needed beyond the result does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Places inside words (bytes, their starts and ends) where another word begins.
Parts = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_delimiter = np.zeros(256, bool)
_delimiter[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_code = mix(np.arange(256, dtype=np.uint64), 7)
_code[ord("A") : ord("Z") + 1] = _code[ord("a") : ord("z") + 1]

#: As the delimiters, and all other ASCII characters but letters and digits.
_not_letters = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_up, _down = _powers(SLICE + 1)


def _slice_hashes(
    data: np.ndarray, breaks: np.ndarray, delimiter: np.ndarray, prefixes: tuple[int, ...], parts: Parts | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (one column for the word and one for each prefix), starts and ends of the words of ``data``.

    ``breaks`` are positions where a new text begins.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~delimiter[data]
    begin = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    if len(breaks):
        begin[breaks] |= inside[1:-1][breaks]
        before = breaks[breaks > 0] - 1
        stop[before] |= inside[1:-1][before]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if parts is not None:
        cuts = parts(data, starts, ends)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    global _up, _down
    if len(data) > len(_up):
        _up, _down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_code[data] * _up[: len(data)], out=total[1:])
    hashes = np.empty((len(starts), 1 + len(prefixes)), np.uint64)
    for column, most in enumerate((None, *prefixes)):
        to = ends if most is None else np.minimum(ends, starts + most)
        raw = (total[to] - total[starts]) * _down[starts]
        hashes[:, column] = mix(raw ^ (to - starts).astype(np.uint64), column)
    return hashes, starts, ends


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of n + 1 texts); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def word_hashes(texts: pa.Array, spans: bool = False, letters: bool = False, prefixes: tuple[int, ...] = (), parts: Parts | None = None):
    """(hashes, word offsets of n + 1 texts), with ``spans`` also byte starts and ends in the joined texts.

    With ``letters``, ASCII punctuation parts words too. ``prefixes`` (numbers of
    bytes) adds a column to the hashes for each: the hash of the word's beginning. ``parts``
    cuts words further.
    """
    data, places = text_buffer(texts)
    delimiter = _not_letters if letters else _delimiter
    hashes, starts, ends = [np.zeros((0, 1 + len(prefixes)), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        if to < len(data):  # back to the last gap or text end, else on to the next one
            gaps = np.flatnonzero(delimiter[data[at:to]])
            text_end = places[np.searchsorted(places, to, "right") - 1]
            last = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(text_end))
            if last > at:
                to = last
            else:
                text_end = int(places[np.searchsorted(places, to, "right")])
                gaps = np.flatnonzero(delimiter[data[to:text_end]])
                to = to + int(gaps[0]) if len(gaps) else text_end
        inner = places[np.searchsorted(places, at) : np.searchsorted(places, to)] - at
        h, s, e = _slice_hashes(data[at:to], np.unique(inner), delimiter, prefixes, parts)
        hashes.append(h), starts.append(s + at), ends.append(e + at)
        at = to
    first, found = np.concatenate(starts), np.concatenate(hashes)
    out = found if prefixes else found[:, 0], np.searchsorted(first, places)
    return (*out, first, np.concatenate(ends)) if spans else out


def batches(rows: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column``, or one row; at the end, freed memory goes back to the system."""
    for batch in rows:
        if not batch.num_rows:
            continue
        _, places = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(places, places[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()

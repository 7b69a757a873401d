"""Texts of an Arrow batch as byte arrays, their words and word hashes, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

# Bytes of a word: all but space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_PIECE = 1 << 21  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = end


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
    """Begin and end byte of every word, and the range of words of every text."""
    ok = inside[data]
    if not len(ok):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(ok), np.empty_like(ok)
    before[0], before[1:] = False, ok[:-1]
    after[-1], after[:-1] = False, ok[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(ok)]] = False
    after[cuts[cuts > 0] - 1] = False
    begin = np.flatnonzero(ok & ~before)
    return begin, np.flatnonzero(ok & ~after) + 1, np.searchsorted(begin, offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ascending span of bytes, in pieces of bounded size."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + _PIECE, "right")))
        low, high = int(begin[at]), int(end[at:to].max())
        power, inverse = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        b, e = begin[at:to] - low, end[at:to] - low
        out[at:to] = mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased (A-Z) texts, and the range of words of every text."""
    data = LOWER[data]
    begin, end, bounds = word_spans(data, offsets)
    return span_hashes(data, begin, end), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in each text; a text of fewer words is one run. Returns values and ranges."""
    counts = np.diff(bounds)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ranges = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(ranges[-1], np.uint64)
    factor = powers(k + 1)[0]
    if len(words) >= k:
        runs = np.zeros(len(words) - k + 1, np.uint64)
        for t in range(k):
            runs += words[t: t + len(runs)] * factor[t]
        last = np.repeat(bounds[1:], counts)[: len(runs)]
        full = runs[np.arange(len(runs)) + k <= last]
        out[np.repeat(counts >= k, made)] = mix(full)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        run = words[bounds[i]: bounds[i + 1]]
        out[ranges[i]] = mix((run * factor[: len(run)]).sum(keepdims=True) + np.uint64(0xA0761D6478BD642F * len(run) % 2**64))[0]
    return out, ranges

"""An n-gram trie in Elias-Fano coded levels, written as one run of bytes and read in place (also from a mapped file).

Words are numbers. Level 1 holds first words u; level 2 pairs (u, v) as place of u in level 1 times the number of words,
plus v; level 3 triples as place of (u, v) in level 2 times the widest fan-out, plus the place of w among all words that
follow v anywhere in the trie (context-relative, so that it is a small number). Every level is one ascending sequence:
a node's children are found by successor search for its place, without pointers of their own.

Beside each node stand the quantised parts of its smoothed probability, in steps of 1/1024 of a power of two and rounded
down, so that quantising never makes probabilities sum to more than 1.
"""

from __future__ import annotations

import struct

import numpy as np

STEPS = 1024
ABSENT = 65535


def quantised(x: np.ndarray) -> np.ndarray:
    """Codes of numbers in (0, 1]; ABSENT for 0 and for what is too small to tell."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log2(x) * STEPS - 1e-9)
    return np.where(code < ABSENT, np.maximum(code, 0), ABSENT).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return np.where(code == ABSENT, 0.0, np.exp2(-code.astype(np.float64) / STEPS))


class Ascending:
    """Distinct ascending numbers: low bits packed, high bits in unary with one bit per number and per step."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        self.ends = zeros - np.arange(len(zeros))  # numbers up to the end of each step

    @staticmethod
    def coded(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        bits = max(0, (top // max(count, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(count)
        unary = np.zeros((int(high[-1]) + 2 if count else 1), np.uint8)
        unary[high] = 1
        low = np.zeros(count * bits // 64 + 2, np.uint64)
        if bits:
            place = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            rest = values & np.uint64((1 << bits) - 1)
            word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            np.bitwise_or.at(low, word, rest << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        packed = np.packbits(unary, bitorder="little").tobytes()
        packed += bytes(-len(packed) % 8)
        return struct.pack("<qqqq", count, bits, len(low), len(packed)) + low.tobytes() + packed

    @classmethod
    def read(cls, raw, at: int) -> tuple[Ascending, int]:
        count, bits, words, size = struct.unpack_from("<qqqq", raw, at)
        at += 32
        low = np.frombuffer(raw, "<u8", words, at)
        high = np.frombuffer(raw, np.uint8, size, at + 8 * words)
        return cls(count, bits, low, high), at + 8 * words + size

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bits = np.uint64(self.low_bits)
        place = i.astype(np.uint64) * bits
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        spill = np.where(shift == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        return ((self.low[word] >> shift) | spill) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number not below x (count if there is none)."""
        x = x.astype(np.uint64)
        step = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), len(self.ends))
        ends = np.concatenate([[0], self.ends, [self.count]])
        low, high = np.minimum(ends[step], self.count), np.minimum(ends[np.minimum(step + 1, len(ends) - 1)], self.count)
        rest = x & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), np.uint64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            below = self._low(middle) < rest[open_]
            a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
            low[open_], high[open_] = a, b
            open_ = open_[a < b]
        return low

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, -1 if it is not there."""
        if not self.count:
            return np.full(len(x), -1)
        x = x.astype(np.uint64)
        place = self.successor(x)
        safe = np.minimum(place, self.count - 1)
        step = (x >> np.uint64(self.low_bits)).astype(np.int64)
        ends = np.concatenate([[0], self.ends])
        known = step < len(self.ends)
        step = np.where(known, step, 0)
        inside = known & (place >= ends[step]) & (place < ends[step + 1])
        rest = x & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(x), np.uint64)
        return np.where(inside & (self._low(safe) == rest), safe, -1)


class Trie:
    """Levels of one shard of a model, over the bytes ``built`` has made."""

    def __init__(self, raw):
        self.words, self.width = struct.unpack_from("<qq", raw)
        levels, at = [], 16
        for _ in range(4):
            level, at = Ascending.read(raw, at)
            levels.append(level)
        self.first, self.pairs, self.following, self.triples = levels
        codes = []
        for n in (self.first.count, self.pairs.count, self.pairs.count, self.triples.count):
            codes.append(np.frombuffer(raw, "<u2", n, at))
            at += 2 * n
        self.first_backoff, self.pair_part, self.pair_backoff, self.triple_part = codes

    @staticmethod
    def built(words: int, u: np.ndarray, v: np.ndarray, times: np.ndarray, u_times: np.ndarray,
              parent: np.ndarray, w: np.ndarray, triple_times: np.ndarray, pseudo: tuple[float, float]) -> bytes:
        """Pairs (u, v) ascending, with their count and the count of u; triples as (place of the pair, w) ascending.

        pseudo: how many occurrences of a context the shorter context's distribution counts for, after one and two words.
        """
        first, place = np.unique(u, return_inverse=True)
        first_times = np.zeros(len(first))
        first_times[place] = u_times
        middle = v[parent] if len(parent) else np.empty(0, np.int64)
        follow, rank = np.unique(middle.astype(np.uint64) * np.uint64(words) + w.astype(np.uint64), return_inverse=True)
        context = follow // np.uint64(words) if words else follow
        head = np.concatenate([[True], context[1:] != context[:-1]])[: len(follow)]
        begin = np.maximum.accumulate(np.where(head, np.arange(len(follow)), 0)) if len(follow) else rank
        relative = rank - begin[rank]
        width = int(relative.max()) + 1 if len(relative) else 1
        levels = [first, place.astype(np.uint64) * np.uint64(words) + v.astype(np.uint64), follow,
                  parent.astype(np.uint64) * np.uint64(width) + relative.astype(np.uint64)]
        one, two = pseudo
        codes = [quantised(one / (first_times + one)), quantised(times / (u_times + one)), quantised(two / (times + two)),
                 quantised(triple_times / (times[parent] + two)) if len(parent) else np.empty(0, np.uint16)]
        return struct.pack("<qq", words, width) + b"".join(Ascending.coded(x) for x in levels) + b"".join(
            x.astype("<u2").tobytes() for x in codes)

    def pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Place of each pair in level 2, -1 if it is not there."""
        at = self.first.find(u)
        found = self.pairs.find(np.maximum(at, 0).astype(np.uint64) * np.uint64(self.words) + v.astype(np.uint64))
        return np.where(at < 0, -1, found)

    def triple(self, pair: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place of each triple in level 3, given the place of its pair and the pair's second word."""
        context = v.astype(np.uint64) * np.uint64(self.words)
        at = self.following.find(context + w.astype(np.uint64))
        relative = at - self.following.successor(context)
        found = self.triples.find(
            np.maximum(pair, 0).astype(np.uint64) * np.uint64(self.width) + np.maximum(relative, 0).astype(np.uint64))
        return np.where((pair < 0) | (at < 0), -1, found)

    @staticmethod
    def _codes(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.full(len(place), ABSENT, np.uint16)
        out[place >= 0] = codes[place[place >= 0]]
        return out

    def pair_codes(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._codes(self.pair_part, place), self._codes(self.pair_backoff, place)

    def triple_codes(self, place: np.ndarray) -> np.ndarray:
        return self._codes(self.triple_part, place)

"""Spelling variants: words one edit apart, found by composing automata, and the form each variant stands for.

The vocabulary is an acceptor; composed with a transducer that makes exactly one edit (one code point replaced or
inserted), and with the acceptor again, it accepts the pairs of near words. The composed machine is cut into parts by
where it starts: all words that share a number of code points at their beginning and at their end, and have room between
for words of ``least`` or one more code points, start in one state, and the edit is made in between.

How the parts are made. The edit of a pair is placed behind its longest common beginning. Of the room between what is fixed, the
edit lies in the front half, and then the back half is shared, or behind it, and then the front half is. So every part falls
into two that fix half of the room each, and a pair is found in exactly one of them: in parts that share the back,
edits must lie in front of a limit. All words are divided once; then parts of more than MOST words, or with a room above
ROOM, again and again while there is room for more than two code points. What is left above MOST has a room of two or
three code points, so at most the square and the cube of the alphabet's size in words.

In a part the words are the minimal acyclic acceptors of what stands in the room, one for each of the two lengths, their
states shared by all parts of a task as far as they fit. The composition is walked from the start state: the same state
of one acceptor, or a pair of the two, before the edit; after it pairs of states, whose common right language is
worked out once. What leaves a task is one row per word and part: how many near words it has there, and the best.

Defined cases: null and empty texts have no words; a null id is hashed as the empty text; rows repeated with their ids
count each; long texts are counted in pieces cut outside of words. Within a piece of 2 MB words are told apart by
a 64-bit hash. Without a word of enough occurrences the result is empty. Only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_one
from .tables import written
from .texts import LOWER, slices, span_hashes, utf8, word_spans

NOISE = 199  # a run whose hash this divides loses a code point; 0: none does
LEAST, TIMES, RATIO = 6, 5, 5  # code points and occurrences of a word; how much more frequent its form must be
MOST, ROOM = 2000, 64  # words and code points, above which a part is divided

_PIECE = 1 << 21  # bytes of text looked at at a time
_HELD = 16_000_000  # bytes of words that a task counts before it hands them on
_STATES = 300_000  # states shared between parts
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_INSIDE = np.array([False, True])
_LONG = 64  # bytes; longer runs are hashed one by one

_VARIANT = "word string, n long, n_near long, form string, form_n long"
_PART = ["l", "a", "r", "fixed"]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of what has the CRC-32 ``before``, followed by each span."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    long = int((size > _LONG).sum())
    out = np.empty(len(size), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[begin[i]: end[i]].tobytes(), int(before[i]))
    order = order[long:]
    at, sizes, state = begin[order], size[order], before[order] ^ np.uint32(0xFFFFFFFF)
    counts = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0))  # how many are longer than k
    for k, m in enumerate(counts):
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ state[:m] >> np.uint32(8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of runs."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    return inside


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts with their range of bytes; a long text comes in pieces that cut no run."""
    for a, b in slices(offsets, _PIECE):
        at, end = int(offsets[a]), int(offsets[b])
        while end - at > 2 * _PIECE:
            to = at + _PIECE
            while to < end:  # on to a byte that is in no run
                ahead = min(to + 4096, end)
                free = np.flatnonzero(~_runs(data[to - 1: ahead])[1:])
                if len(free):
                    to += int(free[0])
                    break
                to = ahead
            yield a, b, at, to
            at = to
        yield a, b, at, end


def vocabulary(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST,
               times: int = TIMES) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least so many code points and occurrences. ``noise`` makes
    variants: a run loses a code point where it divides the hash of id and run."""
    table = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        held = 0

        def out():
            return pa.record_batch([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                                   names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            whole, offsets = utf8(batch.column(1))
            for a, b, low, high in _pieces(whole, offsets):
                data = LOWER[whole[low:high]]
                edges = np.clip(offsets[a: b + 1] - low, 0, high - low)
                begin, end, bounds = word_spans(_runs(data).view(np.uint8), edges, _INSIDE)
                owner = np.repeat(np.arange(a, b), np.diff(bounds))
                leads = np.concatenate([[0], np.cumsum(data == _LEAD, dtype=np.int64)])
                points = end - begin - (leads[end] - leads[begin])
                some = points >= least
                begin, end, owner, points = begin[some], end[some], owner[some], points[some]
                fresh: dict[bytes, int] = {}
                kept = np.ones(len(begin), bool)
                if noise:
                    started = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[a:b]], np.uint32)
                    hashed = crcs(data, begin, end, started[owner - a])
                    kept = hashed % noise != 0
                    for i in np.flatnonzero(~kept & (points > least)):
                        run = data[begin[i]: end[i]].tobytes().decode()
                        at = int(hashed[i]) % len(run)
                        word = (run[:at] + run[at + 1:]).encode()
                        fresh[word] = fresh.get(word, 0) + 1
                begin, end = begin[kept], end[kept]
                _, first, number = np.unique(span_hashes(data, begin, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                for x, y, n in zip(begin[first].tolist(), end[first].tolist(), number.tolist()):
                    word = raw[x:y]
                    fresh[word] = fresh.get(word, 0) + n
                for word, n in fresh.items():
                    before = counts.get(word)
                    if before is None:
                        held += len(word) + 100
                        before = 0
                    counts[word] = before + n
                if held > _HELD:
                    yield out()
                    counts.clear()
                    held = 0
        if counts:
            yield out()

    found = table.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= times)


class Acceptors:
    """Minimal acyclic acceptors that share their states, and the compositions of two of them with one edit."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        self.both: dict[tuple[int, int], list[str]] = {}

    def start(self, words: list[str]) -> int:
        """The start state for distinct words in ascending order."""
        return self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], low: int, high: int, depth: int) -> int:
        final = low < high and len(words[low]) == depth
        low += final
        edges = []
        while low < high:
            label, end = words[low][depth], low + 1
            while end < high and words[end][depth] == label:
                end += 1
            edges.append((label, self._state(words, low, end, depth + 1)))
            low = end
        key = (final, tuple(edges))
        if key not in self.register:
            self.register[key] = len(self.final)
            self.final.append(final)
            self.edges.append(dict(edges))
        return self.register[key]

    def common(self, p: int, q: int) -> list[str]:
        """What leads from both states to an end."""
        key = (p, q) if p <= q else (q, p)
        found = self.both.get(key)
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            others = self.edges[q]
            for label, to in self.edges[p].items():
                if label in others:
                    found += [label + rest for rest in self.common(to, others[label])]
            self.both[key] = found
        return found

    def replaced(self, state: int, limit: int, head: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs that differ in one code point, before the limit."""
        if len(head) >= limit:
            return
        edges = list(self.edges[state].items())
        for k, (label, to) in enumerate(edges):
            for other, at in edges[k + 1:]:
                for rest in self.common(to, at):
                    yield head + label + rest, head + other + rest
            yield from self.replaced(to, limit, head + label)

    def inserted(self, p: int, q: int, limit: int, head: str = "") -> Iterator[tuple[str, str]]:
        """Pairs of a word from p and one from q that has one code point more, before the limit. The pair is found where
        its common beginning ends: what follows the code point does not begin with it."""
        if len(head) >= limit:
            return
        edges = self.edges[p]
        for label, to in self.edges[q].items():
            for rest in self.common(p, to):
                if rest[:1] != label:
                    yield head + rest, head + label + rest
            if label in edges:
                yield from self.inserted(edges[label], to, limit, head + label)


def _divided(rows: DataFrame) -> DataFrame:
    """Parts cut in two: the front half of the room becomes fixed, or the back half. l is the shorter length of a pair; a
    and r code points are fixed at the beginning and at the end."""
    room = F.col("l") - F.col("a") - F.col("r")
    half = F.floor(room / 2).cast("int")
    halves = F.array(F.struct((F.col("a") + half).alias("a"), F.col("r").alias("r")),
                     F.struct(F.col("a").alias("a"), (F.col("r") + room - half).alias("r")))
    cut = rows.select("l", F.explode(halves).alias("_half"), "word", "n").select("l", "_half.*", "word", "n")
    return cut.withColumn("fixed", F.concat(F.left("word", F.col("a")), F.right("word", F.col("r"))))


def parts(words: DataFrame, least: int = LEAST) -> DataFrame:
    """The words dealt out to parts (l, a, r, fixed): every pair of near words is to be found in exactly one."""
    length = F.char_length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda x: x >= least)).alias("l")
    level = written(_divided(words.select(shorter, F.lit(0).alias("a"), F.lit(0).alias("r"), "word", "n")), "parts")
    done = []
    while True:
        room = F.col("l") - F.col("a") - F.col("r")
        sizes = level.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_size")).where(room > 2)
        large = written(sizes.where((F.col("_size") > MOST) | (F.col("_size") > 1) & (room > ROOM)).select(*_PART), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, level])
        done.append(join_one(level, large, _PART, "left_anti"))
        level = written(_divided(join_one(level, large, _PART, "left_semi")), "parts")


def near(dealt: DataFrame) -> DataFrame:
    """Of every word and part: how many near words it has there, and the most frequent of them."""
    spark = dealt.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [*_PART, "word", "n"]

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    def compose(batches) -> Iterator[pa.RecordBatch]:
        acceptors, found = Acceptors(), []

        def out():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["word", "n", "n_near", "form", "form_n"])

        for (l, a, r, _), part in groupby(rows(batches), lambda row: row[:4]):
            group = [(row[4], row[5]) for row in part]
            if len(group) == 1:
                continue
            short = {word[a: len(word) - r]: i for i, (word, _) in enumerate(group) if len(word) == l}
            long = {word[a: len(word) - r]: i for i, (word, _) in enumerate(group) if len(word) > l}
            if not short:
                continue
            # Behind a shared end lies only what other parts find; without one, an edit may stand behind the last code point.
            limit = l - a - r if r else l + 1
            start = acceptors.start(list(short))
            pairs = [(short[x], short[y]) for x, y in acceptors.replaced(start, limit)]
            if long:
                pairs += [(short[x], long[y]) for x, y in acceptors.inserted(start, acceptors.start(list(long)), limit)]
            best: dict[int, tuple[int, int]] = {}  # number of near words, and which is the best
            for x, y in pairs:
                for i, j in ((x, y), (y, x)):
                    count, k = best.get(i, (0, j))
                    if (-group[j][1], group[j][0]) < (-group[k][1], group[k][0]):
                        k = j
                    best[i] = count + 1, k
            found += [(*group[i], count, *group[k]) for i, (count, k) in best.items()]
            if len(found) > 20_000:
                yield out()
                found = []
            if len(acceptors.final) + len(acceptors.both) > _STATES:
                acceptors = Acceptors()
        if found:
            yield out()

    ordered = dealt.select(*columns).repartition(tasks, *_PART).sortWithinPartitions(*_PART, "word")
    return ordered.mapInArrow(compose, _VARIANT)


def _roots(links: DataFrame) -> DataFrame:
    """(form, root) of every form that words have. A form occurs more often than its word, so that there are no cycles; each
    round doubles how far links reach."""
    forms = links.select("form").distinct()
    up = links.select(F.col("word").alias("form"), F.col("form").alias("root"))
    roots = written(join_one(forms, up, ["form"]).select("form", F.coalesce("root", "form").alias("root")), "roots")
    while True:
        above = roots.select(F.col("form").alias("root"), F.col("root").alias("top"))
        further = written(join_one(roots, above, ["root"]).select("form", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "roots")
        roots = further.select("form", "root")
        if further.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n) of at least so many code points."""
    words = written(words.select("word", "n"), "vocabulary")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"),
                        F.lit(None).cast("long").alias("form_n"))
    order = F.when(F.col("form").isNotNull(), F.struct(-F.col("form_n"), F.col("form")))
    grouped = none.unionByName(near(parts(words, least))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min_by(F.struct("form", "form_n"), order).alias("_best"))
    often = F.col("_best.form_n") >= ratio * F.col("n")
    found = written(grouped.select("word", "n", "n_near", F.when(often, F.col("_best.form")).alias("form"),
                                   F.when(often, F.col("_best.form_n")).alias("form_n")), "forms")
    linked = found.where("form is not null")
    rooted = join_one(linked, _roots(linked.select("word", "form")), ["form"])
    alone = found.where("form is null").withColumn("root", F.col("word"))
    return rooted.unionByName(alone).select("word", "form", "root", "n", "n_near", "form_n")

"""Benchmark passages in documents, by one Aho-Corasick automaton over normalised windows.

Normalised: A-Z lower-cased, words of 0-9, a-z and non-ASCII bytes, single spaces between. The automaton holds every
run of ``window`` words of every item (an item of fewer words is one run) between spaces, so that a match is a run of
whole words. A text is scanned once; the offsets of a match lead back to words and to bytes of the original text.

The benchmark is a query set. It is read in blocks, each sent to the tasks as one automaton and held against all
documents. A block is bounded by what its automaton may hold: BLOCK bytes of distinct windows, which no trie over them has
more nodes than, with PER_WINDOW and PER_OWNER added for the objects at their ends. A long item goes on in the next block.
So what a task holds is bounded however large the benchmark grows (only a single window longer than BLOCK is not cut), and
the documents are scanned once a block.

Defined cases: null or wordless texts have no words and no hits; items without words never match; items without an id
mark words but are not counted or listed; equal items are each counted, an id that occurs on several rows once; repeated
or id-less documents are judged row by row. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import written
from .texts import LOWER, utf8, word_spans

WINDOW = 10
BLOCK = 4_000_000  # about 55 bytes of memory each
PER_WINDOW, PER_OWNER = 16, 4

WORD = np.zeros(256, bool)
WORD[128:] = WORD[ord("0"): ord("9") + 1] = WORD[ord("a"): ord("z") + 1] = True
_clean = bytes(int(LOWER[b]) if WORD[LOWER[b]] else 0x20 for b in range(256))


def normal(text: bytes) -> bytes:
    """Words between single spaces, with one space before the first and after the last."""
    return b" " + b" ".join(text.translate(_clean).split()) + b" "


def windows(text: bytes, size: int) -> list[bytes]:
    words = text.translate(_clean).split()
    count = max(len(words) - size + 1, min(len(words), 1))
    return [b" " + b" ".join(words[k: k + size]) + b" " for k in range(count)]


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int, most: int) -> Iterator[list[tuple]]:
    """Items, or parts of items that share no window, in lists whose automaton is bounded by ``most``; one list in memory
    at a time. A window alone may be longer. Together the lists have every window of every item."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    block, seen, held = [], set(), 0
    for row in rows.distinct().toLocalIterator():
        words = row.text.encode().translate(_clean).split()
        begin, count = 0, max(len(words) - size + 1, min(len(words), 1))
        for k in range(count):
            run = b" ".join(words[k: k + size])
            cost = PER_OWNER + (0 if run in seen else len(run) + 2 + PER_WINDOW)
            if seen and held + cost > most:
                if k > begin:
                    block.append((row.id, b" ".join(words[begin: k - 1 + size])))
                yield block
                block, seen, held, begin = [], set(), 0, k
                cost = PER_OWNER + len(run) + 2 + PER_WINDOW
            seen.add(run)
            held += cost
        if count:
            block.append((row.id, b" ".join(words[begin:])))
    yield block


class _Scanner:
    """The automaton of one block, built once per Python worker."""

    _last: tuple | None = None

    def __init__(self, items: list[tuple], size: int):
        owners: dict[bytes, set] = {}
        for item, content in items:
            for run in windows(content, size):
                owners.setdefault(run, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for run, ids in owners.items():
            self.automaton.add_word(run.decode("latin-1"), (len(run), frozenset(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    @classmethod
    def of(cls, shared, size: int) -> _Scanner:
        if cls._last is None or cls._last[0] is not shared.value or cls._last[1] != size:
            cls._last = None  # never two automata at once
            cls._last = (shared.value, size, cls(shared.value, size))
        return cls._last[2]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, ranges of words that are hit, ids of items found."""
        line = normal(text)
        if len(line) == 2:
            return 0, [], []
        count = line.count(b" ") - 1
        if self.empty:
            return count, [], []
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return count, [], []
        word = np.cumsum(np.frombuffer(line, np.uint8) == 0x20)  # number of spaces up to each byte
        ids: set = set()
        ranges: list[tuple[int, int]] = []
        spans = sorted((int(word[end - length + 1]) - 1, int(word[end]) - 1) for end, (length, _) in found)
        for begin, end in spans:
            if ranges and begin <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], end))
            else:
                ranges.append((begin, end))
        for _, (_, owners) in found:
            ids |= owners
        return count, ranges, sorted(x for x in ids if x is not None)


def _byte_ranges(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    begin, end, _ = word_spans(data, np.array([0, len(data)]), WORD)
    return [(int(begin[a]), int(end[b - 1])) for a, b in ranges]


def _against(table: DataFrame, shared, window: int) -> DataFrame:
    """All columns but the last, the text, with what ``scan`` finds of one block of items."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:-1])
    pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def match(batches):
        scanner = _Scanner.of(shared, window)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            counts, hits, spans, found = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n, ranges, ids = scanner.scan(raw[a:b])
                counts.append(n), found.append(ids)
                hits.append([{"begin": x, "end": y} for x, y in ranges])
                spans.append([{"begin": x, "end": y} for x, y in _byte_ranges(raw[a:b], ranges)] if ranges else [])
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hits, pairs), pa.array(spans, pairs),
                 pa.array(found, pa.list_(pa.string()))],
                names=[*batch.schema.names[:-1], "n_words", "words_hit", "bytes_hit", "items"])

    span = "array<struct<begin: long, end: long>>"
    return table.mapInArrow(match, f"{kept}, n_words long, words_hit {span}, bytes_hit {span}, items array<string>")


def _shared(benchmark: DataFrame, item_id: str, item_text: str, window: int, block: int) -> list:
    """The blocks of items, each as a broadcast."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(items) for items in blocks(benchmark, item_id, item_text, window, block)]


def scan(
    documents: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK,
) -> list[DataFrame]:
    """One table per block of items: the ``keep`` columns of every document with n_words, the words hit (begin, end),
    the bytes they cover in the original text (begin, end), and the items found."""
    table = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    return [_against(table, shared, window) for shared in _shared(benchmark, item_id, item_text, window, block)]


def report(
    documents: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """The ``keep`` columns of every document with n_words, n_hit, items (sorted) and contaminated.

    For several blocks the documents are written once with a row id, by which the blocks' results meet.
    """
    parts = _shared(benchmark, item_id, item_text, window, block)
    if len(parts) == 1:
        given = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
        table = _against(given, parts[0], window).withColumn(
            "n_hit", F.expr("aggregate(words_hit, 0L, (n, x) -> n + x.end - x.begin)"))
    else:
        row = "_row"
        while row in documents.columns:
            row += "_"
        columns = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]
        rows = written(documents.select(*columns, F.monotonically_increasing_id().alias(row)), "passages")
        first, *others = [_against(rows.select(row, F.col(text).alias("_text")), shared, window) for shared in parts]
        union = first
        for other in others:
            union = union.unionByName(other.where("size(words_hit) > 0"))
        merged = """aggregate(array_sort(flatten(words_hit)), named_struct('n', 0L, 'last', 0L), (s, x) -> named_struct(
            'n', s.n + greatest(x.end - greatest(x.begin, s.last), 0L), 'last', greatest(s.last, x.end)), s -> s.n)"""
        found = (
            union.groupBy(row)
            .agg(F.max("n_words").alias("n_words"), F.collect_list("words_hit").alias("words_hit"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .select(row, "n_words", F.expr(merged).alias("n_hit"), "items")
        )
        table = rows.select(*[F.col(f"`{c}`") for c in keep], row).hint("merge").join(found, row)
    return table.select(*[F.col(f"`{c}`") for c in keep], "n_words", "n_hit", "items",
                        (F.col("n_hit") > 0).alias("contaminated"))

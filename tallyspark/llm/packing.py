"""Harmonic packing of token sequences into bins of fixed capacity.

Class k holds pieces of length in (capacity / (k + 1), capacity / k]; a bin of class k takes exactly k pieces. Documents
may be cut, and are cut so that classes fill without a gap: into whole bins, then into halves of the capacity down to
``least`` (class k = 2, 4, 8, .. of pieces exactly capacity / k long), and what is left below ``least`` is one piece of
its class, whose bins lose at most least / capacity of their length. Each task fills its own bins, class by class, and
needs nobody else; it holds at most one open bin per class. When its rows end, the pieces in open bins are laid end to
end and cut anew at the capacity, and the last remainder at powers of two, which are not padded. So padding stands
only in full bins of the small classes.

Defined cases: what the vocabulary lists as a special token becomes its id also inside a text, as ``tokenizers`` does; a null text is empty, and an empty document is its end id alone; a repeated document is packed again;
null ids stay null. Sequence ids come from the partition number and a count, and are unique but not dense. Only the
columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import VOCABULARY, Encoder

CAPACITY = 2048
LEAST = 64
END_ID = 1
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_BATCH = 20_000  # pieces handed on at a time
_TEXTS = 1000  # texts encoded at a time


def cuts(length: int, capacity: int = CAPACITY, least: int = LEAST) -> Iterator[int]:
    """Lengths of a document's pieces, in their order."""
    for _ in range(length // capacity):
        yield capacity
    rest, size = length % capacity, capacity
    while size > least:
        size //= 2
        if rest >= size:
            yield size
            rest -= size
    if rest:
        yield rest


class Packer:
    """Bins of one worker. A piece is (row, start, ids as bytes, tokens of its document)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, least: int = LEAST):
        self.next, self.capacity, self.least = first_id, capacity, least
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids, total in pieces:
            yield row, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, row, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        start = 0
        for length in cuts(total, self.capacity, self.least):
            kind = self.capacity // length
            bin_ = self.open.setdefault(kind, [])
            bin_.append((row, start, ids[4 * start: 4 * (start + length)], total))
            start += length
            if len(bin_) == kind:
                yield from self._close(self.open.pop(kind))

    def end(self) -> Iterator[tuple]:
        """Lay the pieces of open bins end to end; the remainder goes into sequences of a power of two."""
        left = [piece for _, bin_ in sorted(self.open.items()) for piece in bin_]
        self.open = {}
        tokens = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (tokens // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (tokens % self.capacity) >> b & 1]
        left.reverse()
        for size in sizes:
            sequence, room = [], size
            while room:
                row, start, ids, total = left.pop()
                length = len(ids) // 4
                if length > room:
                    left.append((row, start + room, ids[4 * room:], total))
                    ids, length = ids[: 4 * room], room
                sequence.append((row, start, ids, total))
                room -= length
            yield from self._close(sequence)


def pack(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY, least: int = LEAST, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start and length in the document, CRC-32 of its ids, sequence and offset there."""
    table = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        encoder = Encoder.of(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, least)
        kind, rows = None, []

        def batch(rows):
            columns = list(zip(*rows)) or [[]] * 7
            return pa.record_batch([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                                   names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

        for given in batches:
            kind = given.column(0).type
            for at in range(0, given.num_rows, _TEXTS):
                part = given.slice(at, _TEXTS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for row, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    rows += packer.add(row, ids + end)
                if len(rows) >= _BATCH:
                    yield batch(rows)
                    rows = []
        if kind is not None:
            rows += packer.end()
            yield batch(rows)

    return table.mapInArrow(work, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")

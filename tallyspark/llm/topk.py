"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers, floor(scale * x). The index is built in blocks of rows: of every attribute its least
value, and bitmaps (slices) of the leading ``KEEP`` bits of what lies above. A query's score is a sum of slices: each
attribute counts as often as the signed digits of the query's component say, a negative digit as the complement. Full
adders take three bitmaps of one weight to one of that weight and one of the next, until one slice a weight is left:
the bits of every row's score, short of the low bits that the slices lack.

From the most significant slice downward the k-th greatest of these scores is found by counting bits. The missing bits
can move a score by a known width at most, so that rows less than the width below the k-th are the only ones that can
be among the first k, ties included. These boundary rows are scored exactly, from the integers kept beside the slices.

Every block of queries meets every block of the index; partial results of k rows a query are merged in two steps, so that
no task holds more than MERGE of them. Blocks hold a fixed number of values, whatever the number of rows.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id, nor
vectors so long that scores could leave 64 bits (squares of the scaled components, each one larger, sum to 4e18 or more).
Vectors of different lengths do not meet; the empty vector scores 0 with its like. Rows of a query's own id are no
candidates of it; equal rows among the queries are one query, other rows of one id are queries of their own; equal rows
among the candidates all count. Queries without candidates have no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import written

SCALE = 256.0
K = 5
KEEP = 6  # leading bits of an attribute that have slices
BLOCK_VALUES, QUERY_VALUES = 1 << 19, 1 << 15  # components in a block of the index, of queries
MERGE = 256  # partial results merged at a time

_INDEX = "dims int, cell long, ids array<long>, vectors array<int>, least array<int>, bits array<int>, slices binary"
_PARTIAL = "dims int, slot long, cell long, query_ids array<long>, counts array<int>, ids array<long>, scores array<long>"


def _table(names: str, *columns) -> pa.Table:
    return pa.table({n.split()[0]: c for n, c in zip(names.split(", "), columns)})


def _one(values, kind) -> pa.Array:
    """A column of one row that holds a list."""
    return pa.array([np.asarray(values)], pa.list_(kind))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


class Block:
    """Rows of one block, sorted by id, with their slices as 64-bit words."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.vectors, self.least, self.bits = ids, vectors, least.astype(object), bits
        n, self.words = len(ids), (len(ids) + 63) // 64
        self.slices = np.concatenate([slices, ~slices])  # complements behind the slices
        self.kept = np.minimum(bits, KEEP)
        self.lost = bits - self.kept
        self.first = np.cumsum(self.kept) - self.kept
        every = np.zeros(64 * self.words, np.uint8)
        every[:n] = 1
        self.every = np.packbits(every, bitorder="little").view(np.uint64)

    @staticmethod
    def sliced(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least value, bits and slices of the attributes of a block."""
        least = vectors.min(axis=0)
        above = (vectors.astype(np.int64) - least).T
        bits = np.array([int(x).bit_length() for x in above.max(axis=1)], np.int64)
        width = 64 * ((len(vectors) + 63) // 64)
        rows = np.zeros((int(np.minimum(bits, KEEP).sum()), width), np.uint8)
        at = 0
        for row, b in zip(above, bits):
            for k in range(max(0, b - KEEP), b):
                rows[at, : len(vectors)] = row >> k & 1
                at += 1
        return least, bits, np.packbits(rows, axis=1, bitorder="little").view(np.uint64)

    def _weighted(self, query: np.ndarray) -> tuple[dict[int, list[int]], int]:
        """Slices to add, by weight, and the width by which the sum and the score can differ between rows."""
        by_weight: dict[int, list[int]] = {}
        half = len(self.slices) // 2
        for d, value in enumerate(query.tolist()):
            weight, rest = 0, abs(value)
            while rest:
                if rest & 1:
                    digit = 2 - (rest & 3)  # of the non-adjacent form: 1 or -1
                    rest -= digit
                    start = int(self.first[d]) + (half if (digit < 0) != (value < 0) else 0)
                    for k in range(int(self.kept[d])):
                        by_weight.setdefault(weight + k + int(self.lost[d]), []).append(start + k)
                rest >>= 1
                weight += 1
        width = sum(abs(v) * ((1 << int(b)) - 1) for v, b in zip(query.tolist(), self.lost))
        return by_weight, width

    def _summed(self, by_weight: dict[int, list[int]]) -> dict[int, np.ndarray]:
        """Slices of the sum by their weights."""
        out, weight = {}, min(by_weight, default=0)
        carried: list[np.ndarray] = []
        while carried or any(w >= weight for w in by_weight):
            rows = np.concatenate([self.slices[by_weight.get(weight, [])], *carried])
            carried = []
            while len(rows) > 2:
                third = len(rows) // 3
                a, b, c = rows[:third], rows[third: 2 * third], rows[2 * third: 3 * third]
                either = a ^ b
                carried.append(a & b | either & c)
                rows = np.concatenate([either ^ c, rows[3 * third:]])
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
            if len(rows):
                out[weight] = rows[0]
            weight += 1
        return out

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k rows, the query's own id left out."""
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        free = self.every
        if own.start < own.stop:
            bits = np.unpackbits(free.view(np.uint8), bitorder="little")
            bits[own] = 0
            free = np.packbits(bits, bitorder="little").view(np.uint64)
        by_weight, width = self._weighted(query)
        sums = self._summed(by_weight)
        equal, above, limit = free, 0, 0
        for weight, bits in sorted(sums.items(), reverse=True):  # limit becomes the k-th greatest sum
            hit = equal & bits
            count = int(np.bitwise_count(hit).sum())
            if above + count >= k:
                equal, limit = hit, limit | 1 << weight
            else:
                above, equal = above + count, equal & ~bits
        limit = max(0, limit - width)
        equal, greater, none = free, np.zeros_like(free), np.zeros_like(free)
        for weight in range(max([limit.bit_length(), *(w + 1 for w in sums)]) - 1, -1, -1):
            bits = sums.get(weight, none)
            if limit >> weight & 1:
                equal = equal & bits
            else:
                greater, equal = greater | equal & bits, equal & ~bits
        rows = np.flatnonzero(np.unpackbits((greater | equal).view(np.uint8), bitorder="little"))
        scores = self.vectors[rows].astype(np.int64) @ query.astype(np.int64)
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[first]], scores[first]


def usable(embedding: str) -> Column:
    """Whether a vector takes part."""
    squares = F.aggregate(
        F.col(embedding), F.lit(0.0), lambda total, x: total + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))
    return F.coalesce(squares < 4e18, F.lit(False))


def _quantised(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    used = table.where(F.col(vec_id).isNotNull() & usable(embedding))
    return used.select(F.size(embedding).alias("dims"), F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"))


def _dealt(table: DataFrame, values: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt out to so many blocks that each holds about ``values`` components, and the number of blocks."""
    size = table.agg(F.sum(F.greatest(F.col("dims"), F.lit(1)).cast("long"))).first()[0] or 0
    blocks = size // values + 1
    return table.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), blocks


def _integers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of rows of one length, sorted by id."""
    table = table.sort_by("id")
    values = np.floor(_flat(table, "vector").astype(np.float64) * SCALE).astype(np.int32)
    return table.column("id").to_numpy(), values.reshape(table.num_rows, table.column("dims")[0].as_py())


def index(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The bit-sliced index of all vectors, one row per block."""
    dealt, _ = _dealt(_quantised(table, vec_id, embedding), BLOCK_VALUES, "cell")

    def build(rows: pa.Table) -> pa.Table:
        ids, vectors = _integers(rows)
        least, bits, slices = Block.sliced(vectors) if vectors.shape[1] else ([], [], np.empty(0, np.uint64))
        return _table(_INDEX, rows.column("dims").slice(0, 1), rows.column("cell").slice(0, 1), _one(ids, pa.int64()),
                      _one(vectors.ravel(), pa.int32()), _one(least, pa.int32()), _one(bits, pa.int32()),
                      pa.array([slices.tobytes()], pa.binary()))

    return dealt.groupBy("dims", "cell").applyInArrow(build, _INDEX)


def _merged(tables: Iterator[tuple[np.ndarray, ...]], k: int):
    """First k of several partial results of the same queries: (query ids, counts, ids, scores)."""
    tables = list(tables)
    query_ids, n = tables[0][0], len(tables[0][0])
    query = np.concatenate([np.repeat(np.arange(n), t[1]) for t in tables])
    ids, scores = np.concatenate([t[2] for t in tables]), np.concatenate([t[3] for t in tables])
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    first = rank < k
    return query_ids, np.bincount(query[first], minlength=n), ids[first], scores[first], rank[first] + 1


def search(built: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the first k candidates of every query. ``built`` is a written index."""
    cells = (built.agg(F.max("cell")).first()[0] or 0) + 1
    dealt, slots = _dealt(_quantised(queries, vec_id, embedding).distinct(), QUERY_VALUES, "slot")
    packed_schema = "dims int, slot long, query_ids array<long>, queries array<int>"

    def pack(rows: pa.Table) -> pa.Table:
        ids, vectors = _integers(rows)
        return _table(packed_schema, rows.column("dims").slice(0, 1), rows.column("slot").slice(0, 1), _one(ids, pa.int64()),
                      _one(vectors.ravel(), pa.int32()))

    packed = dealt.groupBy("dims", "slot").applyInArrow(pack, packed_schema)
    every_cell = packed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<long>")))
    every_slot = built.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<long>")))
    pair = ["dims", "slot", "cell"]
    nothing = to_arrow_schema(StructType.fromDDL(_PARTIAL)).empty_table()

    def ask(given: pa.Table, asked: pa.Table) -> pa.Table:
        if not given.num_rows or not asked.num_rows:
            return nothing
        dims = asked.column("dims")[0].as_py()
        ids = _flat(given, "ids")
        raw = np.frombuffer(given.column("slices")[0].as_py(), np.uint64)
        block = Block(ids, _flat(given, "vectors").reshape(len(ids), dims), _flat(given, "least"),
                      _flat(given, "bits").astype(np.int64), raw.reshape(-1, (len(ids) + 63) // 64))
        query_ids = _flat(asked, "query_ids")
        found = [block.search(int(i), q, k) for i, q in zip(query_ids, _flat(asked, "queries").reshape(len(query_ids), dims))]
        return _table(_PARTIAL, *[asked.column(c) for c in pair], _one(query_ids, pa.int64()), _one([len(f[0]) for f in found], pa.int32()),
                      _one(np.concatenate([f[0] for f in found]), pa.int64()), _one(np.concatenate([f[1] for f in found]), pa.int64()))

    def of(rows: pa.Table):
        lists = [rows.column(c).to_pylist() for c in ("query_ids", "counts", "ids", "scores")]
        return (tuple(np.array(x, np.int64) for x in row) for row in zip(*lists))

    def merge(rows: pa.Table) -> pa.Table:
        query_ids, counts, ids, scores, _ = _merged(of(rows), k)
        return _table(_PARTIAL, *[rows.column(c).slice(0, 1) for c in pair], _one(query_ids, pa.int64()), _one(counts, pa.int32()),
                      _one(ids, pa.int64()), _one(scores, pa.int64()))

    def finish(rows: pa.Table) -> pa.Table:
        query_ids, counts, ids, scores, rank = _merged(of(rows), k)
        return pa.table({"query_id": np.repeat(query_ids, counts), "rank": pa.array(rank, pa.int32()), "vec_id": ids, "score": scores})

    partial = every_slot.groupBy(*pair).cogroup(every_cell.groupBy(*pair)).applyInArrow(ask, _PARTIAL)
    some = partial.withColumn("cell", F.floor(F.col("cell") / MERGE)).groupBy(*pair).applyInArrow(merge, _PARTIAL)
    return some.groupBy("dims", "slot").applyInArrow(finish, "query_id long, rank int, vec_id long, score long")


def top(table: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The first k rows of a table for every query, over an index written to the shared folder."""
    return search(written(index(table, vec_id, embedding), "sliced"), queries, k, vec_id, embedding)

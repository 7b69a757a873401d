"""Scores of texts under a smoothed three-word model held in Elias-Fano tries.

Tokens are words (lower-cased A-Z, split at space and \\x09-\\x0D) and one end after each text. With c for counts in the
training texts and a_1, a_2 fixed numbers of occurrences,

    p(w)        = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)    = (c(vw) + a_1 p(w)) / (c(v) + a_1)
    p(w | u, v) = (c(uvw) + a_2 p(w | v)) / (c(uv) + a_2)

the longest context that training has seen counts; the first token of a text has none. For each context this sums to 1
over the V known words and one unknown, less what quantising rounds off (under 0.07 percent a factor).

How it runs. Texts are cut into chunks of about CHUNK bytes, written once with their words by hash. Chunks exchange
packed messages with shards, three times: words by range of hash (which numbers the known words, frequent ones first),
then pairs and triples by hash of the pair, each distinct one once per chunk, and the way back. A word or pair in a third
of all tokens is so one entry per chunk. A shard sums the training counts, codes them as a trie, and answers from it by
successor search. Counts cover the whole corpus; nothing is pruned. What reaches the driver is how many words of each
magnitude each range has.

Defined cases: null text is empty and scored as its end alone; rows without an id are scored, not held out, and not
learned from; repeated rows count and are scored each; without training texts every token is unknown. Only the columns
named are read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .tables import written
from .texts import mix, slices, utf8, word_hashes
from .trie import ABSENT, Trie, quantised, unquantised

CHUNK = 8_000_000  # bytes of text
WORD_BYTES, SHARD_BYTES = 64_000_000, 8_000_000  # of text per range of words, per shard of the model
PSEUDO = (1000.0, 4.0)
END = 0x5851F42D4C957F2D  # the hash of the end
_codec = pa.Codec("zstd", compression_level=3)
_NONE = np.uint16(1 << 15)  # stands for ABSENT in an answer


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each compressed by planes of bytes."""
    out = [struct.pack("<q", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
        body = _codec.compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<4sqq", a.dtype.str[1:].encode().ljust(4), len(a), len(body)), body]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    count, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for _ in range(count):
        kind, n, size = struct.unpack_from("<4sqq", raw, at)
        at += 20
        dtype = np.dtype("<" + kind.decode().strip())
        if n:
            planes = np.frombuffer(_codec.decompress(raw[at: at + size], n * dtype.itemsize, asbytes=True), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.empty(0, dtype))
        at += size
    return out


def relative(code: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Codes less what both ends know, modulo 2**16: few distinct values, which pack well."""
    return np.where(code == ABSENT, _NONE, code - base)


def absolute(given: np.ndarray, base: np.ndarray) -> np.ndarray:
    return np.where(given == _NONE, np.uint16(ABSENT), given + base)


def _count_code(count: np.ndarray, pseudo: float) -> np.ndarray:
    return quantised(1 / (count + pseudo))


_PARTS = "chunk long, part long, payload binary"


def _batch(rows: list[tuple], names=("chunk", "part", "payload")) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                           names=list(names))


def chunks(documents: DataFrame, doc_id: str, text: str, learn: Column) -> DataFrame:
    """(chunk, part = 0, payload, words): token numbers within the chunk, and the hash and training count of each."""
    table = documents.select(F.col(doc_id).cast("long").alias("doc_id"), learn.cast("int").alias("learn"), F.col(text).alias("text"))

    def work(batches):
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, learned = batch.column(0), batch.column(1).to_numpy().astype(np.uint8)
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, CHUNK):
                words, bounds = word_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                sizes = np.diff(bounds)
                tokens = np.full(len(words) + b - a, END, np.uint64)
                tokens[np.arange(len(words)) + np.repeat(np.arange(b - a), sizes)] = words
                known, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                place = rank[place]
                times = np.bincount(place, np.repeat(learned[a:b], sizes + 1), len(known)).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([chunk], pa.int64()), pa.array([0], pa.int64()),
                     pa.array([packed(ids[a:b].astype("<i8"), missing[a:b], learned[a:b], (sizes + 1).astype("<i8"),
                                      place.astype("<u4"))], pa.binary()),
                     pa.array([packed(known[order], times)], pa.binary())], names=["chunk", "part", "payload", "words"])
                chunk += 1

    return table.mapInArrow(work, _PARTS + ", words binary")


def _ranges_of_words(chunked: DataFrame, ranges: int) -> DataFrame:
    """Answers (chunk, part = range + 1, payload: rank among known words of its magnitude, count) in the order asked;
    and for chunk -1 how many known words of each magnitude the range has, with their tokens."""

    def ask(batches):
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, times = unpacked(raw)
                to = ((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                words, times, cut = words[order], times[order], np.searchsorted(to[order], np.arange(ranges + 1))
                yield _batch([(chunk, k, packed(words[a:b], times[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))])

    def answer(table):
        messages = [unpacked(x) for x in table.column("payload").to_pylist()]
        words, times = np.concatenate([m[0] for m in messages]), np.concatenate([m[1] for m in messages])
        distinct, place = np.unique(words, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, times)
        size = np.frexp(total.astype(np.float64))[1]  # magnitude: 0 for unknown, else bits of the count
        rank = np.zeros(len(distinct), np.int64)
        stats = np.zeros((65, 2), np.int64)
        for k in np.unique(size[size > 0]):
            rank[size == k] = np.arange((size == k).sum())
            stats[k] = (size == k).sum(), total[size == k].sum()
        part = table.column("part")[0].as_py() + 1
        rows, at = [(-1, part, packed(stats.ravel()))], 0
        for chunk, m in zip(table.column("chunk").to_pylist(), messages):
            mine = place[at: at + len(m[0])]
            rows.append((chunk, part, packed(rank[mine].astype("<u4"), total[mine])))
            at += len(m[0])
        return pa.Table.from_batches([_batch(rows)])

    return chunked.select("chunk", "words").mapInArrow(ask, _PARTS).groupBy("part").applyInArrow(answer, _PARTS)


class _Chunk:
    """Tokens of a chunk with word numbers and counts, and its distinct pairs and triples, always in the same order."""

    def __init__(self, rows: dict[int, bytes], ranges: int, base: np.ndarray, shards: int):
        self.ids, self.missing, self.learned, self.sizes, place = unpacked(rows[0])
        self.shards = shards
        # The chunk knows its words by rank; answers come by range of hash, which the order within each range keeps.
        answers = [unpacked(rows[k + 1]) for k in range(ranges)]
        order = unpacked(rows[-2])[0].astype(np.int64)
        by_range = np.argsort(order, kind="stable")
        rank, total = (np.concatenate([a[k] for a in answers])[np.argsort(by_range)] for k in (0, 1))
        size = np.frexp(total.astype(np.float64))[1]
        number = np.where(total > 0, base[order, size] + rank, -1)
        self.number, self.count = number[place], total[place]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.learns = self.learned[owner].astype(np.float64)
        n = len(self.number)
        known, same = self.number >= 0, np.zeros(n, bool)
        same[1:] = owner[1:] == owner[:-1]
        before = np.concatenate([[-1], self.number[:-1]]) if n else self.number
        self.paired = same & known & (before >= 0)
        self.before_count = np.where(same, np.concatenate([[0], self.count[:-1]]), 0) if n else self.count
        pairs = before[self.paired].astype(np.uint64) << np.uint64(32) | self.number[self.paired].astype(np.uint64)
        self.pairs, inverse = np.unique(pairs, return_inverse=True)
        self.pair = np.full(n, -1)
        self.pair[self.paired] = inverse
        self.context = np.concatenate([[-1], self.pair[:-1]]) if n else self.pair  # the pair that ends one token earlier
        self.context = np.where(same, self.context, -1)
        self.tripled = (self.context >= 0) & known
        triples = self.context[self.tripled].astype(np.uint64) << np.uint64(32) | self.number[self.tripled].astype(np.uint64)
        self.triples, self.triple = np.unique(triples, return_inverse=True)
        self.parent = (self.triples >> np.uint64(32)).astype(np.int64)
        self.shard = (mix(self.pairs) % np.uint64(shards)).astype(np.int64)
        self.by_pair = np.argsort(self.shard, kind="stable")
        self.pair_cut = np.searchsorted(self.shard[self.by_pair], np.arange(shards + 1))
        self.first_count = np.zeros(len(self.pairs), np.int64)
        self.first_count[self.pair[self.paired]] = self.before_count[self.paired]
        self.by_triple = np.argsort(self.shard[self.parent], kind="stable")
        self.triple_cut = np.searchsorted(self.shard[self.parent][self.by_triple], np.arange(shards + 1))

    def questions(self, chunk: int) -> list[tuple]:
        """Per shard: first words with their counts and numbers of pairs; second words, counts, numbers of triples;
        third words, counts."""
        pair_times = np.bincount(self.pair[self.paired], self.learns[self.paired], len(self.pairs)).astype(np.int64)
        triple_times = np.bincount(self.triple, self.learns[self.tripled], len(self.triples)).astype(np.int64)
        fan = np.bincount(self.parent, minlength=len(self.pairs))
        rows = []
        for s in range(self.shards):
            p = self.by_pair[self.pair_cut[s]: self.pair_cut[s + 1]]
            t = self.by_triple[self.triple_cut[s]: self.triple_cut[s + 1]]
            if not len(p):
                continue
            u = (self.pairs[p] >> np.uint64(32)).astype("<u4")
            head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            rows.append((s, chunk, packed(
                np.diff(u[head], prepend=np.uint32(0)).astype("<u4"), self.first_count[p[head]], np.diff(np.append(head, len(u))).astype("<u4"),
                self.pairs[p].astype("<u4"), pair_times[p].astype("<u4"), fan[p].astype("<u4"),
                self.triples[t].astype("<u4"), triple_times[t].astype("<u4"))))
        return rows

    def scores(self, rows: dict[int, bytes], tokens: int, words: int, pseudo) -> pa.RecordBatch:
        pair_part, pair_backoff = (np.full(len(self.pairs), ABSENT, np.uint16) for _ in range(2))
        triple_part = np.full(len(self.triples), ABSENT, np.uint16)
        for s in range(self.shards):
            p = self.by_pair[self.pair_cut[s]: self.pair_cut[s + 1]]
            if len(p):
                t = self.by_triple[self.triple_cut[s]: self.triple_cut[s + 1]]
                pair, pair_backoff[p], triple = unpacked(rows[s])
                pair_part[p] = absolute(pair, _count_code(self.first_count[p], pseudo[0]))
                triple_part[t] = absolute(triple, pair_backoff[self.parent[t]])
        alone = (self.count + 0.5) / (tokens + 0.5 * (words + 1))
        p = alone.copy()
        after = self.before_count > 0
        p[after] *= unquantised(quantised(pseudo[0] / (self.before_count[after] + pseudo[0])))
        p[self.paired] += unquantised(pair_part)[self.pair[self.paired]]
        context = np.flatnonzero(self.context >= 0)
        backoff = pair_backoff[self.context[context]]
        seen = backoff != ABSENT  # the pair occurs in training
        p[context[seen]] *= unquantised(backoff[seen])
        p[self.tripled] += unquantised(triple_part)[self.triple]
        starts = np.cumsum(self.sizes) - self.sizes
        add = (lambda x: np.add.reduceat(x, starts)) if len(starts) else (lambda x: x[:0])
        return pa.record_batch(
            [pa.array(self.ids, pa.int64(), mask=self.missing.astype(bool)), pa.array(self.sizes, pa.int64()),
             pa.array(add((self.count > 0).astype(np.int64)), pa.int64()),
             pa.array(np.full(len(self.ids), tokens), pa.int64()), pa.array(add(np.log10(alone))), pa.array(add(np.log10(p)))],
            names=[c.split()[0] for c in RESULT.split(", ")])


def _shard(table: pa.Table, words: int, pseudo) -> tuple[bytes, Callable]:
    """The trie of a shard's training counts, and a function that answers the questions from it."""
    messages = [unpacked(x) for x in table.column("payload").to_pylist()]
    pairs, times, firsts, triple_pairs, thirds, triple_times, at = [], [], [], [], [], [], 0
    for message in messages:
        message[0] = np.cumsum(message[0], dtype=np.uint32)
    for u, u_count, n, v, c, fan, w, wc in messages:
        pairs.append(np.repeat(u, n).astype(np.uint64) << np.uint64(32) | v.astype(np.uint64))
        firsts.append(np.repeat(u_count, n))
        times.append(c)
        triple_pairs.append(np.repeat(np.arange(at, at + len(v)), fan))
        thirds.append(w)
        triple_times.append(wc)
        at += len(v)
    pairs, firsts, times = np.concatenate(pairs), np.concatenate(firsts), np.concatenate(times).astype(np.float64)
    triple_pairs, thirds = np.concatenate(triple_pairs), np.concatenate(thirds)
    triple_times = np.concatenate(triple_times).astype(np.float64)

    # Each distinct pair and triple is summed once and asked for once, in whichever messages it stands.
    asked, place = np.unique(pairs, return_inverse=True)
    count = np.bincount(place, times, len(asked))
    asked_triple, place_3 = np.unique(place[triple_pairs].astype(np.uint64) << np.uint64(32) | thirds.astype(np.uint64), return_inverse=True)
    triple_count = np.bincount(place_3, triple_times, len(asked_triple))
    asked_u, asked_v = (asked >> np.uint64(32)).astype(np.int64), (asked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    parent, asked_w = (asked_triple >> np.uint64(32)).astype(np.int64), (asked_triple & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first_count = np.zeros(len(asked))
    first_count[place] = firsts
    learned, learned_triple = count > 0, triple_count > 0
    node = np.cumsum(learned) - 1
    raw = Trie.built(words, asked_u[learned], asked_v[learned], count[learned], first_count[learned],
                     node[parent[learned_triple]], asked_w[learned_triple], triple_count[learned_triple], pseudo)

    def answers(trie: Trie) -> list[bytes]:
        found = trie.pair(asked_u, asked_v)
        part, backoff = trie.pair_codes(found)
        triple = relative(trie.triple_codes(trie.triple(found[parent], asked_v[parent], asked_w)), backoff[parent])
        part = relative(part, _count_code(first_count, pseudo[0]))
        out, at, at_3 = [], 0, 0
        for _, _, _, v, _, _, w, _ in messages:
            mine, mine_3 = place[at: at + len(v)], place_3[at_3: at_3 + len(w)]
            out.append(packed(part[mine], backoff[mine], triple[mine_3]))
            at, at_3 = at + len(v), at_3 + len(w)
        return out

    return raw, answers


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Scorer:
    """Counts of a corpus on their way to scores or to a stored model."""

    def __init__(self, documents: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text",
                 pseudo: tuple[float, float] = PSEUDO):
        self.pseudo = pseudo
        size = documents.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
        self.ranges, self.shards = size // WORD_BYTES + 1, size // SHARD_BYTES + 1
        self.chunked = written(chunks(documents, doc_id, text, learn), "chunks")
        self.answers = written(_ranges_of_words(self.chunked, self.ranges), "words")
        stats = np.zeros((self.ranges, 65, 2), np.int64)
        for row in self.answers.where("chunk = -1").select("part", "payload").collect():
            stats[row.part - 1] = unpacked(row.payload)[0].reshape(65, 2)
        self.words, self.tokens = int(stats[:, :, 0].sum()), int(stats[:, :, 1].sum())
        # Numbers of known words: large counts first, within a magnitude by range and rank.
        sizes = stats[:, ::-1, 0].T.ravel()
        self.base = np.ascontiguousarray((np.cumsum(sizes) - sizes).reshape(65, self.ranges)[::-1].T)

    def _with_answers(self) -> DataFrame:
        ranges = self.ranges

        def order(batches):
            for batch in batches:
                for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    to = (unpacked(raw)[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                    yield _batch([(chunk, -2, packed(to.astype("<u4")))])

        return (
            self.chunked.select("chunk", "part", "payload")
            .unionByName(self.chunked.select("chunk", "words").mapInArrow(order, _PARTS))
            .unionByName(self.answers.where("chunk >= 0"))
        )

    def _questions(self, with_answers: DataFrame) -> DataFrame:
        ranges, base, shards = self.ranges, self.base, self.shards

        def ask(table):
            rows = dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))
            made = _Chunk(rows, ranges, base, shards).questions(table.column("chunk")[0].as_py())
            return pa.Table.from_batches([_batch(made, ("shard", "chunk", "payload"))])

        return with_answers.groupBy("chunk").applyInArrow(ask, "shard long, chunk long, payload binary")

    def model(self) -> DataFrame:
        """(shard, trie): the coded tries, to be kept; a pair's shard is its hash modulo the number of shards."""
        words, pseudo = self.words, self.pseudo

        def build(table):
            return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([_shard(table, words, pseudo)[0]], pa.binary())})

        return self._questions(self._with_answers()).groupBy("shard").applyInArrow(build, "shard long, trie binary")

    def scores(self) -> DataFrame:
        ranges, base, shards, words, tokens, pseudo = (
            self.ranges, self.base, self.shards, self.words, self.tokens, self.pseudo)

        def answer(table):
            raw, answers = _shard(table, words, pseudo)
            shard = table.column("shard")[0].as_py()
            return pa.Table.from_batches([_batch([
                (chunk, shard, reply)
                for chunk, reply in zip(table.column("chunk").to_pylist(), answers(Trie(raw)))])])

        def score(chunk, replies):
            rows, found = (dict(zip(t.column("part").to_pylist(), t.column("payload").to_pylist())) for t in (chunk, replies))
            return pa.Table.from_batches([_Chunk(rows, ranges, base, shards).scores(found, tokens, words, pseudo)])

        # One table for both groupings: its shuffle by chunk is made once and read twice.
        with_answers = self._with_answers()
        replies = self._questions(with_answers).groupBy("shard").applyInArrow(answer, _PARTS)
        return with_answers.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, RESULT)

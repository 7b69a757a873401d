"""Removal of repeated passages: blockwise sorting of suffixes, long ties resolved by ranks of a difference cover.

A suffix counts as repeated where its first LENGTH bytes also start earlier (smaller id, or same document and earlier
byte). Suffixes are sorted one bucket at a time, and no bucket needs more than its own bytes.

* Bucket. Among the KEY-byte strings inside the first LENGTH bytes of a suffix, the one of least hash is its anchor
  (the leftmost of equals). Equal prefixes have equal anchors, so a bucket is a range of anchor hashes. One anchor
  serves some 36 neighbouring suffixes, which travel as one run of bytes.
* Which suffixes. An anchor string that stands in one place only proves its suffixes unrepeated. The first pass counts
  anchors, each task telling a place at most once per batch of rows; only suffixes with a repeated anchor are sorted.
  Documents with one and the same text count as one.
* Sorting. The suffixes of a bucket are brought together by a 40-bit code of their first V bytes. Ties are resolved
  against the earliest suffix of the tie: bytes 0..V and the last V - 1 are compared as words, and all between by one
  comparison of precomputed ranks. For any two positions there is a shift below V that takes both to positions of the
  difference cover modulo V, and for these positions (6 of 31) the rank of the next LENGTH - V + 1 bytes is known. Ranks
  are exact, by sorting 8-byte words and pairs of ranks; no repeat rests on a hash alone.
* Each task first sorts its own suffixes, PIECE bytes of text at a time, and sends on only the earliest of each kind, so
  that a passage in a third of all documents reaches its bucket once per piece.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows without an id lose nothing and take
nothing from others; equal rows count as one document and get the same result each; different texts under one id count as
documents in order of their hash. Only the columns named are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import written
from .texts import mix, powers, utf8

LENGTH = 100
KEY = 32
V = 31
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 occurs
PIECE = 1 << 20  # bytes looked at together
ANCHOR_BYTES, SORT_BYTES = 32_000_000, 8_000_000  # of text per bucket, in the two passes

_WIDTH = LENGTH - KEY + 1
_PLACE = 24  # bits of a place in a piece
_in_cover = np.isin(np.arange(V), COVER)
_shift = np.array([[next(d for d in range(V) if _in_cover[(a + d) % V] and _in_cover[(b + d) % V]) for b in range(V)]
                   for a in range(V)])
_codec = pa.Codec("zstd", compression_level=1)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers; data must go on 7 bytes after the last position used."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data).data, strides=(1,))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """Texts of at least LENGTH bytes in groups of about PIECE bytes: bytes, where each part ends, text, first byte.

    A longer text comes in parts that overlap by LENGTH - 1 bytes, so that each suffix has its prefix in one part.
    """
    parts, size = [], 0
    for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
        begin, end = int(offsets[i]), int(offsets[i + 1])
        for at in range(begin, end - LENGTH + 1, PIECE):
            to = min(at + PIECE + LENGTH - 1, end)
            if parts and size + to - at > PIECE + LENGTH:
                yield _joined(data, parts)
                parts, size = [], 0
            parts.append((i, at - begin, at, to))
            size += to - at
    if parts:
        yield _joined(data, parts)


def _joined(data, parts):
    text, base, begin, end = (np.array(x, np.int64) for x in zip(*parts))
    return np.concatenate([data[a:b] for _, _, a, b in parts]), np.concatenate([[0], np.cumsum(end - begin)]), text, base


def anchor_runs(data: np.ndarray, bounds: np.ndarray):
    """Runs of neighbouring suffixes with one anchor: part, first suffix, how many, place of the anchor, its hash."""
    n = len(data)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = mix((sums[KEY:] - sums[:-KEY]) * inverse[: n - KEY + 1])
    keys = np.full(-(-len(hashes) // _WIDTH) * _WIDTH, np.uint64(2**64 - 1))
    keys[: len(hashes)] = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = keys.reshape(-1, _WIDTH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[_WIDTH - 1: n - LENGTH + _WIDTH])
    whole = np.zeros(n - LENGTH + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        whole[a: b - LENGTH + 1] = True
    start = np.flatnonzero(whole)
    place = (least[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    begin, place = start[first], place[first]
    return np.searchsorted(bounds, begin, "right") - 1, begin, np.diff(np.append(first, len(start))), place, hashes[place]


def _dense(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Ranks of values, or of pairs of ranks."""
    return np.unique(a if b is None else a << np.uint64(32) | b, return_inverse=True)[1].astype(np.uint64)


def cover_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At each position of the cover within V bytes of a suffix: the rank of the LENGTH - V + 1 bytes from there."""
    words, n = _words(data), len(data) + 1

    def reach(length):
        marks = np.zeros(n, np.int32)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        return np.cumsum(marks)[:-1] > 0

    places = np.flatnonzero(reach(2 * V) & np.resize(_in_cover, n - 1))
    short = _dense(words[places])
    for k in (8, 16, V - 8):
        short = _dense(short, _dense(words[places + k]))
    out = np.zeros(n - 1, np.uint32)
    out[places] = short
    places = places[reach(V)[places]]
    both = _dense(out[places].astype(np.uint64), out[places + V].astype(np.uint64))
    out[places] = _dense(both, _dense(words[places + 2 * V]))  # 31 + 31 + 8 = LENGTH - V + 1 bytes
    return out


def earliest(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each suffix (given in order) the number of the first one with the same LENGTH bytes."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    words, ranks = _words(data), cover_ranks(data, at)

    def code(offsets):
        out = np.zeros(len(at), np.uint64)
        for k in offsets:
            out = mix(out + words[at + k])
        return out

    out, left, codes, rounds = np.arange(len(at)), np.arange(len(at)), code((0, 8, 16, V - 8)), 0
    while len(left):
        bits = np.uint64(max(24, len(left).bit_length()))
        order = np.sort((codes[left] >> bits << bits) | np.arange(len(left), dtype=np.uint64))
        member = left[(order & np.uint64((1 << int(bits)) - 1)).astype(np.int64)]
        tie = order >> bits
        first = np.flatnonzero(np.concatenate([[True], tie[1:] != tie[:-1]]))
        leader = np.repeat(member[first], np.diff(np.append(first, len(member))))
        a, b = at[leader], at[member]
        shift = _shift[a % V, b % V]
        same = ranks[a + shift] == ranks[b + shift]
        for k in (0, 8, 16, V - 8, LENGTH - V + 1, LENGTH - V + 9, LENGTH - V + 17, LENGTH - 8):
            same &= words[a + k] == words[b + k]
        out[member[same]] = leader[same]
        left, rounds = np.sort(member[~same]), rounds + 1
        if rounds == 3:  # many continuations of one beginning: take in all bytes to part them
            codes = code((*range(0, LENGTH - 8, 8), LENGTH - 8))
    return out


def _again(lead, ids, digests, doc, start) -> np.ndarray:
    """Whether the first equal suffix lies before: smaller id, hash of the text for texts of one id, or first byte."""
    a, b = doc[lead], doc
    return (ids[a] < ids[b]) | ((ids[a] == ids[b]) & (
        (digests[a] < digests[b]) | ((digests[a] == digests[b]) & (start[lead] < start))))


def _expanded(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of every run."""
    total = int(count.sum())
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.empty(0, np.int64)


def _runs(group: np.ndarray, start: np.ndarray):
    """Ascending numbers in groups as runs: index of the first of each, and how many."""
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start)))


def _packed(*arrays: np.ndarray) -> bytes:
    body = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<q", len(body)) + _codec.compress(body, asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return _codec.decompress(raw[8:], struct.unpack_from("<q", raw)[0], asbytes=True)


_FOUND = "bucket long, doc_id long, digest long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                           names=["bucket", "doc_id", "digest", "payload"])


def _by_document(doc, ids, digests, *columns) -> Iterator[tuple]:
    """Rows (no bucket, doc_id, digest, numbers as bytes) from ascending documents."""
    for a, b in zip(*(lambda cut: (cut, [*cut[1:], len(doc)]))(np.flatnonzero(np.diff(doc, prepend=-1)).tolist())):
        yield -1, int(ids[doc[a]]), int(digests[doc[a]]), np.stack([c[a:b] for c in columns], 1).astype("<i8").tobytes()


def _notes(groups: int, doc, ids, digests, *columns) -> Iterator[tuple]:
    """Numbers found about documents, as one message per group of documents (bucket -1, -2, ..)."""
    group = (mix(ids.view(np.uint64) + mix(digests.view(np.uint64))) % np.uint64(groups)).astype(np.int64)[doc]
    order = np.argsort(group, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    for a, b in zip(cut[:-1], cut[1:]):
        mine = order[a:b]
        of, local = np.unique(doc[mine], return_inverse=True)
        yield -1 - int(group[mine[0]]), None, None, _packed(
            np.array([len(of), len(mine)], "<i8"), ids[of], digests[of], local.astype("<i8"), *[c[mine].astype("<i8") for c in columns])


def _gathered(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, payload): the notes about each document together, ``width`` numbers each, in ascending order."""

    def gather(table):
        ids, digests, docs, numbers, before = [], [], [], [], 0
        for raw in table.column("payload").to_pylist():
            body = _unpacked(raw)
            n, m = (int(x) for x in np.frombuffer(body, "<i8", 2))
            whole = np.frombuffer(body, "<i8", -1, 16)
            ids.append(whole[:n]), digests.append(whole[n: 2 * n]), docs.append(whole[2 * n: 2 * n + m] + before)
            numbers.append(whole[2 * n + m:].reshape(width, m))
            before += n
        ids, digests, docs, numbers = np.concatenate(ids), np.concatenate(digests), np.concatenate(docs), np.concatenate(numbers, axis=1)
        order = np.lexsort((numbers[0], digests[docs], ids[docs]))
        docs, numbers = docs[order], numbers[:, order]
        new = np.ones(len(docs), bool)
        new[1:] = (ids[docs[1:]] != ids[docs[:-1]]) | (digests[docs[1:]] != digests[docs[:-1]])
        return pa.Table.from_batches([_rows(list(_by_document(np.cumsum(new) - 1, ids[docs[new]], digests[docs[new]], *numbers)))])

    return found.groupBy("bucket").applyInArrow(gather, _FOUND).select("doc_id", "digest", "payload")


def _repeated_anchors(table: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, digest, payload): places of the anchors that stand in more than one place."""

    def look(batches):
        for batch in batches:
            ids, digests = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = utf8(batch.column(2))
            # Of equal texts of a batch the smallest id speaks for all.
            order = np.lexsort((ids, digests))
            heads = order[np.flatnonzero(np.concatenate([[True], digests[order][1:] != digests[order][:-1]]))] if len(ids) else order
            speaks = np.zeros(len(ids), bool)
            speaks[heads] = True
            found = []
            for part, bounds, text, base in pieces(data, offsets):
                run, _, _, place, hashes = anchor_runs(part, bounds)
                keep = speaks[text[run]]
                found.append((hashes[keep], text[run][keep], (place - bounds[run] + base[run])[keep]))
            if not found:
                continue
            hashes, doc, place = (np.concatenate(x) for x in zip(*found))
            new = np.ones(len(doc), bool)  # parts of a long text may both give the anchor at their border
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            hashes, doc, place = hashes[new], doc[new], place[new]
            order = np.argsort(hashes)
            first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
            size = np.diff(np.append(first, len(order)))
            here = np.sort(order[np.repeat(size > 1, size)])
            rows = list(_notes(buckets, doc[here], ids, digests, place[here]))
            head, known = order[first], size > 1  # one message per anchor string; known: repeated in this batch already
            by = np.argsort(hashes[head] % np.uint64(buckets), kind="stable")
            head, known = head[by], known[by]
            target = (hashes[head] % np.uint64(buckets)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(target, prepend=-1)), len(target))
            for a, b in zip(cut[:-1], cut[1:]):
                of, local = np.unique(doc[head[a:b]], return_inverse=True)
                rows.append((int(target[a]), None, None, _packed(
                    np.array([len(of), b - a], "<i8"), ids[of], digests[of], hashes[head[a:b]],
                    np.where(known[a:b], -1, place[head[a:b]]), local.astype("<u4"))))
            yield _rows(rows)

    def meet(table):
        ids, digests, hashes, places, docs, before = [], [], [], [], [], 0
        for raw in table.column("payload").to_pylist():
            body = _unpacked(raw)
            n, m = np.frombuffer(body, "<i8", 2)
            ids.append(np.frombuffer(body, "<i8", n, 16))
            digests.append(np.frombuffer(body, "<i8", n, 16 + 8 * n))
            hashes.append(np.frombuffer(body, "<u8", m, 16 + 16 * n))
            places.append(np.frombuffer(body, "<i8", m, 16 + 16 * n + 8 * m))
            docs.append(np.frombuffer(body, "<u4", m, 16 + 16 * n + 16 * m).astype(np.int64) + before)
            before += n
        ids, digests, hashes, places, docs = (np.concatenate(x) for x in (ids, digests, hashes, places, docs))
        where = mix(digests[docs].view(np.uint64) + places.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(hashes)
        first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        size = np.diff(np.append(first, len(order)))
        sorted_where = where[order]
        several = np.minimum.reduceat(sorted_where, first) != np.maximum.reduceat(sorted_where, first)
        several |= np.minimum.reduceat(places[order], first) < 0
        hit = np.sort(order[np.repeat(several, size)])
        hit = hit[places[hit] >= 0]
        return pa.Table.from_batches([_rows(list(_notes(buckets, docs[hit], ids, digests, places[hit])))])

    seen = written(table.mapInArrow(look, _FOUND), "anchors")
    far = seen.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, _FOUND)
    return _gathered(seen.where("bucket < 0").unionByName(far), 1)


def _send(data, begin, count, doc, start, ids, digests, bucket) -> Iterator[tuple]:
    """Runs of suffixes with their bytes, one message per bucket."""
    order = np.argsort(bucket, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(cut[:-1], cut[1:]):
        mine = order[a:b]
        of, local = np.unique(doc[mine], return_inverse=True)
        content = data[_expanded(begin[mine], count[mine] + LENGTH - 1)]
        yield int(bucket[mine[0]]), None, None, _packed(
            np.array([len(of), len(mine)], "<i8"), ids[of], digests[of], start[mine], count[mine], local.astype("<i8"), content)


def _sorted_suffixes(table: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, digest, payload): runs of repeated suffixes as pairs (first byte, how many).

    table: doc_id, digest, text, places (those of repeated anchors).
    """

    def local(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))))
            ids, digests = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = utf8(batch.column(2))
            wanted = [np.frombuffer(x, "<i8") for x in batch.column(3).to_pylist()]
            wanted = np.sort(np.concatenate([*[w | i << 40 for i, w in enumerate(wanted)], np.empty(0, np.int64)]))
            for part, bounds, text, base in pieces(data, offsets):
                run, begin, count, place, hashes = anchor_runs(part, bounds)
                hit = np.isin((place - bounds[run] + base[run]) | text[run] << 40, wanted)
                if not hit.any():
                    continue
                run, begin, count, hashes = run[hit], begin[hit], count[hit], hashes[hit]
                at = _expanded(begin, count)
                of, start = np.repeat(run, count), np.repeat(begin, count)
                start = at - bounds[of] + base[of]
                lead = earliest(part, at)
                doc = text[of]
                again = _again(lead, ids, digests, doc, start)
                rows = []
                first, size = _runs(doc[again], start[again])
                if len(first):
                    rows += _notes(buckets, doc[again][first], ids, digests, start[again][first], size)
                alone = ~again
                anchor = np.repeat(np.arange(len(run)), count)[alone]
                if len(anchor):
                    first, size = _runs(anchor, at[alone])
                    rows += _send(part, at[alone][first], size, doc[alone][first], start[alone][first], ids, digests,
                                  (hashes[anchor[first]] % np.uint64(buckets)).astype(np.int64))
                yield _rows(rows)

    def meet(table):
        ids, digests, starts, counts, docs, contents, before = [], [], [], [], [], [], 0
        for raw in table.column("payload").to_pylist():
            body = _unpacked(raw)
            n, m = (int(x) for x in np.frombuffer(body, "<i8", 2))
            ids.append(np.frombuffer(body, "<i8", n, 16))
            digests.append(np.frombuffer(body, "<i8", n, 16 + 8 * n))
            numbers = np.frombuffer(body, "<i8", 3 * m, 16 + 16 * n)
            starts.append(numbers[:m]), counts.append(numbers[m: 2 * m]), docs.append(numbers[2 * m:] + before)
            contents.append(np.frombuffer(body, np.uint8, -1, 16 + 16 * n + 24 * m))
            before += n
        ids, digests, start, count, doc, data = (np.concatenate(x) for x in (ids, digests, starts, counts, docs, contents))
        begin = np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
        order = np.lexsort((start, digests[doc], ids[doc]))
        begin, start, count, doc = begin[order], start[order], count[order], doc[order]
        lead = earliest(data, _expanded(begin, count))
        start, doc = _expanded(start, count), np.repeat(doc, count)
        again = _again(lead, ids, digests, doc, start)
        start, doc = start[again], doc[again]
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        first, size = _runs(doc, start)
        return pa.Table.from_batches([_rows(list(_notes(buckets, doc[first], ids, digests, start[first], size)) if len(first) else [])])

    seen = written(table.mapInArrow(local, _FOUND), "suffixes")
    far = seen.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, _FOUND)
    return _gathered(seen.where("bucket < 0").unionByName(far), 2)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, bytes of the text, bytes and runs removed, SHA-256 of what is left, and (if asked for) that itself."""
    table = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = table.withColumn("digest", F.xxhash64("text")).select("doc_id", "digest", "text")
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    long = table.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    hashed = long.select("doc_id", "digest", F.unhex(F.md5("text")).alias("same"))
    firsts = hashed.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(hashed.join(firsts, "same").where("doc_id > first").select("doc_id", "digest").distinct(), "copies")

    anchors = _repeated_anchors(long, size // ANCHOR_BYTES + 1)
    places = anchors.withColumnRenamed("payload", "places").join(copies, ["doc_id", "digest"], "left_anti")
    sought = long.join(places, ["doc_id", "digest"]).select("doc_id", "digest", "text", "places")
    runs = _sorted_suffixes(sought, size // SORT_BYTES + 1)
    marks = (
        runs.select("doc_id", "digest", "payload", F.lit(False).alias("copy"))
        .unionByName(copies.select("doc_id", "digest", F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("copy")))
        .groupBy("doc_id", "digest").agg(F.collect_list("payload").alias("runs"), F.max("copy").alias("copy"))
    )

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for i, (runs, copy) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                mine = data[offsets[i]: offsets[i + 1]]
                gone = np.zeros(len(mine) + 1, np.int64)
                for begin, count in np.frombuffer(b"".join(runs or []), "<i8").reshape(-1, 2).tolist():
                    gone[begin] += 1
                    gone[begin + count + LENGTH - 1] -= 1
                hit = np.cumsum(gone[:-1]) > 0 if not copy else np.ones(len(mine), bool)
                left = mine[~hit].tobytes()
                out.append((len(mine), int(hit.sum()), int((np.diff(hit.astype(np.int8), prepend=0) == 1).sum()),
                            sha256(left).hexdigest(), left if keep_text else None))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()),
                 pa.array(columns[4], pa.binary())], names=[c.split()[0] for c in RESULT.split(", ")])

    result = table.join(marks, ["doc_id", "digest"], "left").select("doc_id", "text", "runs", "copy").mapInArrow(cut, RESULT)
    return result if keep_text else result.drop("kept")

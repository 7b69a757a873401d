"""Document fingerprints by consistent weighted sampling.

A text is a bag of words (lower-cased A-Z, split at space and \\x09-\\x0D), a word's weight is how often it occurs. For
each sample i and word k, three draws are fixed by their hash: r and c from Gamma(2, 1), beta uniform. With
t = floor(ln(weight) / r + beta), the word with the smallest ln(c) - r (t - beta + 1) is the sample, and (word, t) falls
on the same value for two texts with a probability equal to their generalised Jaccard similarity, sum of minima over
sum of maxima of the weights. A fingerprint keeps 16 bits of each (word, t), ``SAMPLES`` of them, as hexadecimal text.

Draws are made once per distinct word and weight of a slice of texts, not once per text. Values are compared in their
leading 36 bits; ties go by word hash. Both are the same wherever a text is, so that equal texts get equal fingerprints.

Defined cases: of ``against_edits``, null texts are empty, rows of one id come in the order of their texts, and rows without
an id before all others; a lone row is its own next one. A text without words (null, empty, white space) has the empty fingerprint; its likeness is 1 to another
such text and 0 to any other. Words are hashed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import Carried
from .texts import mix, slices, utf8, word_hashes

SAMPLES = 96
SLICE = 4_000_000  # bytes of text fingerprinted at a time
_GROUP = 8  # samples drawn at a time
_PLACE = np.uint64(28)  # bits for a word's place among the distinct words of a text
_STEP = 0x9E3779B97F4A7C15


# Exponential draws by 16 bits; two of them add up to one of Gamma(2, 1).
_EXPONENTIAL = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))


def _draws(words: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta and ln(c) of each word in one sample."""
    bits = mix(words + np.uint64((sample + 1) * _STEP % 2**64))
    four = bits.view(np.uint16).reshape(-1, 4)
    r = _EXPONENTIAL[four[:, 0]] + _EXPONENTIAL[four[:, 1]]
    c = _EXPONENTIAL[four[:, 2]] + _EXPONENTIAL[four[:, 3]]
    other = (bits ^ bits >> np.uint64(29)) * np.uint64(0xD1B54A32D192ED03)
    beta = (other >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return r, beta, np.log(c)


def _counted(words: np.ndarray, bounds: np.ndarray):
    """Distinct words of each text in ascending order, their counts, and the ranges of texts."""
    words = words.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        words[a:b].sort()
    new = np.empty(len(words), bool)
    new[:1], new[1:] = True, words[1:] != words[:-1]
    new[bounds[:-1][bounds[:-1] < len(words)]] = True
    at = np.flatnonzero(new)
    return words[at], np.diff(np.append(at, len(words))), np.searchsorted(at, bounds)


def sketch(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (texts x samples, 16 bits each) and whether a text has words at all."""
    words, times, ranges = _counted(*word_hashes(data, offsets))
    full = np.diff(ranges) > 0
    out = np.zeros((len(offsets) - 1, samples), np.uint16)
    if not full.any():
        return out, full
    starts = ranges[:-1][full]
    distinct, code = np.unique(words, return_inverse=True)
    both, entry = np.unique(code.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64), return_inverse=True)
    owner, log_weight = (both >> np.uint64(32)).astype(np.int64), np.log((both & np.uint64(0xFFFFFFFF)).astype(np.float64))
    # The lowest bits of a key hold the place of the word in its text. Words come in the order of their hashes there, so
    # that of values equal in the bits above the smaller hash wins in every text alike.
    size = np.diff(ranges)[full]
    place = (np.arange(len(entry)) - np.repeat(starts, size)).astype(np.uint64)[:, None]
    keys, levels = np.zeros((len(both), _GROUP), np.uint64), np.zeros((len(both), _GROUP), np.int32)
    mine = np.empty((len(entry), _GROUP), np.uint64)
    for low in range(0, samples, _GROUP):
        group = range(low, min(samples, low + _GROUP))
        for j, sample in enumerate(group):
            r, beta, log_c = (x[owner] for x in _draws(distinct, sample))
            t = np.floor(log_weight / r + beta)
            value = (log_c - r * (t - beta + 1)).view(np.uint64)
            value ^= np.where(value >> np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63))  # sorts as the number
            keys[:, j] = value >> _PLACE << _PLACE
            levels[:, j] = t
        np.take(keys, entry, axis=0, out=mine, mode="clip")
        mine |= place
        least = (np.minimum.reduceat(mine, starts, axis=0) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        for j, sample in enumerate(group):
            won = entry[starts + least[:, j]]
            tag = mix(distinct[owner[won]] + levels[won, j].astype(np.int64).view(np.uint64) * np.uint64(_STEP) + np.uint64(sample))
            out[full, sample] = (tag >> np.uint64(48)).astype(np.uint16)
    return out, full


def likeness(a: np.ndarray, full_a: np.ndarray, b: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of fingerprints, row by row, freed of chance agreement."""
    same = ((a == b).mean(axis=1) - 2.0**-16) / (1 - 2.0**-16)
    return np.where(full_a & full_b, np.clip(same, 0, 1), (full_a == full_b).astype(float))


def texts_of(sketches: np.ndarray, full: np.ndarray) -> list[str]:
    raw = sketches.astype(">u2").tobytes()
    width = 2 * sketches.shape[1]
    return [raw[i * width: (i + 1) * width].hex() if has else "" for i, has in enumerate(full)]


def _encoded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def fingerprints(documents: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The ``keep`` columns and the fingerprint of every row."""
    carried = Carried(documents, keep, text, "fingerprint string")

    def work(batches):
        for batch in batches:
            data, offsets = utf8(carried.text_of(batch))
            out: list[str] = []
            for a, b in slices(offsets, SLICE):
                out += texts_of(*sketch(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], samples))
            yield carried.batch(batch, [pa.array(out, pa.string())])

    return carried.apply(work)


def in_order(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, guest, doc_id, text), sorted by doc_id and text within each part, the guest last: the first row of
    the next part, or of all rows after the last. Ids are a whole number; rows without one come first.

    Parts are ranges between quantiles of the ids; only these quantiles reach the driver.
    """
    spark = documents.sparkSession
    table = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = table.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("q"),
                        F.min("doc_id").alias("least")).first()
    bounds = np.array(sorted(set(cuts.q or []) - {cuts.least}), np.int64)
    last = len(bounds)

    def deal(batches):
        guests: dict[int, tuple] = {}
        for batch in batches:
            ids, missing = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null()
            null = missing.to_numpy(zero_copy_only=False)
            part = np.where(null, 0, np.searchsorted(bounds, ids, "right"))
            first = np.flatnonzero(null | (ids == cuts.least) | np.isin(ids, bounds))
            for i in first.tolist():
                row = (not null[i], int(ids[i]), batch.column(1)[i].as_py())
                to = last if null[i] or ids[i] == cuts.least else int(part[i]) - 1
                guests[to] = min(guests.get(to, row), row)
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(np.zeros(len(part), bool)), *batch.columns],
                                  names=["part", "guest", "doc_id", "text"])
        if guests:
            rows = list(guests.items())
            yield pa.record_batch(
                [pa.array([to for to, _ in rows], pa.int64()), pa.array([True] * len(rows)),
                 pa.array([r[1] if r[0] else None for _, r in rows], pa.int64()),
                 pa.array([r[2] for _, r in rows], pa.string())], names=["part", "guest", "doc_id", "text"])

    return (
        table.mapInArrow(deal, "part long, guest boolean, doc_id long, text string")
        .repartition(parts // 4, "part").sortWithinPartitions("part", "guest", "doc_id", "text")
    )


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def against_edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Every text beside its edited text (the last quarter of its characters replaced by the first as many, or all, of
    the next text by id), with both fingerprints and their likeness, and the likeness to the next text."""
    from hashlib import sha256

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, whose next row is still to come; guests only serve as next rows."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        texts, edited = [r[3] for r in rows], []
        for i in own:
            quarter = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - quarter] + rows[i + 1][3][:quarter])
        marks, full = sketch(*_encoded(texts + edited), samples)
        at, next_, other = np.array(own, int), np.array(own, int) + 1, np.arange(len(texts), len(marks))
        prints = texts_of(marks, full)
        return pa.record_batch(
            [pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
             pa.array([sha256(x.encode()).hexdigest() for x in edited], pa.string()),
             pa.array([prints[i] for i in own], pa.string()), pa.array(prints[len(texts):], pa.string()),
             pa.array(likeness(marks[at], full[at], marks[other], full[other])),
             pa.array(likeness(marks[at], full[at], marks[next_], full[next_]))],
            names=[c.split()[0] for c in EDITED.split(", ")])

    def work(batches) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and rows[-1][1] and row[1] and rows[-1][0] == row[0]:
                    continue  # of several guests the first counts
                rows.append(row)
                size += len(row[3])
                if size > SLICE:
                    yield rows_of(rows)
                    rows, size = rows[-1:], len(row[3])
        if len(rows) > 1:
            yield rows_of(rows)

    return in_order(documents, doc_id, text).mapInArrow(work, EDITED)

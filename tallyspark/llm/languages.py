"""Language proportions of a text by expectation-maximisation over n-gram likelihoods.

A text is taken as a mixture: each of its byte trigrams was drawn from one of the learned languages. EM estimates the
proportions over all languages; then the 1, 2, .. leading languages are refitted alone, and the set with the best
penalised likelihood stays. More languages are tried as long as the likelihood of all together leaves room for the penalty
of one more. The leading language of the set is the prediction, its proportion the score. ``fit`` is how much likelier, in
logarithms per trigram, the text is under that mixture than with all trigrams equally likely: below 0 it is like none.

Trigrams are taken over lower-cased (A-Z) UTF-8 bytes, with all ASCII non-letters read as spaces, and fall into 65,536
bins. Training counts every trigram of every labelled row; what reaches the driver is one table of 65,536 numbers per
language.

Defined cases: null text or text without a letter gives ``und`` with score 0 and no proportions; letters but fewer than
three bytes give the language with the most training text and its share, and no fit; a language no row was labelled with is never
predicted; with no labelled row at all everything is ``und``. Rows are judged one by one, so that repeated rows get equal
results and null ids do not matter. Only the columns named are read: others may have any name. A kept column of a result's
name gives way to the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import Carried
from .texts import LOWER, slices, utf8

BINS = 1 << 16
SMOOTHING = 0.1  # added to every bin's count
PENALTY = 2.0  # times log(trigrams) that a further language must gain
ROUNDS = 12  # EM steps over all languages; a chosen set takes half as many
SLACK = 1.0  # by which EM over all languages may fall short of the best likelihood
UNKNOWN = "und"
RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>, fit double"

_fold = LOWER.copy()
_fold[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_ascii_letter = np.zeros(256, bool)
_ascii_letter[[b for b in range(128) if chr(b).isalpha()]] = True


@dataclass(frozen=True)
class Languages:
    """Learned languages: their names, shares of the training text, and log-probability of each bin (one row each)."""

    names: tuple[str, ...]
    shares: np.ndarray
    logs: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins of every text and their ranges."""
    counts = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(data) < 3:
        return np.empty(0, np.uint16), bounds
    folded = _fold[data].astype(np.uint32)
    keys = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    keys *= np.uint32(0x9E3779B1)
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x85EBCA77)
    bins = (keys >> np.uint32(16)).astype(np.uint16)
    whole = np.ones(len(bins), bool)
    ends = offsets[1:-1]
    for back in (1, 2):  # those that reach over into the next text
        cut = ends - back
        whole[cut[(cut >= 0) & (cut < len(bins))]] = False
    return bins[whole], bounds


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ascii_letter[data], dtype=np.int64)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Trigram counts of every row that has a text and a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                part, ends = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                bins, bounds = _grams(part, ends)
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                known = sorted(set(names[a:b]))
                code = np.array([known.index(x) for x in names[a:b]])[owner]
                for k, name in enumerate(known):
                    if name not in sums:
                        sums[name] = np.zeros(BINS, np.int64)
                    sums[name] += np.bincount(bins[code == k], minlength=BINS)
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])],
                                  names=["lang", "bin", "n"])

    def pack(key, table):
        row = np.zeros(BINS, np.int64)
        row[table.column("bin").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([row.tobytes()], pa.binary())})

    rows = (
        documents.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, bin long, n long")
        .groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        .groupBy("lang").applyInArrow(pack, "lang string, counts binary")
        .collect()
    )
    rows = sorted(rows, key=lambda r: r.lang)
    if not rows:
        return Languages((), np.empty(0), np.empty((0, BINS), np.float32))
    counts = np.stack([np.frombuffer(r.counts, np.int64) for r in rows]).astype(float)
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS))
    return Languages(tuple(r.lang for r in rows), counts.sum(axis=1) / max(1.0, counts.sum()), logs.astype(np.float32))


def _unique(bins: np.ndarray, bounds: np.ndarray):
    """Distinct bins of each text, how often each occurs, and the ranges of texts."""
    for a, b in zip(bounds[:-1], bounds[1:]):
        bins[a:b].sort(kind="stable")
    new = np.empty(len(bins), bool)
    new[:1], new[1:] = True, bins[1:] != bins[:-1]
    new[bounds[:-1][bounds[:-1] < len(bins)]] = True
    at = np.flatnonzero(new)
    return bins[at], np.diff(np.append(at, len(bins))), np.searchsorted(at, bounds)


def _mixtures(likelihood, times, starts, sizes, start, rounds):
    """EM from given proportions (texts x languages); texts of no trigram must be left out. Also the log-likelihood."""
    shares, owner = start, np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(times, starts)[:, None]
    for step in range(rounds + 1):
        parts = shares[owner] * likelihood
        whole = np.maximum(parts.sum(axis=1), 1e-30)
        if step == rounds:
            return shares, np.add.reduceat(times * np.log(whole), starts)
        shares = np.add.reduceat(parts * (times / whole)[:, None], starts, axis=0) / total
    raise AssertionError


def proportions(data: np.ndarray, offsets: np.ndarray, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages (texts x languages, 0 for the others), and the fit, NaN without a trigram."""
    bins, bounds = _grams(data, offsets)
    values, times, ranges = _unique(bins, bounds)
    full = np.diff(ranges) > 0
    out, fit = np.zeros((len(offsets) - 1, len(model.names))), np.full(len(offsets) - 1, np.nan)
    if not full.any():
        return out, fit
    starts, sizes = ranges[:-1][full], np.diff(ranges)[full]
    logs = model.logs[:, values].T
    peak = logs.max(axis=1, keepdims=True)
    likelihood, times = np.exp(logs - peak), times.astype(np.float32)
    n, k = likelihood.shape[1], len(starts)
    shares, most = _mixtures(likelihood, times, starts, sizes, np.full((k, n), 1 / n, np.float32), ROUNDS)
    order = np.argsort(-shares, axis=1, kind="stable")
    total = np.add.reduceat(times.astype(np.float64), starts)
    price = PENALTY * np.log(total + 1)
    best, of_best, chosen, open_ = np.full(k, -np.inf), np.zeros(k), np.zeros((k, n)), np.ones(k, bool)
    for size in range(1, n + 1):
        rows, entries = np.flatnonzero(open_), np.repeat(open_, sizes)
        kept = np.zeros((len(rows), n), np.float32)
        np.put_along_axis(kept, order[rows, :size], 1, axis=1)
        first = kept * np.maximum(shares[rows], 1e-3)
        first /= first.sum(axis=1, keepdims=True)
        mine = sizes[rows]
        fitted, log = _mixtures(likelihood[entries], times[entries], np.cumsum(mine) - mine, mine, first, ROUNDS // 2 if size > 1 else 0)
        gain = log - price[rows] * (size - 1)
        better = gain > best[rows]
        at = rows[better]
        best[at], of_best[at], chosen[at] = gain[better], log[better], fitted[better]
        open_ = most + SLACK - price * size > best  # no set of more languages can gain more than all of them
        if not open_.any():
            break
    out[full] = chosen
    fit[full] = (of_best + np.add.reduceat(times * peak[:, 0].astype(np.float64), starts)) / total + np.log(BINS)
    return out, fit


def infer(documents: DataFrame, model: Languages, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with lang_pred, score, the chosen languages with their proportions, and the fit."""
    names = model.names
    carried = Carried(documents, keep, text, RESULT)

    def predict(batches):
        for batch in batches:
            data, offsets = utf8(carried.text_of(batch))
            for a, b in slices(offsets):
                predicted, scores, sets, parts = [], [], [], []
                piece, ends = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                letters = _has_letter(piece, ends)
                found, fit = proportions(piece, ends, model) if names else (None, np.full(b - a, np.nan))
                for i in range(b - a):
                    share = None
                    if names and letters[i]:
                        share = found[i] if fit[i] == fit[i] else np.where(model.shares == model.shares.max(), model.shares, 0)
                    if share is None:
                        predicted.append(UNKNOWN), scores.append(0.0), sets.append([]), parts.append([])
                        continue
                    at = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
                    predicted.append(names[at[0]])
                    scores.append(min(1.0, float(share[at[0]])))
                    sets.append([names[k] for k in at])
                    parts.append([float(share[k]) for k in at])
                yield carried.batch(batch.slice(a, b - a), [
                    pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())),
                    pa.array(parts, pa.list_(pa.float64())), pa.array(fit, pa.float64(), mask=~letters | np.isnan(fit))])

    return carried.apply(predict)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def identify(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    learn = documents.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out())
    return infer(documents, fit(learn), keep)

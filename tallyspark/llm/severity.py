"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

Grades are 0 (not toxic), 1 (toxic) and 2 (toxic and of low quality), from the 0/1 labels; any whole numbers will do.
With x the features present in a text and one weight vector w for all thresholds,

    P(grade >= k) = sigmoid(w . x - t_k),  t_1 < t_2 < ..

Features are words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) and their beginnings of 4, 5 and 6
bytes, which inflected forms share, as 32-bit hashes. Of the sample's features those enter the fit that occur in at least
LEAST texts and whose share among texts above the lowest grade differs clearly (SCREEN standard errors).

The expected severity is the sum of these probabilities. Weights are fitted by accelerated proximal gradient steps with an L1 penalty,
so that most words have weight 0; thresholds keep their order by steps of positive size.

Fitting takes a sample of at most SAMPLE labelled rows, the least by hash of the id; that bound is a parameter. The
whole texts of these rows are read, and the whole of every text that is scored. Features are counted and screened in Spark, so
that of long texts as well only the few features of the fit reach the driver.

Defined cases: several labels for one id count as the highest grade; labels that are null, or of ids that are null or not
among the documents, are not used; null and wordless texts have no features; with fewer than two grades in the sample
all severities are the only grade's (0 without labels). Rows are scored one by one, whole, however long. Only the columns named are
read; a kept column of a result's name gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import Carried, written
from .texts import LOWER, slices, span_hashes, utf8, word_spans

BEGINNINGS = (4, 5, 6)
LEAST, SCREEN = 3, 4.0
_FILTER = 22  # bits of a hash looked up before the hash itself
_inside = np.zeros(256, bool)
_inside[128:] = _inside[ord("0"): ord("9") + 1] = _inside[ord("a"): ord("z") + 1] = True
SAMPLE = 16_384
PENALTY = 1e-4
RESULT = "expected_severity double, severity_grade int, p_toxic double"
STEPS = 600


@dataclass(frozen=True)
class Severity:
    """Ascending feature hashes with their weights, the thresholds, and the lowest grade."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    least: int


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words and each kind of beginning: hashes and the text each stands in."""
    data = LOWER[data]
    begin, end, bounds = word_spans(data, offsets, _inside)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    yield (span_hashes(data, begin, end) >> np.uint64(32)).astype(np.uint32), owner
    for k in BEGINNINGS:
        long = end - begin > k
        hashes = span_hashes(data, begin[long], begin[long] + k) ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        yield (hashes >> np.uint64(32)).astype(np.uint32), owner[long]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(rows: Sequence[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Severity:
    """Weights and thresholds for distinct features per row and a grade each."""
    none = np.empty(0, np.uint32)
    kinds = np.arange(grades.min(), grades.max() + 1) if len(grades) else np.zeros(1, int)
    if len(kinds) < 2:
        return Severity(none, np.empty(0), np.empty(0), int(kinds[0]))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bins, column = np.unique(np.concatenate([*rows, none]), return_inverse=True)
    high = grades > kinds[0]
    n_high, n_low = max(1, high.sum()), max(1, (~high).sum())
    in_high = np.bincount(column, high[owner], len(bins))
    in_all = np.bincount(column, minlength=len(bins))
    share = in_all / len(rows)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_high + 1 / n_low))
    screened = (in_all >= LEAST) & (np.abs(in_high / n_high - (in_all - in_high) / n_low) >= SCREEN * error)
    entry = screened[column]
    owner, bins, column = owner[entry], bins[screened], (np.cumsum(screened) - 1)[column[entry]]
    n = len(rows)
    y = grades - kinds[0]
    above = np.array([(y >= k).mean() for k in range(1, len(kinds))])
    thresholds = -np.log(np.clip(above, 1e-4, 1 - 1e-4) / (1 - np.clip(above, 1e-4, 1 - 1e-4)))
    thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(len(thresholds)))
    # The loss curves by at most 1/2 in a score, so by 1/2 of its row's features in each of them: a safe step for each.
    nearby = np.bincount(column, np.bincount(owner, minlength=n)[owner].astype(float), len(bins))
    rate, rate_t = 2 * n / np.maximum(nearby, 1), 0.5 / np.maximum(above * (1 - above), 1e-3)
    w = ahead = np.zeros(len(bins))
    pace = 1.0
    for _ in range(steps):
        score = np.bincount(owner, ahead[column], n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        a = np.where(y > 0, _sigmoid(score - np.where(y > 0, edges[y], 0)), 1.0)
        top = y + 1 == len(kinds)
        b = np.where(top, 0.0, _sigmoid(score - np.where(top, 0, edges[y + 1])))
        of_grade = np.maximum(a - b, 1e-9)
        slope = np.bincount(column, ((a + b - 1) / n)[owner], len(bins))
        slope_t = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, a * (1 - a) / of_grade, 0), len(thresholds))
        slope_t -= np.bincount(np.minimum(y, len(thresholds) - 1), np.where(top, 0, b * (1 - b) / of_grade), len(thresholds))
        last, stepped = w, ahead - rate * slope
        w = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * penalty, 0)
        last_pace, pace = pace, (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = w + (last_pace - 1) / pace * (w - last)
        thresholds = thresholds - np.clip(rate_t * slope_t / n, -0.5, 0.5)
        thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(len(thresholds)))
    return Severity(bins[w != 0], w[w != 0], thresholds, int(kinds[0]))


def _screened(rows: DataFrame) -> np.ndarray:
    """Ascending features that the fit will use, counted and screened in Spark: only they reach the driver."""
    sizes = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return np.empty(0, np.uint32)
    n, low = sum(sizes.values()), min(sizes)
    n_low, n_high = sizes[low], n - sizes[low]

    def count(batches):
        for batch in batches:
            high = np.array(batch.column(0).to_pylist()) > low
            found = [np.frombuffer(b, np.uint32) for b in batch.column(1).to_pylist()]
            owner = np.repeat(high, [len(x) for x in found])
            values, place = np.unique(np.concatenate([*found, np.empty(0, np.uint32)]), return_inverse=True)
            yield pa.record_batch([pa.array(values.astype(np.int64)), pa.array(np.bincount(place, minlength=len(values)), pa.int64()),
                                   pa.array(np.bincount(place, owner, len(values)).astype(np.int64))], names=["feature", "n", "high"])

    counted = rows.mapInArrow(count, "feature long, n long, high long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("high").alias("high"))
    share = F.col("n") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_high + 1 / n_low))
    apart = F.abs(F.col("high") / n_high - (F.col("n") - F.col("high")) / n_low) >= SCREEN * error * (1 - 1e-9)
    used = counted.where((F.col("n") >= LEAST) & apart).select("feature").collect()
    return np.sort(np.array([r.feature for r in used], np.int64)).astype(np.uint32)


def fit(documents: DataFrame, labels: DataFrame, grade: Column, doc_id: str = "doc_id", text: str = "text",
        label_id: str = "doc_id", sample: int = SAMPLE) -> Severity:
    graded = labels.select(F.col(label_id).cast("long").alias("id"), grade.cast("int").alias("grade"))
    graded = graded.where("id is not null and grade is not null").groupBy("id").agg(F.max("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most ``sample`` pairs of numbers: may be broadcast
    own = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def features(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                found = [h for h, _ in _features(data[offsets[i]: offsets[i + 1]], offsets[i: i + 2] - offsets[i])]
                rows.append(np.unique(np.concatenate(found)).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["grade", "found"])

    rows = written(own.join(F.broadcast(chosen), "id").select("grade", "text").mapInArrow(features, "grade int, found binary"), "features")
    used = _screened(rows)

    def only_used(batches):
        for batch in batches:
            kept = []
            for body in batch.column(1).to_pylist():
                found = np.frombuffer(body, np.uint32)
                kept.append(found[np.isin(found, used)].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary())], names=["grade", "found"])

    rows = sorted((r.grade, bytes(r.found)) for r in rows.mapInArrow(only_used, "grade int, found binary").collect())
    return fit_rows([np.frombuffer(b, np.uint32) for _, b in rows], np.array([g for g, _ in rows], int))


def predict(documents: DataFrame, model: Severity, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with expected_severity, severity_grade (the likeliest) and p_toxic, P(grade > lowest)."""
    carried = Carried(documents, keep, text, RESULT)
    used, weight, thresholds, least = model.features, model.weights, model.thresholds, model.least

    def work(batches):
        maybe = np.zeros(1 << _FILTER, bool)
        maybe[used >> np.uint32(32 - _FILTER)] = True
        for batch in batches:
            data, offsets = utf8(carried.text_of(batch))
            scores = np.zeros(batch.num_rows)
            for a, b in slices(offsets) if len(used) else ():
                pairs = []
                for hashes, owner in _features(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]):
                    near = maybe[hashes >> np.uint32(32 - _FILTER)]
                    hashes, owner = hashes[near], owner[near]
                    at = np.minimum(np.searchsorted(used, hashes), len(used) - 1)
                    pairs.append((owner * len(used) + at)[used[at] == hashes])
                pairs = np.unique(np.concatenate(pairs))
                scores[a:b] = np.bincount(pairs // len(used), weight[pairs % len(used)], b - a)
            above = _sigmoid(scores[:, None] - thresholds[None, :])
            edges = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
            likeliest = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
            first = above[:, 0] if above.shape[1] else np.zeros(len(scores))
            yield carried.batch(batch, [pa.array(least + above.sum(axis=1), pa.float64()),
                                        pa.array((least + likeliest).astype(np.int32)), pa.array(first, pa.float64())])

    return carried.apply(work)


def from_labels(toxic: str = "toxic", quality: str = "quality") -> Column:
    """0 for not toxic, 1 for toxic, 2 for toxic and of low quality; null where toxic is."""
    return F.when(F.col(toxic) == 0, 0).when(F.col(toxic) == 1, F.when(F.col(quality) == 0, 2).otherwise(1))

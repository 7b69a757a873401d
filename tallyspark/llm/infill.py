"""Fill-in-the-middle texts, cut at token boundaries that a Roaring-style set of offsets gives by rank.

A text falls into n tokens (white space with the word behind it; white space at the end is a token of its own). Two of
the n + 1 places between tokens are drawn from a hash of the id: the text before the smaller is the prefix, up to the
larger the middle, the rest the suffix. The parts are written as prefix, suffix, middle behind marks (psm), as suffix,
prefix, middle (spm), or the text stays as it is (plain).

The offsets at which tokens end are a ``Boundaries`` set: offsets of one high part (their bits from 16 on) share a
container, which is an array of low parts, a bitmap, or runs, whichever is smallest. Cumulative cardinalities of the
containers find the one that holds a rank, and a select inside it gives the offset. A slice of texts has one set.

Defined cases: a null text is empty, an empty text has no tokens and is plain, as is a text that holds a mark itself; a
null id is hashed as the empty text; repeated rows get equal results, as long as their ids are equal. Texts are cut as
bytes at ends of tokens, so that no character is ever divided. Kept columns may have any name but those of the results,
which win.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import Carried
from .texts import NOT_SPACE, slices, utf8, word_spans

SEED = 42
PERCENT, SPM_PERCENT = 50, 80  # of texts that are cut; of these, with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ARRAY_MOST = 4096  # low parts; beyond, a bitmap is smaller
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class _Array:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: np.ndarray) -> np.ndarray:
        return self.low[rank].astype(np.int64)


class _Runs:
    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts.astype(np.int64), np.cumsum(lengths) - lengths

    def select(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, rank, "right") - 1
        return self.starts[run] + rank - self.before[run]


class _Bitmap:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def select(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, rank, "right") - 1
        seen = np.cumsum(np.unpackbits(self.words[word], axis=1, bitorder="little"), axis=1, dtype=np.int64)
        return 64 * word + (seen <= (rank - self.before[word])[:, None]).sum(axis=1)


class Boundaries:
    """A set of distinct offsets, given in ascending order, that answers which one is the r-th."""

    def __init__(self, offsets: np.ndarray):
        high, low = offsets >> 16, offsets & 0xFFFF
        begin = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[begin]
        self.before = np.append(begin, len(offsets))  # cumulative cardinalities
        self.containers = [self._container(low[a:b]) for a, b in zip(self.before[:-1], self.before[1:])]

    @staticmethod
    def _container(low: np.ndarray) -> _Array | _Runs | _Bitmap:
        """By size in bytes: 2 an offset, 8192, or 4 a run."""
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(starts) < min(2 * len(low), 8192):
            return _Runs(low[starts], np.diff(np.append(starts, len(low))))
        return _Array(low) if len(low) <= _ARRAY_MOST else _Bitmap(low)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets of the given ranks, which count from 0 and may come in any order."""
        at = np.searchsorted(self.before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.flatnonzero(np.diff(at[order], append=-1)) + 1
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            mine, k = order[a:b], int(at[order[a]])
            out[mine] = (self.keys[k] << 16) + self.containers[k].select(ranks[mine] - self.before[k])
        return out


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets behind every token of the texts, and the range of tokens of each text."""
    _, ends, _ = word_spans(data, offsets)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    last = offsets[1:][filled]
    ends = np.sort(np.concatenate([ends, last[~NOT_SPACE[data[last - 1]]]]))
    # An end lies behind its token, so a text's ends are those above where it begins.
    return ends, np.searchsorted(ends, offsets, "right")


def cut_points(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of every text, and where its prefix and its middle end; draws are two numbers a text."""
    ends, bounds = token_ends(data, offsets)
    n, begin = np.diff(bounds), bounds[:-1]
    units = np.sort(draws % (n[:, None] + 1), axis=1)
    cuts = np.repeat(offsets[:-1, None], 2, axis=1)
    some = units > 0
    cuts[some] = Boundaries(ends).select((begin[:, None] + units - 1)[some])
    return n, cuts[:, 0], cuts[:, 1]


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def draws(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Four numbers of 32 bits from the hash of the seed and the id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transformed(
    documents: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
    percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The ``keep`` columns with the number of tokens, the form, the lengths of prefix and middle in characters (null if
    plain), and the output text."""
    carried = Carried(documents, keep, text, RESULT, _draws=draws(doc_id, seed))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rows_of(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray):
        n, first, second = cut_points(data, offsets, drawn[:, :2])
        raw, edges = data.tobytes(), offsets.tolist()
        cut = (drawn[:, 2] % 100 < percent).tolist()
        spm = (drawn[:, 3] % 100 < spm_percent).tolist()
        form, before, middle, out = [], [], [], []
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            text = raw[a:b]
            if not cut[i] or not text or any(m in text for m in marks):
                form.append("plain"), before.append(None), middle.append(None), out.append(text)
                continue
            p, q = int(first[i]), int(second[i])
            head, tail = marks[0] + raw[a:p], marks[1] + raw[q:b]
            form.append("spm" if spm[i] else "psm")
            before.append(_characters(data[a:p])), middle.append(_characters(data[p:q]))
            out.append((tail + head if spm[i] else head + tail) + marks[2] + raw[p:q])
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(out, pa.string())]

    def work(batches):
        for batch in batches:
            data, offsets = utf8(carried.text_of(batch))
            drawn = batch.column("_draws").flatten().to_numpy().reshape(-1, 4)
            for a, b in slices(offsets):
                yield carried.batch(batch.slice(a, b - a), rows_of(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], drawn[a:b]))

    return carried.apply(work)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of. Parts hold no mark, so each mark's first place is its own."""
    def parts(first: str, second: str):
        rest = output.substr(F.lit(len(first) + 1), F.length(output))
        head = F.substring_index(rest, second, 1)
        rest = rest.substr(F.length(head) + len(second) + 1, F.length(rest))
        other = F.substring_index(rest, MIDDLE, 1)
        return head, other, rest.substr(F.length(other) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_2, prefix_2, middle_2 = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
    )

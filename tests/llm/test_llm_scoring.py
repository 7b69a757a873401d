import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import words
from tallyspark.llm import languages, scoring
from tallyspark.llm.trie import ABSENT, Ascending, Trie, quantised, unquantised


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 5), (5, 9), (1000, 1200), (1000, 10**15), (3000, 2**40)])
def test_ascending_numbers(n, top):
    rng = np.random.default_rng(n + 1)
    values = np.unique(rng.integers(0, top + 1, n).astype(np.uint64))
    coded, _ = Ascending.read(Ascending.coded(values), 0)
    asked = np.concatenate([values, rng.integers(0, 2 * top + 2, 1000).astype(np.uint64)])
    place = {int(x): k for k, x in enumerate(values)}
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    assert coded.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_trie_in_a_mapped_file(tmp_path):
    rng, pseudo = np.random.default_rng(2), (50.0, 5.0)
    triples = Counter(map(tuple, rng.integers(0, 30, (4000, 3)).tolist()))
    pairs, first = Counter(), Counter()
    for (u, v, _), n in triples.items():
        pairs[u, v] += n
        first[u] += n
    order = sorted(pairs)
    at = {x: k for k, x in enumerate(order)}
    keys = sorted((at[u, v], w) for u, v, w in triples)
    raw = Trie.built(30, *(np.array(x) for x in zip(*order)), np.array([float(pairs[x]) for x in order]),
                     np.array([float(first[x[0]]) for x in order]), *(np.array(x) for x in zip(*keys)),
                     np.array([float(triples[(*order[p], w)]) for p, w in keys]), pseudo)
    (tmp_path / "trie").write_bytes(raw)
    trie = Trie(np.memmap(tmp_path / "trie", mode="r"))
    asked = rng.integers(0, 33, (3000, 3)).clip(max=29)
    u, v, w = asked.T
    place = trie.pair(u, v)
    part, backoff = trie.pair_codes(place)
    third = unquantised(trie.triple_codes(trie.triple(place, v, w)))
    for k, (a, b, c) in enumerate(asked.tolist()):
        n = pairs[a, b]
        assert (part[k] == ABSENT) == (n == 0)
        if n:
            assert unquantised(part)[k] == pytest.approx(n / (first[a] + 50), rel=1e-3)
            assert unquantised(backoff)[k] == pytest.approx(5 / (n + 5), rel=1e-3)
            assert third[k] == pytest.approx(triples[a, b, c] / (n + 5), rel=1e-3)
    assert (unquantised(quantised(np.array([1.0, 0.3, 1e-9]))) <= [1.0, 0.3, 1e-9]).all()


def brute(rows, learn, pseudo):
    toks = [[*words(t), None] for _, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for t, used in zip(toks, learn):
        if used:
            one.update(t), two.update(zip(t, t[1:])), three.update(zip(t, t[1:], t[2:]))
    n, v, out = sum(one.values()), len(one), []
    for t in toks:
        base = score = 0.0
        for k, w in enumerate(t):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if k and one[t[k - 1]]:
                p = (two[t[k - 1], w] + pseudo[0] * p) / (one[t[k - 1]] + pseudo[0])
            if k > 1 and two[t[k - 2], t[k - 1]]:
                p = (three[t[k - 2], t[k - 1], w] + pseudo[1] * p) / (two[t[k - 2], t[k - 1]] + pseudo[1])
            score += math.log10(p)
        out.append((len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def test_scores_equal_brute_force(table, texts):
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in texts]
    want = brute(texts, learn, scoring.PSEUDO)
    used = F.col("doc_id").isNotNull() & ~languages.held_out(part=1)
    got = scoring.Scorer(table(), used).scores().collect()
    assert len(got) == len(want)
    for r, (i, (n, known, total, base, score)) in zip(
            sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score)),
            sorted(zip([i for i, _ in texts], want), key=lambda x: (str(x[0]), x[1][0], x[1][3]))):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=2e-3, abs=0.002 * n)
    held = [k for k, (i, _) in enumerate(texts) if i is not None and not learn[k]]
    assert sum(want[k][4] for k in held) > sum(want[k][3] for k in held)


def test_probabilities_of_a_context_sum_to_one(table):
    """Scores of all continuations of a text, the end and one unknown word among them."""
    train = [(1, "a b a c a b b"), (2, "b a c c"), (3, "a a b")]
    ends = ["", " a", " b", " c", " unknown"]
    rows = train + [(10 + k, "a b" + e) for k, e in enumerate(ends)] + [(50, "a b")]
    got = {r.doc_id: r for r in scoring.Scorer(table(rows), F.col("doc_id") < 10).scores().collect()}
    brute_scores = dict(zip([i for i, _ in rows], brute(rows, [i < 10 for i, _ in rows], scoring.PSEUDO)))
    one = Counter(w for _, t in train for w in [*words(t), None])

    def after(context, w):
        n, v = sum(one.values()), len(one)
        two = Counter(x for _, t in train for x in zip([*words(t), None], [*words(t), None][1:]))
        three = Counter(x for _, t in train for x in zip([*words(t), None], [*words(t), None][1:], [*words(t), None][2:]))
        p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
        p = (two[context[1], w] + scoring.PSEUDO[0] * p) / (one[context[1]] + scoring.PSEUDO[0])
        return (three[(*context, w)] + scoring.PSEUDO[1] * p) / (two[context] + scoring.PSEUDO[1])

    assert sum(after((b"a", b"b"), w) for w in (*one, "unknown")) == pytest.approx(1)
    assert all(got[k].score == pytest.approx(brute_scores[k][4], rel=2e-3) for k in got)


def test_small_tables(table):
    none = scoring.Scorer(table([(1, "a b"), (2, None)]), F.lit(False)).scores().collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
    assert scoring.Scorer(table([]), F.lit(True)).scores().count() == 0
    model = scoring.Scorer(table([(1, "a b c a b")]), F.lit(True)).model().collect()
    assert sum(Trie(r.trie).pairs.count for r in model) == 4

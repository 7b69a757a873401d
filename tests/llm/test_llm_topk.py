import math

import numpy as np
import pytest

from tallyspark.llm import topk

BAD = [(10_001, None), (10_002, [1.0, None, 0.0]), (10_003, [math.nan, 0.0, 0.0]), (10_004, [math.inf, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]


def brute(rows, every, k=5):
    good = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {r for r in good if r[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture
def vectors(spark):
    def make(rows, kind="double"):
        full = [(i, v, "?", 0) for i, v in rows]
        return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, score string, `rank` int").repartition(3)

    return make


def asked(table, every=7, **options):
    return sorted(tuple(r) for r in topk.top(table, table.where(f"vec_id % {every} = 0"), **options).collect())


def test_same_as_brute_force(vectors, monkeypatch):
    pick = np.random.default_rng(4)
    rows = [(k, pick.normal(0, 0.3, 3).tolist()) for k in range(300)]
    rows += [(k, [0.5, -0.25, 1.0]) for k in range(300, 420)]  # ties
    rows += [(k, [float(x) for x in pick.integers(-9, 9, 5)]) for k in range(420, 440)]
    rows += [(1000, []), (1001, []), (1008, []), (1015, [1e4, -1e5, 3e6]), (1022, [0.0, 0.0, 0.0])]
    rows += [(1029, [0.1, 0.2, 0.3])] * 3 + [(1029, [0.4, 0.1, 0.1])] + [(2001, [7.0])] + BAD
    monkeypatch.setattr(topk, "BLOCK_VALUES", 300)
    monkeypatch.setattr(topk, "QUERY_VALUES", 50)
    monkeypatch.setattr(topk, "MERGE", 2)
    assert asked(vectors(rows)) == brute(rows, 7)
    assert asked(vectors(rows), k=1000) == brute(rows, 7, 1000)
    assert asked(vectors(rows), k=1) == brute(rows, 7, 1)


def test_too_long_to_score(vectors):
    rows = [(7, [1.0, 2.0]), (8, [1e30, 0.0]), (9, [3.0, 1.0])]
    assert asked(vectors(rows)) == [(7, 1, 9, 256 * 256 * 5)]


def test_empty_tables(vectors):
    none = vectors([], "float")
    assert asked(none) == []
    some = vectors([(1, [1.0])], "float")
    assert asked(some) == [] and topk.top(none, vectors([(7, [1.0])], "float")).count() == 0


@pytest.mark.parametrize("spread, dims", [(200, 64), (5, 40), (30_000, 7), (0, 4)])
def test_a_block_finds_the_first_rows(spread, dims):
    pick = np.random.default_rng(spread)
    vectors = pick.integers(-spread, spread + 1, (1000, dims)).astype(np.int32)
    vectors[100:400] = vectors[100]  # a third are equal
    ids = np.sort(pick.choice(10_000, 1000, replace=False))
    least, bits, slices = topk.Block.sliced(vectors)
    block = topk.Block(ids, vectors, least, bits, slices)
    for at in [*range(0, 1000, 50), 100, 399]:
        scores = vectors.astype(np.int64) @ vectors[at].astype(np.int64)
        rest = ids != ids[at]
        want = np.lexsort((ids[rest], -scores[rest]))[:9]
        got, score = block.search(int(ids[at]), vectors[at], 9)
        assert (got == ids[rest][want]).all() and (score == scores[rest][want]).all()


def test_few_rows_are_scored_exactly():
    """Slices alone rule out nearly all rows."""
    pick = np.random.default_rng(9)
    vectors = np.floor(256 * pick.normal(0, 0.125, (8000, 64))).astype(np.int32)
    block = topk.Block(np.arange(8000), vectors, *topk.Block.sliced(vectors))
    seen = []
    scored = block.vectors

    class Counted:
        def __getitem__(self, rows):
            seen.append(len(rows))
            return scored[rows]

    block.vectors = Counted()
    for at in range(0, 8000, 400):
        block.search(at, scored[at], 5)
    assert np.mean(seen) < 200

import random

import numpy as np

from brute import components, shingles
from tallyspark.llm import nearcopies
from tallyspark.llm.components import components as connected


def near_rows():
    """Groups of edited copies, and pairs just at and just below 0.75."""
    pick, rows = random.Random(5), []
    for g in range(6):
        base = [f"w{g}x{k}" for k in range(120)]
        for c in range(25):
            copy = list(base)
            for _ in range(pick.randrange(0, 9)):
                copy[pick.randrange(len(copy))] = f"n{pick.random()}"
            rows.append((20_000 + 1000 * g + c, " ".join(copy)))
    seven = [f"s{k}" for k in range(11)]  # 7 runs; one word less at the end: 6 of 7; replaced last word: 6 of 8 = 0.75
    rows += [(8001, " ".join(seven)), (8002, " ".join([*seven[:-1], "other"])), (8003, " ".join([*seven[:-2], "an", "other"]))]
    return rows


def test_same_components_as_brute_force(spark, table, texts):
    rows = texts + near_rows()
    want = components(rows)
    got = nearcopies.near_copies(table(rows)).collect()
    assert len(got) == len(rows)
    size = {i: len(shingles(t)) for i, t in rows}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)
    assert want[8002] == 8001 and len(set(want.values())) < len(want) - 60


def test_empty_table(table):
    assert nearcopies.near_copies(table([])).count() == 0


def test_components_of_a_long_path(spark, table):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in connected(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for both in (0, 1000, 2000, 3000):
        a, b = np.unique(pool[:3000]), np.unique(pool[3000 - both: 6000 - both][:1000 + both])
        marks = nearcopies.registers([a, b, np.union1d(a, b)])
        assert (nearcopies.merged(marks[0], marks[1]) == marks[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = nearcopies.estimate(marks[:1], marks[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(found - true) < 0.12

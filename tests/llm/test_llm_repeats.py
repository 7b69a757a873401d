import hashlib
import random

import numpy as np

from brute import removed
from tallyspark.llm import repeats


def passages():
    pick = random.Random(9)
    letters = "abcdefgh "
    text = lambda n: "".join(pick.choice(letters) for _ in range(n))
    common, line = text(260), text(45)
    rows = [(5000 + k, text(pick.randrange(150)) + common[pick.randrange(60): 260 - pick.randrange(60)] + text(pick.randrange(150))) for k in range(40)]
    rows += [(6000 + k, (line + text(70)) * 2 + line) for k in range(30)]  # one beginning, many continuations
    rows += [(7000, "z" * 350), (7001, "z" * 99), (7002, "z" * 100), (7003, "é" * 120), (7004, "yé" * 200)]
    long = text(2_300_000)
    rows += [(7100, long), (7101, text(300) + long[2_096_900: 2_097_500] + text(50))]
    same = text(220)
    return rows + [(7200, same), (7200, same), (7200, text(30) + same), (None, same), (7300, same)]


def test_same_as_brute_force(table, texts):
    rows = [(i, t) for i, t in texts if t is None or len(t) < 20_000] + [(900010, "ab " * 700), (900011, "ab " * 700)] + passages()
    want = []
    for (i, _), (body, gone) in zip(rows, removed(rows)):
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(x for x, y in zip(body, gone) if not y)
        want.append((str(i), len(body), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(table(rows)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(1 for r in want if r[2]) > 80


def test_kept_bytes(table):
    text = "".join(map(chr, range(33, 126))) * 3
    rows = {r.doc_id: r for r in repeats.remove(table([(1, text), (2, "x" + text)])).collect()}
    assert rows[2].kept == b"x" and rows[1].n_removed == 3 * 93 - 93


def test_empty_table(table):
    assert repeats.remove(table([])).count() == 0


def test_cover_and_shifts():
    differences = {(a - b) % repeats.V for a in repeats.COVER for b in repeats.COVER}
    assert differences == set(range(repeats.V))
    for a in range(repeats.V):
        for b in range(repeats.V):
            s = repeats._shift[a, b]
            assert (a + s) % repeats.V in repeats.COVER and (b + s) % repeats.V in repeats.COVER


def test_earliest_equal_prefix():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 2, 400).astype(np.uint8)
    data = np.concatenate([block, rng.integers(0, 2, 77).astype(np.uint8), block, block[50:300]])
    at = np.arange(len(data) - repeats.LENGTH + 1)
    first, want = {}, []
    for k in at.tolist():
        want.append(first.setdefault(data[k: k + repeats.LENGTH].tobytes(), k))
    assert repeats.earliest(data, at).tolist() == want

import hashlib
from collections import Counter

import numpy as np

from brute import words
from tallyspark.llm import weighted


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    top = sum(max(a[x], b[x]) for x in {*a, *b})
    return sum(min(a[x], b[x]) for x in {*a, *b}) / top if top else 1.0


def test_edits_and_likeness(spark, table, texts):
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(weighted.against_edits(table()).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    assert len(got) == len(rows)
    want, errors = {}, []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(),
                                       jaccard(words(t), words(edited)), jaccard(words(t), words(following))))
    for i in want:
        mine = sorted([r for r in got if r.doc_id == i], key=lambda r: (r.n_chars, r.edited_sha256))
        for r, (n, digest, edited, following) in zip(mine, sorted(want[i])):
            assert (r.n_chars, r.edited_sha256) == (n, digest)
            errors.append((r.near_edited - edited, r.near_next - following))
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert (np.abs(np.mean(errors, axis=0)) < 0.02).all() and (np.std(errors, axis=0) < 0.08).all()


def test_equal_texts_have_equal_fingerprints(table, texts):
    rows = weighted.fingerprints(table(), ["doc_id", "text"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and by[""] == {""} and len(set.union(*by.values())) > 150


def test_fingerprints_do_not_depend_on_the_slice():
    """A text alone and beside many megabytes of other words."""
    pick = np.random.default_rng(5)
    other = " ".join(f"{a:x}" for a in pick.integers(0, 1 << 40, 200_000).tolist())
    few = [" ".join(str(x) for x in pick.integers(0, 9999, k).tolist()) for k in (1, 2, 2, 2, 3, 5, 9, 40, 200)] + ["3682 3729f"]
    many = [f"{a} {b}f" for a, b in pick.integers(0, 9999, (3000, 2)).tolist()]
    alone = [weighted.texts_of(*weighted.sketch(*weighted._encoded([t])))[0] for t in few + many[:300]]
    beside = weighted.texts_of(*weighted.sketch(*weighted._encoded([other, *few, *many])))[1:]
    assert alone == beside[: len(alone)]


def test_collisions_follow_weights():
    """Words that differ in weight only: the likeness is the sum of minima over the sum of maxima."""
    a = " ".join(f"w{k} " * 3 for k in range(50)) + " " + " ".join(f"v{k}" for k in range(50))
    b = " ".join(f"w{k}" for k in range(50)) + " " + " ".join(f"v{k} " * 2 for k in range(50))
    marks, full = weighted.sketch(*weighted._encoded([a, b]), samples=2000)
    assert abs(weighted.likeness(marks[:1], full[:1], marks[1:], full[1:])[0] - jaccard(a.split(), b.split())) < 0.04


def test_small_tables(table):
    assert weighted.against_edits(table([])).count() == 0
    one = weighted.against_edits(table([(3, "abcdefgh ij")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefgh ab"[:9] + b"ab").hexdigest()
    none = weighted.against_edits(table([(None, None), (None, "a b c d")])).collect()
    assert len(none) == 2

import re
from hashlib import sha256

import numpy as np
import pytest

from tallyspark.llm import infill
from tallyspark.llm.infill import Boundaries, _Array, _Bitmap, _Runs
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MORE = [
    (1, "a b"), (2, "ends in space \n"), (3, "holds <M> itself"), (4, "<P"), (5, "< P> <S <M"), (6, "äöü 中文 \U0001f600 x"),
    (7, "a" * 200_000 + " " + "b " * 70_000), (8, "x " * 300_000), (9, " " * 70_000), (None, "no id at all here"),
]


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    p, q = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b, c = ("".join(tokens[x:y]) for x, y in ((0, p), (p, q), (q, None)))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(tokens), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_same_as_brute_force_and_back(table, texts):
    rows = texts + MORE + [(70_000 + k, t) for k, (_, t) in enumerate(MORE * 6)]
    found = infill.transformed(table(rows), ("doc_id", "text", "form", "score"))
    assert found.columns == ["doc_id", "text", "score", *infill.RESULT.replace(" long", "").replace(" string", "").split(", ")]
    got = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == (r.text or "") and r.score == "?" for r in got)
    shown = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr)
    assert shown == sorted(((i, t, *brute(i, t)) for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_other_parameters(table, texts):
    always = infill.transformed(table(texts), percent=100, spm_percent=0, seed=7).collect()
    assert {r.form for r in always} == {"psm", "plain"}
    assert all(r.form == "psm" for r in always if r.output and r.n)


def test_empty_table(table):
    assert infill.transformed(table([])).count() == 0


@pytest.mark.parametrize("kind, offsets", [
    (_Array, np.arange(0, 60_000, 37)), (_Bitmap, np.flatnonzero(np.random.default_rng(1).random(65_536) < 0.4)),
    (_Runs, np.concatenate([np.arange(10, 9000), np.arange(9001, 20_000), [65_535]])),
])
def test_containers_select(kind, offsets):
    made = Boundaries(offsets)
    assert [type(c) for c in made.containers] == [kind]
    ranks = np.random.default_rng(2).permutation(len(offsets))
    assert (made.select(ranks) == offsets[ranks]).all()


def test_set_over_many_containers():
    pick = np.random.default_rng(3)
    offsets = np.unique(np.concatenate([
        pick.integers(0, 1 << 22, 20_000), np.arange(3 << 16, (3 << 16) + 65_536), np.arange(9 << 16, (9 << 16) + 65_536, 2),
        [(40 << 16) - 1, 40 << 16, 1 << 33]]))
    made = Boundaries(offsets)
    assert {type(c) for c in made.containers} == {_Array, _Bitmap, _Runs}
    assert len(made) == len(offsets) and (made.select(np.arange(len(offsets))[::-1]) == offsets[::-1]).all()
    assert len(Boundaries(offsets[:0])) == 0 and len(Boundaries(offsets[:0]).select(np.empty(0, np.int64))) == 0

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows, noise=199, least=6, times=5):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def one_edit(word, alphabet):
    for k in range(len(word) + 1):
        if k < len(word):
            yield word[:k] + word[k + 1:]
            yield from (word[:k] + c + word[k + 1:] for c in alphabet)
        yield from (word[:k] + c + word[k:] for c in alphabet)


def brute(words, ratio=5):
    alphabet = sorted(set("".join(words)))
    near = {w: {x for x in one_edit(w, alphabet) if x in words and x != w} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def rows_of(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def made(seed=1, size=3000):
    """Words over few letters, so that many are near, with counts that make chains of forms."""
    pick, words = random.Random(seed), {}
    while len(words) < size:
        word = "".join(pick.choice("abé") for _ in range(pick.randrange(6, 11)))
        words[word] = 5 ** pick.randrange(1, 7) + pick.randrange(3)
    base = "x" * 150
    for k in range(0, 150, 10):
        words[base[:k] + "y" + base[k:]] = 5
        words[base[:k] + "z" + base[k + 1:]] = 7
    words[base] = 100
    for k in range(26):
        words["haupt" + chr(97 + k)] = 6 + 40 * (k == 3)
    return words


@pytest.mark.parametrize("most", [5, 60, 2000])
def test_variants_are_those_of_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST", most)
    words = made(size=1500 if most == 5 else 3000)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = rows_of(spelling.variants(table))
    assert got == brute(words)
    assert sum(r[1] is not None and r[1] != r[2] for r in got) > 20  # chains


def test_vocabulary_counts_every_run(table, texts, monkeypatch):
    long = "Wörter und straße, " * 120_000
    rows = texts + [(1, "ABCDEFÀé abcdefÀé " * 9), (2, long), (None, "sechse " * 9), (3, "x" * 70 + " " + "y" * 5_000_000)] * 2
    for noise, monkey in ((199, 1 << 21), (3, 1 << 12)):
        monkeypatch.setattr(spelling, "_PIECE", monkey)
        got = {r.word: r.n for r in spelling.vocabulary(table(rows), noise=noise, times=2).collect()}
        assert got == brute_words(rows, noise, times=2)


def test_query_is_that_of_brute_force(table, texts):
    words = brute_words(texts)
    assert rows_of(spelling.variants(spelling.vocabulary(table(texts)))) == brute(words)


def test_empty_tables(table, spark):
    assert spelling.vocabulary(table([])).count() == 0
    assert spelling.variants(spelling.vocabulary(table([(1, None), (2, "")]))).count() == 0


def test_crcs():
    data = np.frombuffer(b"abc" * 100, np.uint8)
    begin, end = np.array([0, 5, 7, 9]), np.array([1, 5, 290, 30])
    before = np.array([zlib.crc32(b"1:"), 0, 7, zlib.crc32(b"xyz")], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(begin, end, before)]
    assert spelling.crcs(data, begin, end, before).tolist() == want


def test_states_are_shared():
    made = spelling.Acceptors()
    made.start(["aing", "aung", "bing", "bung"])
    assert len(made.final) == 5 and made.start(["cing", "cung"]) >= 5
    assert len(made.final) == 6  # only the start is new

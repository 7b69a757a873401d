import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyspark.llm import languages
from tallyspark.llm.texts import utf8

GERMAN = "der die das und nicht ein eine ist auf mit sich dem den von haben werden schön straße über "
FRENCH = "le la les des une est avec pour dans que nous vous être avoir très où déjà français "


@pytest.fixture(scope="module")
def model(spark, table):
    rows = spark.createDataFrame([(k, t * 20, l) for k, (t, l) in enumerate([(GERMAN, "de"), (FRENCH, "fr")] * 3)],
                                 "doc_id long, text string, lang string")
    return languages.fit(rows)


def test_held_out_accuracy(spark, table):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    found = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(languages.held_out())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_mixture_has_both_languages(spark, table, model):
    rows = languages.infer(table([(1, GERMAN * 9 + FRENCH * 3), (2, GERMAN * 9), (3, FRENCH)]), model).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].languages == ["de", "fr"] and 0.6 < by[1].score < 0.9 and sum(by[1].proportions) == pytest.approx(1)
    assert by[2].languages == ["de"] and by[2].score == 1 and by[3].lang_pred == "fr"


def test_defined_cases(table, texts, model):
    rows = languages.infer(table(), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900001, 900002, 900003, 900005))
    assert by[900004].lang_pred in ("de", "fr")  # a letter, but no trigram: the larger share of training


def test_empty_tables(table):
    nothing = languages.fit(table([]))
    assert nothing.names == () and languages.infer(table([]), nothing).count() == 0
    assert {r.lang_pred for r in languages.infer(table([(1, "some text")]), nothing).collect()} == {"und"}


def test_em_finds_known_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(200, 0.2), 2)
    times = rng.multinomial(20_000, 0.7 * p[0] + 0.3 * p[1]).astype(np.float32)
    shares, _ = languages._mixtures(p.T.astype(np.float32), times, np.array([0]), np.array([200]), np.full((1, 2), 0.5, np.float32), 40)
    assert shares[0] == pytest.approx([0.7, 0.3], abs=0.02)


@pytest.fixture(scope="module")
def four(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    by = {}
    for r in docs.where("text is not null and lang is not null").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    return languages.fit(docs), by


def plain_mixture(text, model):
    """The definition, text by text in plain Python: EM over all languages, then every number of leading languages."""
    raw = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalpha() else 32 for b in text.encode())
    counts = {}
    for k in range(len(raw) - 2):
        key = int.from_bytes(raw[k: k + 3]) * 0x9E3779B1 % 2**32
        key = (key ^ key >> 15) * 0x85EBCA77 % 2**32 >> 16
        counts[key] = counts.get(key, 0) + 1
    n, total = len(model.names), sum(counts.values())
    p = {key: [math.exp(model.logs[j][key]) for j in range(n)] for key in counts}

    def em(shares, rounds):
        for _ in range(rounds):
            new = [0.0] * n
            for key, c in counts.items():
                whole = sum(s * x for s, x in zip(shares, p[key]))
                for j in range(n):
                    new[j] += c * shares[j] * p[key][j] / whole
            shares = [x / total for x in new]
        return shares, sum(c * math.log(sum(s * x for s, x in zip(shares, p[key]))) for key, c in counts.items())

    every, _ = em([1 / n] * n, languages.ROUNDS)
    order = sorted(range(n), key=lambda j: -every[j])
    best = None
    for size in range(1, n + 1):
        first = [max(every[j], 1e-3) if j in order[:size] else 0.0 for j in range(n)]
        fitted, log = em([x / sum(first) for x in first], languages.ROUNDS // 2 if size > 1 else 0)
        gain = log - languages.PENALTY * math.log(total + 1) * (size - 1)
        if best is None or gain > best[0]:
            best = gain, fitted, log / total + math.log(languages.BINS)
    return best[1], best[2]


def test_same_as_plain_em(four):
    model, by = four
    parts = [t[:400] for lang in by for t in by[lang][:6]]
    mixed = [" ".join(by[lang][k][:300] for lang in chosen) for k, chosen in enumerate(
        [("de", "fr"), ("de", "en", "es"), ("de", "en", "es", "fr"), ("fr", "es"), ("es", "en")] * 3)]
    rows = [t for t in [*parts, *mixed, "kurz", "zxq qxz jjkq vvw", "1 2 3 4 a"] if len(t.encode()) > 2]
    data, offsets = utf8(pa.array(rows))
    shares, fit = languages.proportions(data, offsets, model)
    for text, share, f in zip(rows, shares, fit):
        want, want_fit = plain_mixture(text, model)
        assert share == pytest.approx(want, abs=0.01) and f == pytest.approx(want_fit, abs=0.01), text


def test_the_penalty_alone_bounds_the_languages(four, table):
    model, by = four
    even = {k: " ".join(max(by[lang], key=len)[:1500] for lang in chosen) for k, chosen in enumerate(
        [("de", "fr", "en"), ("de", "fr", "en", "es")])}
    got = {r.doc_id: r for r in languages.infer(table(list(even.items())), model).collect()}
    assert [len(got[k].languages) for k in even] == [3, 4] and min(got[1].proportions) > 0.15


def test_kept_columns_of_any_name(table, texts, model):
    found = languages.infer(table(), model, ("doc_id", "score", "_text", "text", "lang_pred", "words"))
    assert found.columns == ["doc_id", "_text", "text", "words", "lang_pred", "score", "languages", "proportions", "fit"]
    rows = found.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(texts, key=repr) and {r._text for r in rows} == {"?"}

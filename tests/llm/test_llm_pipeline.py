import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brute import components
from conftest import SF
from tallyspark.llm.tables import documents
from tallyspark.llm.tokens import VOCABULARY
from test_llm_decontaminate import brute as contaminated
from test_llm_packing import check


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def token_ids(text):
    return np.append(TOKENIZER.encode(text, add_special_tokens=False).ids, 1).astype("<u4")


@pytest.fixture(scope="module")
def stages(spark, table):
    """What each stage left."""
    docs, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
    return out


def test_stages_against_brute_force(spark, stages):
    given = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    left = {name: {r.doc_id: r.text for r in stages[name].collect()} for name in list(stages)[:-1]}
    assert all(stages[n].columns == list(corpus_pipeline.COLUMNS) for n in left)
    assert left["language"] == given  # every text of this table has a leading language
    groups = components(list(given.items()))
    assert set(left["near_copies"]) == {k for k in given if groups[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated(list(left["near_copies"].items()), items) if r[4]}
    assert hit and set(left["benchmark"]) == set(left["near_copies"]) - hit
    assert set(left["personal_data"]) == set(left["benchmark"])
    for k, text in left["personal_data"].items():
        before = given[k]
        luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10
        for found in re.findall(r"[\w.]+@mail\d+\.example\.com|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}", before):
            assert (found not in text) or (found.isdigit() and luhn(found))
    ids = {k: token_ids(t) for k, t in left["personal_data"].items()}
    assert check([tuple(r) for r in stages["packing"].collect()], ids) < 0.02


def test_run_equals_its_stages(spark, stages):
    """Every document of the stages is packed whole by the run, and no other."""
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    ids = {r.doc_id: token_ids(r.text) for r in stages["personal_data"].collect()}
    assert check(got, ids) < 0.02
    assert {r[0] for r in got} == set(ids) == {r.doc_id for r in stages["packing"].select("doc_id").collect()}


def test_texts_of_many_languages_stay(spark):
    """However many languages a text mixes, and however short it is; noise goes."""
    docs = documents(spark, SF)
    by = {}
    for r in docs.where("text is not null and length(text) > 3000 and lang is not null").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text)
    names = sorted(by)
    assert len(names) == 4
    noise = "".join(chr(97 + x) for x in np.random.default_rng(3).integers(0, 26, 3000))
    planted = [(800001, " ".join(by[x][:900] for x in names)), (800002, " ".join(by[x][:900] for x in names[:3])), (800003, "a"),
               (800004, "ok"), (800005, noise), (800006, by[names[0]][:40])]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in planted], docs.select(*corpus_pipeline.COLUMNS).schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.select(*corpus_pipeline.COLUMNS).unionByName(more), SF).collect()}
    assert kept & {i for i, _ in planted} == {800001, 800002, 800003, 800004, 800006}


def test_defined_cases(spark, table):
    """Null and wordless texts go at the language; other stages keep what they do not judge."""
    docs = table()
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert not kept & {900001, 900002, 900003, 900005}
    after = corpus_pipeline.near_copies(spark, docs, SF).collect()
    ids = [r.doc_id for r in after]
    assert {900001, 900002, 900007, 900010, 900012} <= set(ids) and not {900008, 900011, 900013} & set(ids) and ids.count(None) == 2
    assert corpus_pipeline.benchmark(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.personal_data(spark, docs, SF).count() == docs.count()
    for stage in corpus_pipeline.STAGES:
        assert stage[1](spark, table([]), SF).count() == 0

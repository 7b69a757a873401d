import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallyspark.llm import severity
from tallyspark.llm.texts import utf8


def test_grades_of_planted_words(spark, table):
    """Three grades: the more and the worse the words, the higher. Held-out rows get their grade's order."""
    pick, rows = random.Random(3), []
    for k in range(1500):
        grade = pick.choice((0, 0, 0, 1, 2))
        words = [f"plain{pick.randrange(3000)}" for _ in range(60)]
        words += {0: [], 1: pick.choices(["daft", "silly"], k=2), 2: pick.choices(["vile", "foul"], k=3)}[grade]
        pick.shuffle(words)
        rows.append((k, " ".join(words), grade))
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = severity.fit(frame, frame.where("doc_id % 2 = 0"), F.col("grade"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {r.doc_id: r for r in severity.predict(frame, model).collect()}
    odd = [(g, got[k]) for k, _, g in rows if k % 2]
    assert np.mean([r.severity_grade == g for g, r in odd]) > 0.97
    mean = [np.mean([r.expected_severity for h, r in odd if h == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.3 < mean[1] < 1.6 < mean[2] <= 2


def test_labels_of_the_tables(spark, table):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = severity.predict(docs, severity.fit(docs, labels, severity.from_labels())).join(labels, "doc_id")
    rate = {r.toxic: r.flagged for r in found.groupBy("toxic").agg(
        F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("flagged")).collect()}
    assert rate[0] < 0.02 and rate[1] > 0.75


def test_defined_cases(spark, table, texts):
    labels = spark.createDataFrame([(900007, 1), (900012, 0), (None, 1), (900004, None), (5, 0), (5, 1), (10**9, 2)],
                                   "doc_id long, toxic int")
    model = severity.fit(table(), labels, F.col("toxic"))
    rows = severity.predict(table(), model).collect()
    assert len(rows) == len(texts) and all(0 <= r.expected_severity <= 1 and 0 <= r.p_toxic <= 1 for r in rows)
    none = severity.fit(table(), labels.where("false"), F.col("toxic"))
    assert {r.expected_severity for r in severity.predict(table(), none).collect()} == {0}
    assert severity.predict(table([]), none).count() == 0




def test_screening_in_spark_changes_nothing(spark, table, texts):
    """The fit of all features, screened in one place, and kept columns of results' names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = severity.fit(docs, labels, severity.from_labels())
    grades = {r.doc_id: r.g for r in labels.select("doc_id", severity.from_labels().alias("g")).where("g is not null").collect()}
    rows = []
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id in grades:
            data, offsets = utf8(pa.array([r.text]))
            rows.append((grades[r.doc_id], np.unique(np.concatenate([h for h, _ in severity._features(data, offsets)])).tobytes()))
    rows.sort()
    want = severity.fit_rows([np.frombuffer(b, np.uint32) for _, b in rows], np.array([g for g, _ in rows]))
    assert (model.features == want.features).all() and model.weights == pytest.approx(want.weights) and model.least == want.least
    found = severity.predict(docs.withColumn("p_toxic", F.lit("?")), model, ("doc_id", "p_toxic", "text"))
    assert found.columns == ["doc_id", "text", "expected_severity", "severity_grade", "p_toxic"] and found.count() == docs.count()

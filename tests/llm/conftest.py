import os

import pytest

from tallyspark.llm.tables import ready

SF = "/root/testdata/sf0.001"
# Names that operators use for columns of their own.
CLASHING = ("node", "component", "bucket", "digest", "registers", "part", "payload", "words", "score", "items", "kinds",
            "_text", "_matches", "learn", "grade", "file", "lang_pred", "n_words", "copy", "runs")
EDGES = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "a"), (900005, "12 34 !?"), (900006, "é"),
    (900007, "one two three four five"), (900007, "one two three four five"), (900008, "one two three four five"),
    (None, "one two three four five"), (None, None), (900009, "x" * 5000), (900010, "ab " * 40_000), (900011, "ab " * 40_000),
    (900012, "one two three"), (900013, "one two three"), (900014, "　  \x1c tab\x0bsplit\x0c"),
]


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest documents table with the edge cases, as a list."""
    if not os.path.isdir(SF):
        pytest.skip("test tables are missing")
    ready(spark)
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return given + EDGES


@pytest.fixture(scope="session")
def table(spark, texts):
    """A function: rows to a documents table that has further columns of awkward names."""
    ready(spark)

    def make(rows=texts):
        kind = ", ".join(["doc_id long, text string, lang string, source string, n_chars long",
                          *(f"`{c}` string" for c in CLASHING)])
        full = [(i, t, "en", "s", None if t is None else len(t), *["?"] * len(CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, kind).repartition(3)

    return make

"""Documents to training sequences: language, near copies, benchmark passages, personal data, packing.

Every stage reads what the one before has written and works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import decontaminate, languages, nearcopies, packing, pseudonyms
from tallyspark.llm.tables import documents, ready, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_FIT = 0.0  # a text that fits every learned language worse than noise is rejected, however many it mixes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language, or of several: those without letters go, and those like none. Texts too short
    for a trigram stay."""
    ready(spark)
    found = languages.identify(docs.select(*COLUMNS), COLUMNS)
    like_one = F.coalesce(F.col("fit") >= LEAST_FIT, F.lit(True))
    return found.where((F.col("lang_pred") != languages.UNKNOWN) & like_one).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies. Rows of one id are one document."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    found = nearcopies.near_copies(docs)
    gone = written(found.where("not kept").select("doc_id").distinct(), "copies")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of the benchmark."""
    ready(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(docs.select(*COLUMNS), items, COLUMNS).where("not contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in the texts; the number of characters follows."""
    masked = pseudonyms.masked(docs.select(*COLUMNS))
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of training tokens."""
    ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data),
    ("packing", pack),
]

# Trained models, sketches and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

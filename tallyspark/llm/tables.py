"""Reading inputs, writing tables that later steps read, and carrying columns through Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import new_folder


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package also where the driver's program was not started in its folder."""
    folder, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if folder not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [folder, paths.get("PYTHONPATH")]))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(table: DataFrame, purpose: str) -> DataFrame:
    """The table, written once to the shared folder and read from there: lost executors cost no earlier step again."""
    spark = table.sparkSession
    path = new_folder(spark, purpose)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


class Carried:
    """Kept columns of a table on their way through ``mapInArrow``, under names that clash with nothing, and its text,
    which is sent once also where it is kept. A kept column of a result's name gives way to the result."""

    def __init__(self, table: DataFrame, keep: Sequence[str], text: str, results: str, **more: Column):
        made = StructType.fromDDL(results)
        self.keep = [c for c in keep if c not in made.fieldNames()]
        columns = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(self.keep)]
        at = self.keep.index(text) if text in self.keep else None
        self.text = "_text" if at is None else f"_{at}"
        if at is None:
            columns.append(F.col(f"`{text}`").alias("_text"))
        self.given = table.select(*columns, *[c.alias(n) for n, c in more.items()])
        kept = [StructField(f"_{k}", self.given.schema[f"_{k}"].dataType) for k in range(len(self.keep))]
        self.results, self.schema = made.fieldNames(), StructType([*kept, *made.fields])

    def __getstate__(self) -> dict:
        """What workers need: all but the table."""
        return {k: v for k, v in vars(self).items() if k != "given"}

    def text_of(self, batch: pa.RecordBatch):
        return batch.column(self.text)

    def batch(self, given: pa.RecordBatch, results: Sequence[pa.Array]) -> pa.RecordBatch:
        """The rows given with their results beside the kept columns."""
        kept = [given.column(f"_{k}") for k in range(len(self.keep))]
        return pa.record_batch([*kept, *results], names=self.schema.fieldNames())

    def apply(self, work: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
        made = self.given.mapInArrow(work, self.schema)
        return made.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(self.keep)], *self.results)

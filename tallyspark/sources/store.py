"""Fact and roll-up tables as partitioned Parquet."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import AGG_COLUMNS, AGG_TABLE, FACT_TABLE, PARTITIONS

SMALL_FILE_BYTES = 1024
MAX_FILE_ROWS = 5_000_000
BLOOM_SIZES = 10  # sizes of Bloom filter that are tried, each half of the one before
DISTINCT = ("order_id", "row_key", "row_hash", "recv_customer", "net_received")  # columns whose values hardly repeat in a file


def packed(writer: DataFrameWriter, columns: Sequence[str]) -> DataFrameWriter:
    """A Parquet writer of facts that takes little disk: hashes are half of a row, hence the stronger compression; columns of distinct
    values get no dictionary, which Parquet would build and give up."""
    writer = writer.option("compression", "zstd")
    for name in DISTINCT:
        if name in columns:
            writer = writer.option(f"parquet.enable.dictionary#{name}", False)
    return writer


def write_partitioned(
    table: DataFrame,
    root: str,
    partitions: Sequence[str] = PARTITIONS,
    sort: Sequence[str] = (),
    mode: str = "append",
    replace_only_written: bool = False,
    lookup: Mapping[str, int] | None = None,
    even: bool = True,
) -> None:
    """Write one folder per partition value.

    The rebalance hint lets Spark gather small partitions into few files and split large ones at run time, so
    one large month does not end in one task. ``replace_only_written`` overwrites just the partitions present
    in the data. ``lookup`` names columns that rows are looked up by, with the distinct values to expect in a file at most: its row
    groups then carry Bloom filters of them, no larger than their values need, by which equality skips those without the value. Rows that
    are read from folders of these partitions need no hint: with ``even=False`` they are written by the tasks that read them, not
    shuffled.
    """
    placed = table.hint("rebalance", *partitions) if even else table
    if sort:
        placed = placed.sortWithinPartitions(*partitions, *sort)
    writer = placed.write.mode("overwrite" if replace_only_written else mode).partitionBy(*partitions)
    writer = packed(writer, table.columns).option("maxRecordsPerFile", MAX_FILE_ROWS)
    for name, distinct in (lookup or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", True)
        writer = writer.option("parquet.bloom.filter.max.bytes", 2 ** math.ceil(math.log2(distinct)))  # eight bits a value, at most
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", True)
        writer = writer.option("parquet.bloom.filter.candidates.number", BLOOM_SIZES)
    if replace_only_written:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)


def write_facts(facts: DataFrame, root: str, **options) -> None:
    write_partitioned(facts.select(*FACT_TABLE.fieldNames()), root, sort=("order_id",), **options)


def write_rollup(rollup: DataFrame, root: str, **options) -> None:
    write_partitioned(rollup.select(*AGG_COLUMNS), root, sort=("internal_sku",), **options)


def _folder(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def size_of(spark: SparkSession, root: str) -> int:
    """Bytes of the files below a folder."""
    path, files = _folder(spark, root)
    return files.getContentSummary(path).getLength()


def drop_folders(spark: SparkSession, root: str, name: str, when: Callable[[str], bool]) -> None:
    """Delete the partition folders of a column directly below the root whose value meets the condition."""
    path, files = _folder(spark, root)
    for found in files.listStatus(path):
        column, _, value = found.getPath().getName().partition("=")
        if column == name and when(value):
            files.delete(found.getPath(), True)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """Table with a fixed schema. Paths that do not exist hold no rows."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    try:
        return spark.read.schema(schema).parquet(*listed) if listed else spark.createDataFrame([], schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    present = [p for p in listed if _exists(spark, p)] if len(listed) > 1 else []
    return spark.read.schema(schema).parquet(*present) if present else spark.createDataFrame([], schema)


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, FACT_TABLE)


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, AGG_TABLE)


def of_jobs(table: DataFrame, jobs: Sequence[str] | None) -> DataFrame:
    """Rows of the listed jobs, or of all jobs when none are listed."""
    return table.where(F.col("job_id").isin(*jobs)) if jobs else table


def small_files(spark: SparkSession, root: str, max_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """Report of files below the limit, path and size; contents are not read, and scans read such files like others."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .load(root)
    )
    return files.where(F.col("length") < max_bytes).select("path", "length")


def append_parquet(spark: SparkSession, path: str, table: str, location: str | None = None) -> None:
    """Append a Parquet table to a catalog table, columns matched by name.

    The first load creates the table, at the given location if there is one.
    """
    writer = spark.read.parquet(path).write.mode("append")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def read_jobs(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Files of one job across all tenants, platforms and months, found by path."""
    return spark.read.schema(FACT_TABLE).option("basePath", root).parquet(f"{root}/*/*/*/*/job_id={job}")

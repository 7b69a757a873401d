"""Stream jobs. Every one can be stopped and started again from its checkpoint without repeating results.

Whatever a batch writes goes under a label made of the job's name and the batch number, and replaces what an interrupted
attempt left behind. The name comes from the caller, who gives each checkpoint its own; names and numbers in their order
tell which version of a row is the later one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.joins import join_one, known_keys
from ..operators.rollup import month_sku, operation_sketches, operations
from ..operators.versions import KEY, bucketed_changes, effective_rows, mark_duplicates
from ..plans.ingest import fact_table, settlement_parts, settlement_rows, stamp
from ..plans.upload import upload
from ..session import plans_for, settings
from ..sources import records, store
from ..sources.buckets import BUCKETS, Buckets
from ..sources.ledger import Ledger
from ..sources.sheets import FIRST_LINE, csv_options, stage_rows, with_source_lines

INDEX = StructType([StructField(n, StringType()) for n in ("dataset_id", "upload_id", "row_key", "row_hash")]
                   + [StructField("seq", LongType())])


def label(job: str, batch: int) -> str:
    return f"{job}-{batch:09d}"


# State that grows with the months and SKUs there are: on disk, as the store in memory holds all of it in the executors' heap.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _run(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        frame.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _replace_batch(frame: DataFrame, root: str, batch: int | str) -> None:
    frame.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def landing_files(
    spark: SparkSession, folder: str, columns: Sequence[str], files_per_batch: int | None = None
) -> DataFrame:
    """New settlement CSV files of a folder as a stream; columns are those of the header, all text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(**csv_options())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_block"),
    )


def ingest(
    files: DataFrame, root: str, staging: str, checkpoint: str, platform: str, user_id: str, job: str,
    year: int | None = None, month: int | None = None, mode: str = "merge",
) -> StreamingQuery:
    """Every new file once into the ledger below ``root`` (plans/upload.py): facts, effective view, totals, index, merge
    statistics and dataset records, all in one commit per batch; rejected rows go to ``root``/warnings.

    A batch is one job of the name ``job`` and its number, so another folder or checkpoint needs another name. A batch that is
    repeated after a crash is committed once. Whole files stay together in a batch, which is what line numbering needs. The
    parsed rows and the rows with their amounts are kept in the staging folder: the rules run once for facts and rejects.
    """

    def each(rows: DataFrame, batch: int) -> None:
        spark, job_id = rows.sparkSession, label(job, batch)
        staged = stage_rows(rows, f"{staging}/batch={batch}")
        with plans_for(spark, store.size_of(spark, f"{staging}/batch={batch}")):
            judged = settlement_rows(with_source_lines(staged, FIRST_LINE[platform]), platform, year, month)
            judged.write.mode("overwrite").parquet(f"{staging}/rows-batch={batch}")
            facts, rejects = settlement_parts(spark.read.schema(judged.schema).parquet(f"{staging}/rows-batch={batch}"))
            records.write_warnings(rejects, f"{root}/warnings/job_id={job_id}")
            stamped = stamp(facts, platform=platform, user_id=user_id, upload_id=f"ULP-{job_id}", job_id=job_id)
            upload(Ledger(spark, root), fact_table(stamped), job_id, mode)

    return _run(files, each, checkpoint, "append")


def index_log(spark: SparkSession, root: str, schema: StructType = INDEX, buckets: int = BUCKETS) -> Buckets:
    """The row index below a root: (dataset_id, upload_id, row_key, row_hash, seq) in buckets of the row's key."""
    return Buckets(spark, root, schema, KEY, buckets)


def upsert(
    incoming: DataFrame, root: str, checkpoint: str, compact_every: int = 20, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append inserted and updated rows of the stream to the row index; read it through effective_rows.

    Only the last row per key of a batch counts, so the outcome does not depend on how rows fall into batches. ``incoming`` has
    dataset_id, upload_id, row_key, row_hash and seq. A batch is shuffled into the buckets of the index, which itself is not.
    A repeated batch finds its own rows known and appends nothing. Every so many batches the index is put together.
    """

    def each(rows: DataFrame, batch: int) -> None:
        log = index_log(rows.sparkSession, root, rows.schema, buckets)
        last = effective_rows(rows)
        log.append(bucketed_changes(last, log.read(last)).drop("action"))
        if batch and batch % compact_every == 0:
            log.compact("seq")

    return _run(incoming, each, checkpoint, "append")


def unique_uploads(
    uploads: DataFrame, keys: Sequence[str], order: Sequence[str], root: str, checkpoint: str, buckets: int = BUCKETS,
) -> StreamingQuery:
    """The first upload of each key, however late its copies come, in buckets of the key below ``root``; ``uploads_log`` reads
    them. What is known is the written table, and no state grows in the stream. Missing key parts are equal to each other."""

    def each(rows: DataFrame, batch: int) -> None:
        log = uploads_log(rows.sparkSession, root, rows.schema, buckets)
        first = mark_duplicates(rows, keys, order).where("not is_duplicate").select(*rows.columns)
        fresh = first.withColumn(DIGEST, key_digest(keys))
        log.append(fresh.join(log.read().select(DIGEST).distinct(), DIGEST, "left_anti"))

    return _run(uploads, each, checkpoint, "append")


DIGEST = "_key"


def key_digest(keys: Sequence[str]) -> Column:
    """One text for a key with its missing parts."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def uploads_log(spark: SparkSession, root: str, schema: StructType, buckets: int = BUCKETS) -> Buckets:
    kept = [f for f in schema.fields if f.name != DIGEST]
    return Buckets(spark, root, StructType([*kept, StructField(DIGEST, StringType())]), [DIGEST], buckets)


def compact(spark: SparkSession, root: str, keys: Sequence[str], upto: int) -> None:
    """Move the latest values of all batches before ``upto`` into it, and drop those batches. Batch ``upto`` must be done:
    a repetition after a crash then only adds equal rows."""
    schema = spark.read.parquet(root).schema
    rows = spark.read.schema(schema).parquet(root)
    older = rows.where(F.col("batch") < upto)
    if older.isEmpty():
        return
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = older.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_last")).select(*keys, "_last.*")
    newer = known_keys(rows.where(F.col("batch") == upto), keys)
    join_one(last, newer, keys, "left_anti").write.mode("append").parquet(f"{root}/batch={upto}")
    store.drop_folders(spark, root, "batch", lambda batch: int(batch) < upto)


def running_totals(
    facts: DataFrame, keys: Sequence[str], root: str, checkpoint: str, compact_every: int = 20
) -> StreamingQuery:
    """Month by SKU totals so far; each batch holds the totals that changed in it, and every so many batches the earlier
    ones are put together."""

    def each(rows: DataFrame, batch: int) -> None:
        _replace_batch(rows, root, batch)
        if batch and batch % compact_every == 0:
            compact(rows.sparkSession, root, keys, batch - 1)

    with settings(facts.sparkSession, ON_DISK):
        return _run(month_sku(facts, keys), each, checkpoint, "update")


def operations_by_window(
    jobs: DataFrame, root: str, checkpoint: str, width: str = "1 minute", delay: str = "10 minutes", sketches: bool = False,
) -> StreamingQuery:
    """Job metrics per time window; late jobs change their window until the delay has passed. With ``sketches`` windows keep a
    quantile sketch instead of percentiles, from which ``merged_operations`` makes longer windows."""
    made = operation_sketches if sketches else operations
    metrics = made(jobs.withWatermark("created_at", delay), width)
    return _run(metrics, lambda rows, n: _replace_batch(rows, root, n), checkpoint, "update")


def latest_values(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """Last written row per key of an update stream."""
    written = spark.read.parquet(root)
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_last"))
    return last.select(*keys, "_last.*")

"""Merging by row key and content hash, effective rows, and dataset records.

The row index is an append-only log: (dataset_id, upload_id, row_key, row_hash, seq). The latest append of a
key is its effective row. Everything is built from aggregates and joins against one row per key, so a key
that holds a large share of the log is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_folder
from .joins import join_one, known_keys

KEY = ("dataset_id", "row_key")


def effective_rows(log: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Last append per key."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return latest.select(*keys, "_last.*")


def first_rows(table: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    rest = [c for c in table.columns if c not in keys]
    first = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def merge_actions(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming rows with the action a merge takes: inserted, updated or unchanged.

    Each incoming row is compared with the log as it stands, so equal keys in one batch all count.
    """
    known = log.groupBy(*KEY).agg(F.max_by("row_hash", "seq").alias("_known"))
    action = (
        F.when(F.col("_known").isNull(), F.lit("inserted"))
        .when(F.col("_known") != F.col("row_hash"), F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    return join_one(incoming, known, KEY).withColumn("action", action).drop("_known")


def bucketed_changes(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Rows, one per key, that a merge into the log inserts or updates, with their action. Where the log lies in buckets of
    the key, grouping and join leave it in place: the keys alone join, without the bucket number of ``join_one``."""
    known = log.groupBy(*KEY).agg(F.max_by("row_hash", "seq").alias("_known"))
    action = F.when(F.col("_known").isNull(), F.lit("inserted")).when(F.col("_known") != F.col("row_hash"), F.lit("updated"))
    joined = incoming.join(known, list(KEY), "left").withColumn("action", action).drop("_known")
    return joined.where("action is not null")


def merge_stats(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Row counts per action."""
    return merge_actions(incoming, log).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def merge_upsert(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log with every inserted and updated row appended after all earlier ones."""
    changed = merge_actions(incoming, log).where("action <> 'unchanged'").drop("action")
    return log.unionByName(changed.select(*log.columns))


def existing_rows(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming rows whose key and hash match the effective row."""
    latest = log.groupBy(*KEY).agg(F.max_by("row_hash", "seq").alias("row_hash"))
    return join_one(incoming, latest, [*KEY, "row_hash"], "left_semi")


def view_uploads(effective: DataFrame) -> DataFrame:
    """Uploads behind each effective view, one row per dataset and upload."""
    return effective.select("dataset_id", "upload_id").distinct()


def view_report(effective: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and uploads of each period's view."""
    return effective.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("upload_id").alias("uploads")
    )


def mark_duplicates(uploads: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add first_id and is_duplicate: every upload but the first with its key is a duplicate."""
    # Fields of a struct match when both are missing, so uploads without some key part are kept as well.
    keyed = uploads.withColumn("_key", F.struct(*keys))
    first = keyed.groupBy("_key").agg(F.min_by("id", F.struct(*order)).alias("first_id"))
    marked = join_one(keyed, first, ["_key"], "inner").drop("_key")
    return marked.withColumn("is_duplicate", F.col("id") != F.col("first_id"))


def missing_files(uploaded: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """File roles each upload lacks, of those its platform requires.

    ``uploaded`` has upload_id, platform and file_type.
    """
    roles = F.create_map(*[x for p, r in required.items() for x in (F.lit(p), F.array(*map(F.lit, r)))])
    wanted = uploaded.select("upload_id", "platform").distinct().withColumn("file_type", F.explode(roles[F.col("platform")]))
    key = ["upload_id", "platform", "file_type"]
    return join_one(wanted, known_keys(uploaded, key), key, "left_anti")


def job_backfill(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Completed jobs of each existing dataset, one row each, with the latest one repeated on every row.

    Only a status that is present and says otherwise rules a job out.
    """
    unsaid = F.coalesce(F.col("status"), F.lit("")) == ""
    done = jobs.where(unsaid | F.col("status").isin("completed", "succeeded")).where(
        "dataset_id <> '' and job_id <> ''"
    ).select("dataset_id", "job_id").distinct()
    latest = done.groupBy("dataset_id").agg(
        F.max("job_id").alias("latest_job_id"), F.count(F.lit(1)).alias("job_count")
    )
    known = join_one(latest, known_keys(datasets, ["dataset_id"]), ["dataset_id"], "left_semi")
    return join_one(done, known, ["dataset_id"], "inner")


def active_datasets(datasets: DataFrame, requests: DataFrame) -> DataFrame:
    """Active datasets asked for by user, platform, year and month."""
    period = ["user_id", "platform", "year", "month"]
    return join_one(datasets.where("status = 'active'"), known_keys(requests, period), period, "left_semi")


def latest_job(job_id: Column, job_ids: Column) -> Column:
    """The recorded job, else the last one of the list."""
    return F.coalesce(job_id, F.try_element_at(job_ids, F.lit(-1)))


def merged_job_ids(existing: Column, incoming: Column) -> Column:
    """Union of two id lists, existing ones first, without empty ids."""
    none = F.array().cast("array<string>")
    joined = F.array_union(F.coalesce(existing, none), F.coalesce(incoming, none))
    return F.filter(joined, lambda x: x.isNotNull() & (x != ""))


ROW_KEY = ("user_id", "platform", "year", "month", "row_key")


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order, where keys may have missing parts. Sorts and shuffles all rows whole."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


HASH = "_hash"
MANY = 1_000_000  # repeated hashes from which on rows are shuffled to be told apart by them


def repeated_hashes(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Hashes of the keys that stand more than once in all tables together: eight bytes a row are shuffled. To be written, so
    that its size is known where rows are told apart. Different keys of one hash are among them, and do no harm."""
    hashed = reduce(DataFrame.unionAll, [t.select(F.xxhash64(*keys).alias(HASH)) for t in tables])
    return hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(HASH)


def met_hashes(known: DataFrame, brought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes of the keys that stand more than once among the rows brought, or there and in ``known``, which has one row per key.
    Where few rows are brought, those known are looked through where they lie and not counted."""
    table, rows = (t.select(F.xxhash64(*keys).alias(HASH)) for t in (known, brought))
    return repeated_hashes([brought], keys).unionByName(table.join(rows, HASH, "left_semi")).distinct()


def alone(rows: DataFrame, keys: Sequence[str], repeated: DataFrame) -> DataFrame:
    """Rows whose key stands once, by the repeated hashes; as long as these are few the rows stay where they are read."""
    return rows.withColumn(HASH, F.xxhash64(*keys)).join(repeated, HASH, "left_anti").drop(HASH)


def among(rows: DataFrame, keys: Sequence[str], repeated: DataFrame) -> DataFrame:
    """The other rows: all that may share a key."""
    return rows.withColumn(HASH, F.xxhash64(*keys)).join(repeated, HASH, "left_semi").drop(HASH)


def written_hashes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    folder = new_folder(rows.sparkSession, "repeated")
    repeated_hashes([rows], keys).write.parquet(folder)
    return rows.sparkSession.read.schema(f"{HASH} long").parquet(folder)


def latest_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], repeated: DataFrame | None = None,
) -> DataFrame:
    """The last row of each key in the given order, where keys may have missing parts.

    ``rows`` is a stored table: its keys are read first, and only rows that may share theirs are shuffled whole. ``repeated``
    are its written_hashes, where they are known.
    """
    hashes = written_hashes(rows, keys) if repeated is None else repeated
    return alone(rows, keys, hashes).unionByName(last_rows(among(rows, keys, hashes), keys, order))


LATEST = ("seq", "source_file", "source_line")


def effective_facts(facts: DataFrame, order: Sequence[str] = LATEST, repeated: DataFrame | None = None) -> DataFrame:
    """Latest version of each row key of a tenant, platform and month: the facts that previews, summaries and exports show.

    Later means greater by ``order``: the number of the commit that brought the row, which a ledger gives as ``seq``, then the
    place in the upload. One row per key stays, also where an upload brings a key twice.
    """
    return latest_per_key(facts, ROW_KEY, order, repeated)


def supersede(datasets: DataFrame, dataset_id: Column, by: Column, at: Column) -> DataFrame:
    """Mark every record with the id as superseded."""
    hit = F.col("id") == dataset_id
    return datasets.withColumns(
        {
            "status": F.when(hit, F.lit("superseded")).otherwise(F.col("status")),
            "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
            "superseded_at": F.when(hit, at).otherwise(F.col("superseded_at")),
            "superseded_by": F.when(hit, by).otherwise(F.col("superseded_by")),
        }
    )


def _one_per_id(incoming: DataFrame) -> DataFrame:
    """Incoming records of one id as one: the last of them with the job ids of all, in the order of ``seq``."""
    rest = [c for c in incoming.columns if c not in ("id", "job_ids")]
    kept = [c for c in rest if c != "seq"]
    lists = incoming.select("id", "seq", F.posexplode_outer("job_ids").alias("_at", "_job")).where("_job <> ''")
    # One entry per job first, so that an id with many records stays one row per job until the list is built.
    jobs = lists.groupBy("id", "_job").agg(F.min(F.struct("seq", "_at")).alias("_place"))
    jobs = jobs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_place", "_job"))).alias("_jobs"))
    last = incoming.groupBy("id").agg(F.max_by(F.struct(*kept), "seq").alias("_last"))
    joined = last.join(jobs, "id", "left")
    none = F.array().cast("array<string>")
    return joined.select("id", "_last.*", F.coalesce(F.transform("_jobs", lambda j: j["_job"]), none).alias("job_ids"))


def upsert_datasets(datasets: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """Create or reactivate: incoming records win, job lists are united, extra records of an id go.

    Both sides have id, user_id, platform, year, month, upload_id, job_id, job_ids and an order ``seq``; ``datasets`` also
    has status, created_at, updated_at. Several incoming records of an id count as one, the last, with all their jobs.
    """
    old = first_rows(datasets, ["id"], ["seq"])
    fixed = ("user_id", "platform", "year", "month")
    o = old.select("id", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "id"])
    both = o.join(_one_per_id(incoming), "id", "full_outer")
    touched = F.col("upload_id").isNotNull()
    return both.select(
        "id",
        *[F.coalesce(f"_{c}", c).alias(c) for c in fixed],
        F.coalesce("upload_id", "_upload_id").alias("upload_id"),
        F.when(touched, F.lit("active")).otherwise(F.col("_status")).alias("status"),
        F.coalesce(F.col("_created_at"), at).alias("created_at"),
        F.when(touched, at).otherwise(F.col("_updated_at")).alias("updated_at"),
        F.coalesce("job_id", "_job_id").alias("job_id"),
        merged_job_ids(F.col("_job_ids"), F.col("job_ids")).alias("job_ids"),
    )


def clear_period(facts: DataFrame, user: str, platform: str, year: int, month: int) -> DataFrame:
    """All rows but those of one tenant's platform month."""
    period = (
        (F.col("user_id") == user) & (F.col("platform") == platform)
        & (F.col("year") == year) & (F.col("month") == month)
    )
    return facts.where(~F.coalesce(period, F.lit(False)))


def replace_periods(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows in place of everything their tenant, platform and month held before."""
    period = ["user_id", "platform", "year", "month"]
    kept = join_one(facts, known_keys(incoming, period), period, "left_anti")
    return kept.unionByName(incoming.select(*facts.columns))


def table_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of which the two tables hold different counts."""
    columns = actual.columns
    a = actual.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_e"))
    e = expected.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_e"))
    counted = a.unionByName(e).groupBy(*columns).agg(F.sum("_a").alias("actual"), F.sum("_e").alias("expected"))
    return counted.where("actual <> expected")


def line_difference(actual: DataFrame, expected: DataFrame, line: str = "line", text: str = "text") -> DataFrame:
    """Lines that differ, or that only one side has, by line number."""
    a = actual.select(line, F.col(text).alias("actual"))
    e = expected.select(line, F.col(text).alias("expected"))
    return a.join(e, line, "full_outer").where(~F.col("actual").eqNullSafe(F.col("expected")))


def migrate_uploads(records: DataFrame, prefix: str = "ULP-") -> DataFrame:
    """Keep records with proper ids, move the old hash field to the new one and fill the file name."""
    kept = records.where(F.col("id").startswith(prefix))

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return kept.withColumns(
        {
            "content_hash": F.coalesce(filled("content_hash"), F.col("contenthash")),
            "file_name": F.coalesce(filled("file_name"), F.col("original_filename")),
        }
    ).drop("contenthash")

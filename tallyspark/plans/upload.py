"""What an upload does to a settlement ledger: facts, effective view, totals, row index and dataset records in one commit.

=========  ==================================================================================================
table      holds
=========  ==================================================================================================
facts      every row of every upload that was not replaced or cleared
effective  the latest row of each row key, which previews, summaries and exports show, and rows that are hidden
hidden     keys of rows of the view that later commits have replaced, with the folder the row lies in
totals     signed sums by month and SKU: what a commit added to the effective view less what it took out
index      key and hash of rows as they were inserted or updated
merges     how many rows each upload inserted, updated and left unchanged
datasets   one record per upload and month; the last of an id is its state
=========  ==================================================================================================

A merge joins the rows of the upload with the effective rows of the months it brings, and with no others; rows whose key stands
once in both, by its hash, are neither joined nor shuffled. Rows of the view that it replaces are hidden where they lie: a folder of
a commit and month is written again, without them, when they are a share of it (RENEWED). Of rows that share a key, the last of the upload counts; the index and the view so have one row per key. A month's totals
are the sums of its signed rows, whatever the order of uploads: they equal the roll-up of the effective view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from ..functions.keys import dataset_id
from ..operators.rollup import month_sku
from ..operators.versions import MANY, alone, among, effective_facts, last_rows, met_hashes
from ..schemas import AGG_SUMS, FACT_TABLE
from ..session import together
from ..sources.ledger import PERIOD, UNIT, Ledger, Places, listed, local_table, same_month

_MONTH = [f for f in FACT_TABLE.fields if f.name in PERIOD]
_SUM = DecimalType(38, 2)
TOTALS = StructType([*_MONTH, StructField("internal_sku", StringType()), *[StructField(n, _SUM) for n in AGG_SUMS],
                     StructField("record_count", LongType())])
INDEX = StructType([*_MONTH, *[StructField(n, StringType()) for n in ("dataset_id", "upload_id", "row_key", "row_hash")]])
MERGES = StructType([*_MONTH, *[StructField(n, StringType()) for n in ("dataset_id", "job_id", "action")], StructField("rows", LongType())])
DATASETS = StructType([*_MONTH, *[StructField(n, StringType()) for n in ("id", "upload_id", "job_id", "status", "mode", "superseded_by")]])
HIDDEN = StructType([*_MONTH, StructField("row_key", StringType()), StructField("folder", StringType())])
TABLES = {"facts": FACT_TABLE, "effective": FACT_TABLE, "hidden": HIDDEN, "totals": TOTALS, "index": INDEX, "merges": MERGES, "datasets": DATASETS}
MODES = ("merge", "replace")
RENEWED = 8  # one row in so many that a folder of the view may have hidden
FEW_BYTES = 8 << 20  # of hidden keys, up to which they are sent to the rows of the view

_SKU = (*PERIOD, "internal_sku")
_PLACED = StructType([*FACT_TABLE.fields, StructField("token", StringType())])  # rows of the view with the folder they lie in


def dataset() -> Column:
    return dataset_id(*[F.col(c) for c in PERIOD])


def _signed(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Sums of added rows less those of removed ones, by month and SKU."""
    plus = month_sku(added, _SKU)
    if removed is None:
        return plus
    minus = month_sku(removed, _SKU).select(*_SKU, *[(-F.col(n)).alias(n) for n in (*AGG_SUMS, "record_count")])
    return _summed(plus.unionByName(minus))


def _summed(signed: DataFrame) -> DataFrame:
    sums = [F.sum(n).cast(TOTALS[n].dataType).alias(n) for n in (*AGG_SUMS, "record_count")]
    empty = " and ".join(f"{n} = 0" for n in (*AGG_SUMS, "record_count"))
    return signed.groupBy(*_SKU).agg(*sums).where(f"not ({empty})")


def totals(ledger: Ledger, months: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Month by SKU sums of the effective view."""
    return _summed(ledger.read("totals", TOTALS, months, version))


def _unhidden(ledger: Ledger, rows: DataFrame, months: Places | None, version: int | None) -> DataFrame:
    """Rows of the view, with the folder they lie in as ``token``, less those that are hidden."""
    size = ledger.size("hidden", months, version)
    if not size:
        return rows
    hidden = ledger.read("hidden", HIDDEN, months, version).withColumnRenamed("folder", "token")
    return same_month(rows, F.broadcast(hidden) if size <= FEW_BYTES else hidden, "left_anti", (*PERIOD, "row_key", "token"))


def _view(ledger: Ledger, months: Places | None, version: int | None, places: Places | None = None) -> DataFrame:
    """The effective view of months, or of places (month, token) in them, with the folder of each row as ``token``."""
    rows = ledger.read("effective", FACT_TABLE, months if places is None else places, version, token=True)
    return _unhidden(ledger, rows, months, version)


def effective(ledger: Ledger, months: Places | None = None, version: int | None = None) -> DataFrame:
    version = ledger.version() if version is None else version
    return _view(ledger, months, version).drop("token")


def datasets(ledger: Ledger, months: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The state of every dataset: its last record."""
    records = ledger.read("datasets", DATASETS, months, version)
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select("id", "_last.*")


def upload(ledger: Ledger, facts: DataFrame, label: str, mode: str = "merge", placed: bool = False) -> int:
    """Bring the stamped facts of one job, all of its rows, into the ledger; returns the version.

    ``merge`` adds new keys and replaces known ones, ``replace`` puts the rows in place of all that their months held. A label
    that is known changes nothing. ``placed`` rows are read from folders of months, and are not shuffled to be written.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    change = ledger.begin(label)
    if change.done is not None:
        return change.done
    typed = facts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_TABLE.fields])
    brought = (change.append if mode == "merge" else change.replace)("facts", typed, even=not placed)
    months = listed(brought.select(*PERIOD))
    if not isinstance(months, list):
        months = change.scratch("months", months)
    if mode == "replace":
        known = ledger.spark.createDataFrame([], _PLACED).where(F.lit(False))
    else:
        known = _view(ledger, months, change.base).drop("seq")

    # Keys that stand once in view and upload need no partner; of the others one row per key of both sides, side by side,
    # written once for all that follows.
    key = [*PERIOD, "row_key"]
    repeated = change.scratch("repeated", met_hashes(known, brought, key))
    hashes = repeated.count()
    even = hashes > MANY
    if not hashes:  # known to be empty before the plans are made, so that none of them reads the view
        repeated = repeated.where(F.lit(False))
    single, several = alone(brought, key, repeated), among(brought, key, repeated)
    new = last_rows(several, key, ("source_file", "source_line"))
    packed = [t.select(*key, F.struct(*FACT_TABLE.fieldNames()).alias(n), *kept)
              for t, n, kept in ((among(known, key, repeated), "_old", ["token"]), (new, "_new", []))]
    a, b = packed[0].alias("_a"), packed[1].alias("_b")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}"))
    both = change.scratch("merged", a.join(b, on, "full_outer").select("_old", "_new", "token"))
    changed = both.where("_new is not null and (_old is null or not (_old.row_hash <=> _new.row_hash))")
    added, removed = single.unionByName(changed.select("_new.*")), changed.where("_old is not null").select("_old.*")

    rows = added.select(*PERIOD, dataset().alias("dataset_id"), "upload_id", "row_key", "row_hash").select(*INDEX.fieldNames())
    counted = several.groupBy(*key, "row_hash", "job_id").agg(F.count(F.lit(1)).alias("rows"))
    before = both.where("_new is not null").select(*[f"_new.{c}" for c in key], F.col("_old.row_hash").alias("_known"))
    action = (F.when(F.col("_known").isNull(), F.lit("inserted")).when(F.col("_known") != F.col("row_hash"), F.lit("updated"))
              .otherwise(F.lit("unchanged")))
    judged = same_month(counted, before, "inner", key).select(*PERIOD, "job_id", action.alias("action"), "rows")
    first = single.groupBy(*PERIOD, "job_id").agg(F.count(F.lit(1)).alias("rows")).select(
        *PERIOD, "job_id", F.lit("inserted").alias("action"), "rows")
    stats = judged.unionByName(first).groupBy(*PERIOD, "job_id", "action").agg(F.sum("rows").alias("rows"))
    record = brought.groupBy(*PERIOD).agg(F.max("upload_id").alias("upload_id"), F.max("job_id").alias("job_id"))
    none = F.lit(None).cast("string")
    record = record.select(
        *PERIOD, dataset().alias("id"), "upload_id", "job_id", F.lit("active").alias("status"), F.lit(mode).alias("mode"),
        none.alias("superseded_by"))
    signed = _signed(added, removed) if mode == "merge" else _signed(added)
    put = change.append if mode == "merge" else change.replace

    def renew() -> None:
        """Rows of the view that are replaced are hidden, or their folders written anew without them; new rows lie beside them."""
        if mode == "replace":
            change.clear("hidden", months)
        if mode == "replace" or not hashes:
            return
        met = both.where("_old is not null and _new is not null").select(*[F.col(f"_old.{c}").alias(c) for c in key], "token")
        counts = [
            met.select(*PERIOD, "token", F.lit(1).alias("_met"), F.lit(1).alias("_gone"), F.lit(0).alias("_rows")),
            ledger.read("hidden", HIDDEN, months, change.base).select(
                *PERIOD, F.col("folder").alias("token"), F.lit(0).alias("_met"), F.lit(1).alias("_gone"), F.lit(0).alias("_rows")),
            ledger.read("effective", FACT_TABLE, months, change.base, token=True).select(
                *PERIOD, "token", F.lit(0).alias("_met"), F.lit(0).alias("_gone"), F.lit(1).alias("_rows"))]
        sums = reduce(DataFrame.unionByName, counts).groupBy(*PERIOD, "token").agg(*[F.sum(n).alias(n) for n in ("_met", "_gone", "_rows")])
        touched = change.scratch("touched", sums.where("_met > 0").withColumn("_renew", F.col("_gone") * RENEWED >= F.col("_rows")))
        units = listed(touched.where("_renew").select(*PERIOD, "token"))
        if not isinstance(units, list):
            units = change.scratch("units", units)
        places = local_table(ledger.spark, units, UNIT) if isinstance(units, list) else units
        if not isinstance(units, list) or units:
            rest = alone(_view(ledger, months, change.base, units).drop("seq", "token"), key, repeated)
            left = same_month(both.where("_new is null").select("_old.*", "token"), places, "left_semi", (*PERIOD, "token"))
            change.renew("effective", rest.unionByName(left.drop("token")), units, even=even)
        if not touched.where("not _renew").isEmpty():
            hidden = same_month(met, places, "left_anti", (*PERIOD, "token"))
            change.append("hidden", hidden.withColumnRenamed("token", "folder").select(*HIDDEN.fieldNames()), even=even, months=months)

    together(
        ledger.spark, renew,
        lambda: put("effective", single.unionByName(both.where("_new is not null").select("_new.*")), even=even, months=months),
        lambda: put("totals", signed.select(*TOTALS.fieldNames()), months=months),
        lambda: put("index", rows, even=even, months=months),
        lambda: change.append("merges", stats.withColumn("dataset_id", dataset()).select(*MERGES.fieldNames()), months=months),
        lambda: change.append("datasets", record.select(*DATASETS.fieldNames()), months=months))
    return change.commit()


def clear(ledger: Ledger, user: str, platform: str, year: int, month: int, label: str) -> list[str] | None:
    """Empty one tenant's platform month: facts, view, totals and index at once, its dataset marked as superseded. Returns the
    jobs that had written it, None if there is no active dataset."""
    months = ledger.months(user_id=user, platform=platform, year=year, month=month)
    change = ledger.begin(label)
    state = datasets(ledger, months, change.base).where("status = 'active'")
    if state.isEmpty():
        return None
    jobs = sorted(r.job_id for r in ledger.read("facts", FACT_TABLE, months, change.base).select("job_id").distinct().collect())
    for name in ("facts", "effective", "hidden", "totals", "index"):
        change.clear(name, months)
    change.append("datasets", state.withColumns(
        {"status": F.lit("superseded"), "superseded_by": F.lit("manual-clear")}).select(*DATASETS.fieldNames()))
    change.commit()
    return jobs


def compact(ledger: Ledger, name: str, label: str, months: DataFrame | None = None) -> int:
    """Put the commits of a table's months together: signed totals to sums, other rows as they are."""
    if name == "totals":
        return ledger.compact(name, TOTALS, label, months, lambda rows: _summed(rows).select(*TOTALS.fieldNames()))
    if name == "effective":
        return ledger.compact(name, FACT_TABLE, label, months, lambda rows: _unhidden(ledger, rows, months, None).drop("seq", "token"), token=True)
    return ledger.compact(name, TABLES[name], label, months)


def check_view(ledger: Ledger, months: DataFrame | None = None) -> DataFrame:
    """Keys of the effective view that occur more than once, and months whose totals differ from the view's roll-up: empty
    unless something is wrong."""
    view = effective(ledger, months)
    doubled = view.groupBy(*PERIOD, "row_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rolled = month_sku(view, _SKU).select(*TOTALS.fieldNames())
    summed = totals(ledger, months).select(*TOTALS.fieldNames())
    differing = rolled.exceptAll(summed).unionByName(summed.exceptAll(rolled))
    return doubled.select(*PERIOD, F.col("row_key").alias("key"), F.lit("key").alias("kind")).unionByName(
        differing.select(*PERIOD, F.col("internal_sku").alias("key"), F.lit("totals").alias("kind")).distinct())


def history(ledger: Ledger, months: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The effective view worked out anew from all facts; equal to ``effective`` but for the stored order."""
    return effective_facts(ledger.read("facts", FACT_TABLE, months, version))


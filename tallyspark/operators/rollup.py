"""Month by SKU roll-ups, totals and facets. Every aggregate combines on the map side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import row_hash
from ..functions.numbers import money_or_zero
from ..schemas import AGG_SUMS, AMOUNTS, SUM_MONEY
from .validate import computed_net, consistency

SKETCH = 500  # size of quantile sketches
MONTH_SKU = ("user_id", "platform", "year", "month", "upload_id", "job_id", "internal_sku")


def _amount(name: str) -> Column:
    return money_or_zero(F.col(name))


def _sum(value: Column, name: str) -> Column:
    return F.sum(value).cast(SUM_MONEY).alias(name)


def month_sku(facts: DataFrame, keys: Sequence[str] = MONTH_SKU, income: str = "all") -> DataFrame:
    """Sums per key. Income is I + J + K, or J alone for the earlier variant (``income="platform"``)."""
    parts = ("recv_customer", "recv_platform", "extra_charge") if income == "all" else ("recv_platform",)
    total = sum((_amount(p) for p in parts[1:]), _amount(parts[0]))
    return facts.groupBy(*keys).agg(
        _sum(_amount("qty_sold"), "qty_sold_sum"),
        _sum(total, "income_total_sum"),
        _sum(_amount("fee_platform_comm"), "fee_platform_comm_sum"),
        _sum(_amount("fee_affiliate") + _amount("fee_other"), "fee_other_sum"),
        _sum(_amount("net_received"), "net_received_sum"),
        F.count(F.lit(1)).alias("record_count"),
    )


def wide_sku(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every amount summed on its own."""
    sums = [F.sum(_amount("qty_sold")).alias("qty_sold")]
    sums += [F.sum(_amount(n)).alias(f"sum_{n}") for n in AMOUNTS[1:]]
    return facts.groupBy(*keys).agg(*sums)


def fact_summary(facts: DataFrame) -> DataFrame:
    """Totals of all rows with the consistency check, one row."""
    totals = facts.agg(*[F.sum(_amount(n)).alias(f"total_{n}") for n in AMOUNTS])
    named = totals.select(*[F.coalesce(f"total_{n}", F.lit(0)).cast(SUM_MONEY).alias(n) for n in AMOUNTS])
    checked = consistency(named, computed_net(), F.col("net_received"))
    return checked.select(*[F.col(n).alias(f"total_{n}") for n in AMOUNTS], "consistency_check", "consistency_error")


def agg_summary(rollup: DataFrame) -> DataFrame:
    """Totals of a roll-up, its row count and the consistency check, one row."""
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast(SUM_MONEY).alias(f"total_{n}") for n in AGG_SUMS]
    totals = rollup.agg(
        *sums,
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_record_count"),
        F.count(F.lit(1)).alias("sku_count"),
    )
    net = (
        F.col("total_income_total_sum") - F.col("total_fee_platform_comm_sum") - F.col("total_fee_other_sum")
    )
    return consistency(totals, net, F.col("total_net_received_sum"))


def with_total_row(facts: DataFrame, key: str) -> DataFrame:
    """Per-key sums plus one total row (is_total = 1), with the combined fees."""
    sums = [F.sum(_amount(n)).alias(n) for n in AMOUNTS]
    rolled = facts.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *sums)
    fees = F.col("fee_platform_comm") + F.col("fee_affiliate") + F.col("fee_other")
    return rolled.withColumn("fees_total", fees)


def merge_duplicates(
    facts: DataFrame, key: str = "row_key", order: Sequence[str] = ("source_file", "source_line"),
) -> DataFrame:
    """One row per key: attributes of the first row, largest quantity, summed amounts, recomputed net and row hash.

    Rows that stand alone keep their net amount and hash as they came. Files come in the order of their names.
    """
    attributes = [c for c in facts.columns if c not in AMOUNTS and c != key]
    charges = [n for n in AMOUNTS if n not in ("qty_sold", "net_received")]
    merged = facts.groupBy(key).agg(
        F.min_by(F.struct(*attributes), F.struct(*order)).alias("_first"),
        F.max(_amount("qty_sold")).alias("qty_sold"),
        *[F.sum(_amount(n)).alias(n) for n in charges],
        F.max("net_received").alias("_only_net"),
        F.count(F.lit(1)).alias("source_merge_count"),
    )
    net = F.when(F.col("source_merge_count") == 1, F.col("_only_net")).otherwise(computed_net())
    rows = merged.select(
        key, "_first.*", "qty_sold", *charges, net.cast(SUM_MONEY).alias("net_received"), "source_merge_count"
    )
    if "row_hash" not in rows.columns:
        return rows
    return rows.withColumn("row_hash", F.when(F.col("source_merge_count") == 1, F.col("row_hash")).otherwise(row_hash()))


def status_counts(facts: DataFrame, by: Sequence[str] = ("job_id",)) -> DataFrame:
    """Rows per job and validation status."""
    return facts.groupBy(*by, "validation_status").agg(F.count(F.lit(1)).alias("rows"))


def zero_lines(facts: DataFrame) -> DataFrame:
    """How many rows have a line number or line count of zero."""
    zero = (F.col("line_no") == 0) | (F.col("line_count") == 0)
    return facts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(zero).alias("zero_line_rows"),
        (F.count(F.lit(1)) - F.count_if(zero)).alias("nonzero_line_rows"),
    )


def facets(datasets: DataFrame, user: str, platform: str | None = None, year: int | None = None) -> DataFrame:
    """Platforms, years and months with active datasets of a user, one (facet, value) row each.

    Years are those of the platform if one is given; months need both platform and year.
    """
    active = datasets.where((F.col("user_id") == user) & (F.col("status") == "active"))
    in_platform = F.lit(True) if platform is None else F.col("platform") == platform
    in_year = F.lit(False) if platform is None or year is None else in_platform & (F.col("year") == year)

    def entry(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    # One pass: each record offers up to three entries, and equal ones meet before the shuffle.
    found = active.select(F.inline(F.array(
        entry("platform", F.col("platform")),
        entry("year", F.when(in_platform, F.col("year").cast("string"))),
        entry("month", F.when(in_year, F.lpad(F.col("month").cast("string"), 2, "0"))),
    )))
    return found.where("value is not null").distinct()


def operations(jobs: DataFrame, width: str = "1 minute", accuracy: int = 100_000) -> DataFrame:
    """Per time window: jobs, failures, success rate and latency percentiles."""
    done = F.col("status").isin("completed", "succeeded")
    failed = F.col("status") == "failed"
    windowed = jobs.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(done).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.percentile_approx("latency", [0.5, 0.95, 0.99], accuracy).alias("p"),
    )
    return _shown(windowed)


def operation_sketches(jobs: DataFrame, width: str = "1 minute", k: int = SKETCH) -> DataFrame:
    """Per time window: jobs by outcome, and a quantile sketch of their latencies. To be stored, and merged into longer windows
    without the jobs; jobs without a latency are in no sketch."""
    done = F.col("status").isin("completed", "succeeded")
    windowed = jobs.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(done).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.kll_sketch_agg_double(F.col("latency").cast("double"), F.lit(k)).alias("latencies"))
    return windowed.select(F.col("w.start").alias("window_start"), "jobs", "succeeded", "failed", "latencies")


def merged_operations(sketches: DataFrame, width: str = "1 day", k: int = SKETCH) -> DataFrame:
    """The report of longer windows from stored shorter ones. A percentile's rank is off by less than 0.7 percent of the window's
    jobs, with 99 percent confidence, at the default size of the sketches."""
    windowed = sketches.groupBy(F.window("window_start", width).alias("w")).agg(
        *[F.sum(n).alias(n) for n in ("jobs", "succeeded", "failed")],
        F.kll_merge_agg_double("latencies", F.lit(k)).alias("_merged"))
    p = F.kll_sketch_get_quantile_double("_merged", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return _shown(windowed.withColumn("p", p))


def _shown(windowed: DataFrame) -> DataFrame:
    return windowed.select(
        F.col("w.start").alias("window_start"), "jobs", "succeeded", "failed",
        F.try_divide(F.col("succeeded"), F.col("succeeded") + F.col("failed")).alias("success_rate"),
        F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"),
    )

"""Filtered, ordered and paged views of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paging
from ..plans import export, upload
from ..schemas import AGG_COLUMNS, FACT_COLUMNS
from ..sources import ranges
from . import duck, inputs
from .aggregates import JOBS, jobs
from .registry import query
from .versions import _UPLOAD_ROWS, uploads

_LIST = f"{duck.FACT_LIST}, row_key"


def _period(spark, sf_dir):
    return paging.of_period(inputs.effective_facts(spark, sf_dir), inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)


@query("p8_period_rows", duck.with_facts(f"select {_LIST} from effective where {duck.PERIOD}"))
def period_rows(spark, sf_dir):
    return _period(spark, sf_dir).select(*FACT_COLUMNS, "row_key")


@query("p9_sku_search", duck.with_facts(f"select {_LIST} from effective where internal_sku like '%P1_-F%'"))
def sku_search(spark, sf_dir):
    return inputs.effective_facts(spark, sf_dir).where(paging.sku_like("P1_-F")).select(*FACT_COLUMNS, "row_key")


@query("p9_sku_search_nocase", duck.with_facts(f"select {_LIST} from effective where contains(lower(internal_sku), 'p12')"))
def sku_search_nocase(spark, sf_dir):
    return inputs.effective_facts(spark, sf_dir).where(paging.sku_contains("p12")).select(*FACT_COLUMNS, "row_key")


@query("p10_search_three_columns", duck.with_facts(
    f"select {_LIST} from effective where internal_sku like '%99%' or fin_code like '%99%' or order_id like '%99%'"))
def search_three(spark, sf_dir):
    hit = paging.sku_like("99", paging.SEARCH_COLUMNS)
    return inputs.effective_facts(spark, sf_dir).where(hit).select(*FACT_COLUMNS, "row_key")


@query("o1_fact_page", duck.with_facts(
    f"select {_LIST} from effective where {duck.PERIOD} order by order_id, internal_sku, line_no, row_key limit 50 offset 20"))
def fact_page(spark, sf_dir):
    return paging.page(_period(spark, sf_dir), paging.FACT_ORDER, 50, 20).select(*FACT_COLUMNS, "row_key")


@query("o1_fact_page_all", duck.with_facts(
    f"select {_LIST} from effective order by order_id, internal_sku, line_no, row_key limit 1000 offset 3000"))
def fact_page_all(spark, sf_dir):
    return paging.page(inputs.effective_facts(spark, sf_dir), paging.FACT_ORDER, 1000, 3000).select(*FACT_COLUMNS, "row_key")


@query("o1_fact_page_after", duck.with_facts(
    f"select {_LIST} from effective where (order_id, internal_sku, line_no, row_key) > ('12', 'P1', 1, 'a') "
    "order by order_id, internal_sku, line_no, row_key limit 100"))
def fact_page_after(spark, sf_dir):
    rows = paging.page_after(inputs.effective_facts(spark, sf_dir), paging.FACT_ORDER, ("12", "P1", 1, "a"), 100)
    return rows.select(*FACT_COLUMNS, "row_key")


_AGG = f"platform, user_id, year, month, internal_sku, {duck.dbl(*duck.SUM_NAMES)}, record_count"


@query("o2_agg_page", duck.with_versions(
    f"select {_AGG} from totals where {duck.PERIOD} order by totals.internal_sku limit 100 offset 10"))
def agg_page(spark, sf_dir):
    """Of the effective totals of one month; no other month's folders are read."""
    book = inputs.ledger(spark, sf_dir)
    return paging.page(upload.totals(book, inputs.month_of(book)), paging.AGG_ORDER, 100, 10)


@query("o1_page_by_number", duck.with_facts(
    f"select {_LIST} from effective order by order_id, internal_sku, line_no, row_key limit 1000 offset 4500"))
def page_by_number(spark, sf_dir):
    """A page far from the start, from facts kept in that order: the ranges that hold it are read, no others."""
    facts = inputs.effective_facts(spark, sf_dir)
    root = inputs.written(spark, sf_dir, "ordered-facts", lambda f: ranges.write_ordered(facts, f, paging.FACT_ORDER, 2000))
    return ranges.page(spark, root, facts.schema, paging.FACT_ORDER, 1000, 4500).select(*FACT_COLUMNS, "row_key")


@query("o3_page_count", duck.with_facts(
    "select year, month, count(*) as total, cast(ceil(count(*) / 50) as bigint) as pages from effective group by all"))
def page_count(spark, sf_dir):
    _, size = paging.check_page(1, 50)
    return inputs.effective_facts(spark, sf_dir).groupBy("year", "month").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", paging.page_count(F.col("total"), size))


@query("o4_newest_uploads", f"{_UPLOAD_ROWS}\nselect id, user_id, uploaded_at, content_hash from u where user_id = 'src3' "
       "order by uploaded_at desc, id limit 20 offset 5")
def newest_uploads(spark, sf_dir):
    own = uploads(spark, sf_dir).where("user_id = 'src3'")
    return paging.newest_first(own, "uploaded_at", 20, 5).select("id", "user_id", "uploaded_at", "content_hash")


@query("o4_newest_jobs", f"with j as (select {duck.select(JOBS)} from events)\n"
       "select id, user_id, status, epoch_us(created_at) as created from j order by created_at desc, id limit 100")
def newest_jobs(spark, sf_dir):
    page = paging.newest_first(jobs(spark, sf_dir), "created_at", 100)
    return page.select("id", "user_id", "status", F.unix_micros("created_at").alias("created"))


@query("o5_sorted_by_amount", duck.with_rollup(
    f"select internal_sku, {duck.double('net_received_sum')} as net_received_sum, row_number() over "
    f"(order by net_received_sum desc, {', '.join(AGG_COLUMNS[:7])}) as place from rollup_rows"))
def sorted_by_amount(spark, sf_dir):
    rows = paging.sorted_by(inputs.stored_rollup(spark, sf_dir), "net_received_sum", True, ties=AGG_COLUMNS[:7])
    return inputs.placed(rows).select("internal_sku", "net_received_sum", "place")


@query("o5_sorted_by_locale", "select p_partkey, p_name, row_number() over (order by p_name collate en_us, p_partkey) as place from part")
def sorted_by_locale(spark, sf_dir):
    rows = paging.sorted_by(inputs.read(spark, sf_dir, "part"), "p_name", locale=True, ties=["p_partkey"])
    return inputs.placed(rows.select("p_partkey", "p_name"))


@query("o6_export_order", duck.with_facts(
    f"select {_LIST}, row_number() over (order by internal_sku, order_id, effective.line_no, row_key, source_line) as place from effective"))
def export_order(spark, sf_dir):
    facts = inputs.effective_facts(spark, sf_dir)
    return inputs.placed(export.canonical_order(facts, "fact", ["source_line"]).select(*FACT_COLUMNS, "row_key"))


@query("o7_job_by_id", f"with j as (select {duck.select(JOBS)} from events)\n"
       "select id, user_id, status, latency from j where id = 'job-77'")
def job_by_id(spark, sf_dir):
    return paging.by_id(jobs(spark, sf_dir), "job-77").select("id", "user_id", "status", "latency")

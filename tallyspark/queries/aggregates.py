"""Line numbers, totals, facets and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import row_hash, row_key
from ..operators import lines as line_ops
from ..operators import rollup, validate
from ..operators.paging import of_period, sku_like
from ..plans import upload
from ..schemas import AMOUNTS
from . import duck, inputs
from .registry import query

_ORDER = [("order_id", "concat('', l_orderkey)"), ("freight", "case when l_tax > 0.02 then floor(l_tax * l_extendedprice) / 100 else -1.5 end")]
_NUMBERED = ("with raw as (select row_number() over () as source_line, " + duck.select(_ORDER) + " from lineitem), "
             "n as (select *, cast(row_number() over w as integer) as line_no, "
             "cast(count(*) over (partition by order_id) as integer) as line_count, "
             "first_value(freight) over w as order_freight from raw "
             "window w as (partition by order_id order by source_line)), "
             "s as (select *, floor(order_freight * 100 + 0.5::double) as cents from n), "
             "e as (select *, floor(cents / line_count) as each from s), "
             "x as (select *, case when order_freight > 0 then (each + case when line_no <= cents - each * line_count "
             "then 1 else 0 end) / 100 else freight end as extra_charge from e)\n")


def _orders(spark, sf_dir):
    return inputs.derive(inputs.lineitem(spark, sf_dir), _ORDER)


@query("w1_w2_line_numbers", _NUMBERED + "select source_line, order_id, line_no, line_count from n")
def line_numbers(spark, sf_dir):
    numbered = line_ops.number_lines(_orders(spark, sf_dir), ["order_id"])
    return numbered.select("source_line", "order_id", "line_no", "line_count")


@query("w3_first_line_charges", _NUMBERED +
       "select source_line, case when line_no = 1 then freight else 0::double end as charge from n")
def first_line_charges(spark, sf_dir):
    numbered = line_ops.number_lines(_orders(spark, sf_dir), ["order_id"])
    return numbered.select("source_line", line_ops.on_first_line(F.col("freight")).alias("charge"))


@query("w4_freight_spread", _NUMBERED + "select source_line, order_id, line_no, order_freight, extra_charge from x")
def freight_spread(spark, sf_dir):
    spread = line_ops.spread_freight(_orders(spark, sf_dir), ["order_id"])
    return spread.select("source_line", "order_id", "line_no", "order_freight", "extra_charge")


@query("v8_freight_conserved", _NUMBERED +
       "select order_id, cast(sum(cast(extra_charge as decimal(18,2))) as double) as allocated, "
       "cast(max(cast(order_freight as decimal(18,2))) as double) as freight, "
       "sum(cast(extra_charge as decimal(18,2))) = max(cast(order_freight as decimal(18,2))) as conserved "
       "from x where order_freight > 0 group by order_id")
def freight_conserved(spark, sf_dir):
    return validate.freight_conserved(line_ops.spread_freight(_orders(spark, sf_dir), ["order_id"]), ["order_id"])


@query("v8_record_counts", duck.with_rollup(
    "select (select count(*) from facts) as fact_rows, cast((select sum(record_count) from rollup_rows) as bigint) as counted"))
def record_counts(spark, sf_dir):
    counted = inputs.stored_rollup(spark, sf_dir).agg(F.sum("record_count").alias("n"), F.lit(0).cast("bigint").alias("f"))
    rows = inputs.stored_facts(spark, sf_dir).agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("f"))
    return counted.unionByName(rows).agg(F.sum("f").alias("fact_rows"), F.sum("n").alias("counted"))


@query("g3_wide_sku_rollup", duck.with_facts(
    "select internal_sku, cast(sum(qty_sold) as double) as qty_sold, "
    + ", ".join(f"cast(sum({n}) as double) as sum_{n}" for n in duck.AMOUNTS[1:]) + " from facts group by internal_sku"))
def wide_rollup(spark, sf_dir):
    return rollup.wide_sku(inputs.stored_facts(spark, sf_dir), ["internal_sku"])


@query("g4_row_count", duck.with_facts(
    f"select count(*) as rows from effective where {duck.PERIOD} and internal_sku like '%P1%'"))
def row_count(spark, sf_dir):
    rows = of_period(inputs.effective_facts(spark, sf_dir), inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    return rows.where(sku_like("P1")).agg(F.count(F.lit(1)).alias("rows"))


def _summary_sql(where):
    return duck.with_facts(
        "select " + ", ".join(f"cast(sum({n}) as double) as total_{n}" for n in duck.AMOUNTS)
        + f", abs(sum({duck.NET}) - sum(net_received)) <= 0.02 as consistency_check, cast(null as varchar) as consistency_error "
        f"from effective{where}")


@query("g6_fact_summary", _summary_sql(""))
def fact_summary(spark, sf_dir):
    return rollup.fact_summary(inputs.effective_facts(spark, sf_dir))


@query("g6_fact_summary_inconsistent", duck.with_facts(
    "select " + ", ".join(f"cast(sum({n}) as double) as total_{n}" for n in duck.AMOUNTS[:-1])
    + f", cast(sum(net_received + 0.01) as double) as total_net_received, false as consistency_check, "
    f"'金额不一致: 计算值=' || {duck.short('sum(' + duck.NET + ')')} || ', 实际值=' || {duck.short('sum(net_received + 0.01)')} "
    f"|| ', 差异=' || {duck.short('abs(sum(' + duck.NET + ') - sum(net_received + 0.01))')} as consistency_error from effective"))
def inconsistent_summary(spark, sf_dir):
    facts = inputs.effective_facts(spark, sf_dir)
    off = (F.col("net_received") + F.lit(0.01).cast("decimal(18,2)")).cast("decimal(28,2)")
    return rollup.fact_summary(facts.withColumn("net_received", off))


@query("g7_agg_summary", duck.with_versions(
    "select " + ", ".join(f"cast(sum({n}) as double) as total_{n}" for n in duck.SUM_NAMES)
    + ", cast(sum(record_count) as bigint) as total_record_count, count(*) as sku_count, "
    "abs(sum(income_total_sum) - sum(fee_platform_comm_sum) - sum(fee_other_sum) - sum(net_received_sum)) <= 0.02 "
    "as consistency_check, cast(null as varchar) as consistency_error from totals"))
def agg_summary(spark, sf_dir):
    """Of the effective totals: what was uploaded again counts once."""
    return rollup.agg_summary(upload.totals(inputs.ledger(spark, sf_dir)))


@query("g8_totals_row", duck.with_facts(
    "select internal_sku, cast(grouping(internal_sku) as integer) as is_total, "
    + ", ".join(f"cast(sum({n}) as double) as {n}" for n in duck.AMOUNTS)
    + ", cast(sum(fee_platform_comm + fee_affiliate + fee_other) as double) as fees_total "
    "from facts group by rollup (internal_sku)"))
def totals_row(spark, sf_dir):
    return rollup.with_total_row(inputs.stored_facts(spark, sf_dir), "internal_sku")


_DATASETS = [
    ("user_id", "concat('U', l_suppkey % 3)"),
    ("platform", "case when l_partkey % 3 = 0 then 'xiaohongshu' when l_partkey % 3 = 1 then 'douyin' else 'wechat_video' end"),
    ("year", "cast(year(l_shipdate) as integer)"), ("month", "cast(month(l_shipdate) as integer)"),
    ("status", "case when l_returnflag = 'R' or year(l_shipdate) = 2001 then 'superseded' else 'active' end"),
]
_DATASET_ROWS = f"with d as (select {duck.select(_DATASETS)} from lineitem)"


@query("g9_facets", f"{_DATASET_ROWS}, a as (select * from d where user_id = 'U1' and status = 'active') "
       "select 'platform' as facet, platform as value from a group by 2 "
       "union all select 'year', year::varchar from a where platform = 'douyin' group by 2 "
       "union all select 'month', lpad(month::varchar, 2, '0') from a where platform = 'douyin' and year = 1998 group by 2")
def facets(spark, sf_dir):
    datasets = inputs.read(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _DATASETS])
    return rollup.facets(datasets, "U1", "douyin", 1998)


_DUPES = [
    ("platform", "'douyin'"), ("order_id", "concat('', l_orderkey)"), ("internal_sku", "concat('B', l_linestatus)"),
    ("fin_code", "concat('F', l_partkey)"),
    ("qty_sold", "case when l_linenumber = 5 then nullif(1.5, 1.5) else l_quantity - 30 end"),
    ("recv_customer", inputs.cents("l_extendedprice")),
    ("recv_platform", f"case when l_linenumber = 4 then nullif({inputs.cents('1.5')}, {inputs.cents('1.5')}) else {inputs.cents('l_tax * 10')} end"),
    ("extra_charge", inputs.cents("l_discount")), ("fee_platform_comm", inputs.cents("l_tax")),
    ("fee_affiliate", inputs.cents("0")), ("fee_other", inputs.cents("0.5")),
    ("net_received", inputs.cents("l_extendedprice * 2")),
]
_CHARGES = ("recv_customer", "recv_platform", "extra_charge", "fee_platform_comm", "fee_affiliate", "fee_other")


@query("g10_duplicate_merge", f"""with d as (select row_number() over () as source_line, {duck.select(_DUPES)} from lineitem),
k as (select *, concat_ws(':', platform, order_id, internal_sku, 'null') as row_key from d),
m as (select row_key, any_value(order_id) as order_id, any_value(internal_sku) as internal_sku, cast(null as integer) as line_no,
  arg_min(fin_code, source_line) as fin_code, min(source_line) as source_line,
  cast(max(coalesce(qty_sold, 0)) as decimal(28,2)) as qty_sold, {", ".join(f"sum(coalesce({n}, 0)) as {n}" for n in _CHARGES)},
  max(net_received) as one_net, count(*) as source_merge_count from k group by row_key),
n as (select *, case when source_merge_count = 1 then one_net else {duck.NET} end as net_received from m)
select row_key, fin_code, source_line, {duck.dbl(*duck.AMOUNTS)}, source_merge_count,
  case when source_merge_count > 1 then {duck.HASH} end as merged_hash from n""")
def duplicate_merge(spark, sf_dir):
    rows = inputs.derive(inputs.lineitem(spark, sf_dir), _DUPES).withColumn("line_no", F.lit(None).cast("int"))
    rows = rows.withColumn("qty_sold", F.col("qty_sold").cast("decimal(28,2)"))
    keyed = rows.withColumn(
        "row_key", row_key(F.col("platform"), F.col("order_id"), F.col("internal_sku"), F.col("line_no")))
    merged = rollup.merge_duplicates(keyed.withColumn("row_hash", row_hash()))
    return merged.select("row_key", "fin_code", "source_line", *AMOUNTS, "source_merge_count",
                         F.when(F.col("source_merge_count") > 1, F.col("row_hash")).alias("merged_hash"))


@query("g11_status_counts", duck.with_facts(
    "select job_id, validation_status, count(*) as rows from facts group by all"))
def status_counts(spark, sf_dir):
    return rollup.status_counts(inputs.wechat_facts(spark, sf_dir))


@query("g12_zero_lines", "select count(*) as rows, count(*) filter (l_linenumber - 1 = 0 or l_quantity - 1 = 0) as zero_line_rows, "
       "count(*) - count(*) filter (l_linenumber - 1 = 0 or l_quantity - 1 = 0) as nonzero_line_rows from lineitem")
def zero_lines(spark, sf_dir):
    lines = inputs.read(spark, sf_dir, "lineitem")
    return rollup.zero_lines(lines.select(
        (F.col("l_linenumber") - 1).alias("line_no"), (F.col("l_quantity") - 1).alias("line_count")))


@query("g14_quality_metrics", duck.with_facts(
    f"select year, month, count(*) as rows, count(*) filter (abs({duck.NET} - net_received) > 0.02) as identity_failures, "
    "avg(case when internal_sku = '' then 1.0::double else 0.0::double end) as empty_sku_ratio from facts group by all"))
def quality_metrics(spark, sf_dir):
    return validate.quality_metrics(inputs.stored_facts(spark, sf_dir), ["year", "month"])


JOBS = [
    ("id", "concat('job-', event_id)"), ("user_id", "concat('U', user_id)"), ("created_at", "cast(ts as timestamp)"),
    ("status", "case when event_type = 'purchase' then 'completed' when event_type = 'view' then 'succeeded' "
               "when event_type = 'error' then 'failed' when event_type = 'click' then 'processing' else 'queued' end"),
    ("latency", "cast(floor(value * 1000 + 0.5) as bigint)"),
]


def jobs(spark, sf_dir):
    return inputs.read(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in JOBS])


def operations_sql(width):
    return (f"with j as (select {duck.select(JOBS)} from events) "
            f"select epoch_us(time_bucket(interval '{width}', created_at)) as window_start, count(*) as jobs, "
            "count(*) filter (status in ('completed', 'succeeded')) as succeeded, count(*) filter (status = 'failed') as failed, "
            "count(*) filter (status in ('completed', 'succeeded')) / nullif(count(*) filter (status in ('completed', 'succeeded', 'failed')), 0) "
            "as success_rate, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.95) as p95, "
            "quantile_disc(latency, 0.99) as p99 from j group by 1")


@query("g15_operations_per_minute", operations_sql("1 minute"))
def operations_per_minute(spark, sf_dir):
    return rollup.operations(jobs(spark, sf_dir)).withColumn("window_start", F.unix_micros("window_start"))


@query("g15_operations_per_day", operations_sql("1 day"))
def operations_per_day(spark, sf_dir):
    return rollup.operations(jobs(spark, sf_dir), "1 day").withColumn("window_start", F.unix_micros("window_start"))


_RANKS = ", ".join(f"cast(true as boolean) as p{p}_near" for p in (50, 95, 99))


@query("g15_day_from_minutes", f"""with j as (select {duck.select(JOBS)} from events)
select epoch_us(time_bucket(interval '1 day', created_at)) as window_start, count(*) as jobs,
  count(*) filter (status in ('completed', 'succeeded')) as succeeded, count(*) filter (status = 'failed') as failed, {_RANKS}
from j group by 1""")
def day_from_minutes(spark, sf_dir):
    """Days put together from stored minutes, whose sketches stand for the jobs; each percentile's rank among the day's jobs is
    near what it should be: within 2 percent, and a job of rounding."""
    folder = inputs.written(spark, sf_dir, "minutes", lambda f: rollup.operation_sketches(jobs(spark, sf_dir)).write.parquet(f))
    days = rollup.merged_operations(spark.read.parquet(folder))
    exact = jobs(spark, sf_dir).select(F.window("created_at", "1 day")["start"].alias("window_start"), "latency")
    parts = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ranked = exact.join(days.select("window_start", *[n for n, _ in parts]), "window_start").groupBy("window_start").agg(
        F.count("latency").alias("n"), *[F.count_if(F.col("latency") <= F.col(n)).alias(f"{n}_upto") for n, _ in parts],
        *[F.count_if(F.col("latency") < F.col(n)).alias(f"{n}_below") for n, _ in parts])
    slack = F.lit(0.02) * F.col("n") + 1
    near = [((F.col(f"{n}_below") <= q * F.col("n") + slack) & (F.col(f"{n}_upto") >= q * F.col("n") - slack)).alias(f"{n}_near") for n, q in parts]
    return days.join(ranked.select("window_start", *near), "window_start").select(
        F.unix_micros("window_start").alias("window_start"), "jobs", "succeeded", "failed", *[f"{n}_near" for n, _ in parts])


@query("v9_number_checks", "with c as (select row_number() over () as source_line, concat('', l_orderkey) as order_id, "
       "case when l_linenumber = 7 then '' else 'x' end as sku, case when l_linenumber = 1 then null else l_quantity end as q, "
       "case when l_linenumber = 2 then null else l_tax end as f from lineitem) "
       "select source_line, case when sku = '' then 'SKU编码不能为空' when q is null then '数量必须是数字' when f is null "
       "then '其他费用必须是数字' end as message from c")
def number_checks(spark, sf_dir):
    lines = inputs.lineitem(spark, sf_dir)
    nan = F.lit(float("nan"))
    rows = lines.select(
        "source_line", F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.lit("x")).alias("internal_sku"),
        F.when(F.col("l_linenumber") == 1, nan).otherwise(F.col("l_quantity")).alias("qty_sold"),
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.col("l_tax")).alias("fee_other"),
        *[F.lit(0.0).alias(n) for n in AMOUNTS if n not in ("qty_sold", "fee_other")])
    return rows.select("source_line", validate.number_message().alias("message"))

"""The main path: raw sheet to facts to roll-up, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import export_text
from ..operators import paging, rollup, validate
from ..plans import export, formula, mapping, upload
from ..schemas import AGG_COLUMNS, AGG_HEADERS, AMOUNTS, FACT_COLUMNS, FACT_HEADERS, META_COLUMNS, RELATIONAL_FACT
from ..session import new_folder
from ..sources import records, store
from . import duck, inputs
from .registry import query

FACT_ROWS = [c for c in (*FACT_COLUMNS, *META_COLUMNS) if c != "source_file"]
ALL_FACTS = duck.with_facts(f"select {duck.FACT_LIST}, {duck.META_LIST} from facts")


@query("p5_wechat_formula_facts", ALL_FACTS)
def formula_facts(spark, sf_dir):
    return inputs.wechat_facts(spark, sf_dir).select(*FACT_ROWS)


@query("k1_fact_sink", ALL_FACTS)
def fact_sink(spark, sf_dir):
    return inputs.stored_facts(spark, sf_dir).select(*FACT_ROWS)


@query("g1_month_sku_rollup", duck.with_rollup(
    "select platform, user_id, upload_id, job_id, year, month, internal_sku, "
    f"{duck.dbl(*duck.SUM_NAMES)}, record_count from rollup_rows"))
def month_sku_rollup(spark, sf_dir):
    return rollup.month_sku(inputs.wechat_facts(spark, sf_dir)).select(*AGG_COLUMNS)


@query("k2_agg_sink", duck.with_rollup(
    "select platform, user_id, upload_id, job_id, year, month, internal_sku, "
    f"{duck.dbl(*duck.SUM_NAMES)}, record_count from rollup_rows"))
def agg_sink(spark, sf_dir):
    return inputs.stored_rollup(spark, sf_dir)


_SMALL = " and ".join(f"abs({n}) < 99999999.995" for n in duck.AMOUNTS[1:])
_RELATIONAL = f"qty_sold = floor(qty_sold) and abs(qty_sold) < 2147483648 and {_SMALL}"


@query("k3_relational_sink", duck.with_facts(
    "select 'wechat_video' as platform, 'ULP-9' as upload_id, 'job-9' as job_id, year, month, order_id, line_count, line_no, "
    "internal_sku, fin_code, cast(qty_sold as integer) as qty_sold, "
    + ", ".join(f"{duck.double(n)} as {n}" for n in duck.AMOUNTS[1:])
    + f", '' as source_file, source_line from facts where {_RELATIONAL}"))
def relational_sink(spark, sf_dir):
    folder = new_folder(spark, "relational")
    rows, _ = mapping.relational(inputs.stored_facts(spark, sf_dir), "wechat_video", "ULP-9", "job-9")
    rows.write.parquet(folder)
    return spark.read.schema(RELATIONAL_FACT).parquet(folder)


@query("k3_relational_rejects", duck.with_facts(
    f"select source_line, order_id, {duck.dbl(*duck.AMOUNTS)} from facts where not ({_RELATIONAL})"))
def relational_rejects(spark, sf_dir):
    _, rejects = mapping.relational(inputs.stored_facts(spark, sf_dir), "wechat_video", "ULP-9", "job-9")
    return rejects.select("source_line", "order_id", *AMOUNTS)


@query("k3_relational_rollup", duck.with_rollup(
    "select 'wechat_video' as platform, 'ULP-9' as upload_id, 'job-9' as job_id, year, month, internal_sku, "
    + ", ".join(f"{duck.double(n)} as {n}" for n in duck.SUM_NAMES)
    + ", cast(record_count as integer) as record_count from rollup_rows where "
    + " and ".join(f"abs({n}) < 9999999999.995" for n in duck.SUM_NAMES)))
def relational_rollup(spark, sf_dir):
    rows, _ = mapping.relational_rollup(inputs.stored_rollup(spark, sf_dir), "wechat_video", "ULP-9", "job-9")
    return rows


_NUMBER_CELL = "case when {0} = floor({0}) then cast(cast({0} as hugeint) as varchar) else cast({0} as varchar) end"


@query("k4_csv_export", duck.with_facts(
    "select concat_ws(',', year, month, order_id, line_count, line_no, internal_sku, fin_code, "
    + ", ".join(_NUMBER_CELL.format(n) for n in duck.AMOUNTS) + ") as line from effective "
    f"union all select '{','.join(FACT_HEADERS)}'"))
def csv_export(spark, sf_dir):
    folder = new_folder(spark, "export")
    facts = inputs.effective_facts(spark, sf_dir)
    export.export_csv(export.fact_export(facts, inputs.YEAR, inputs.MONTH), folder)
    lines = spark.read.text(folder).select(F.col("value").alias("line"))
    # Every part file starts with the header; one copy of it is enough here.
    header = lines.where(F.col("line").startswith("年,")).distinct()
    return lines.where(~F.col("line").startswith("年,")).unionAll(header)


@query("k5_fact_export", duck.with_facts(
    "select " + ", ".join(f'{duck.double(n) if n in AMOUNTS else n} as "{h}"' for h, n in FACT_HEADERS.items()) + " from effective"))
def fact_export(spark, sf_dir):
    return export.fact_export(inputs.effective_facts(spark, sf_dir), inputs.YEAR, inputs.MONTH)


@query("k6_agg_export", duck.with_versions(
    "select " + ", ".join(f'{n if n == "internal_sku" else duck.double(n)} as "{h}"' for h, n in AGG_HEADERS.items())
    + " from totals"))
def agg_export(spark, sf_dir):
    return export.agg_export(upload.totals(inputs.ledger(spark, sf_dir)))


@query("k7_public_columns", duck.with_facts(f"select {duck.FACT_LIST} from effective"))
def public_columns(spark, sf_dir):
    return export.public_columns(inputs.effective_facts(spark, sf_dir))


@query("k8_sheet_export", duck.with_facts(f"select {duck.FACT_LIST} from effective"))
def sheet_export(spark, sf_dir):
    """All rows in canonical order, split into files of one sheet, read back."""
    folder = new_folder(spark, "sheets")
    facts = inputs.effective_facts(spark, sf_dir)
    ordered = export.canonical_order(facts, "fact")
    export.write_csv(export.csv_text(export.public_columns(ordered).select(*FACT_COLUMNS)), folder)
    kinds = ", ".join(f"{n} {'double' if n in AMOUNTS else facts.schema[n].dataType.simpleString()}" for n in FACT_COLUMNS)
    back = spark.read.schema(kinds).option("header", True).csv(folder)
    return back.fillna("", ["order_id", "internal_sku", "fin_code"])


@query("k9_golden_csv", duck.with_versions(
    "select concat_ws(',', '\"' || internal_sku || '\"', '\"' || platform || '\"', "
    "cast(cast(year as decimal(18,2)) as varchar), cast(cast(month as decimal(18,2)) as varchar), "
    + ", ".join(f"cast(cast({n} as decimal(38,2)) as varchar)" for n in (*duck.SUM_NAMES, "record_count"))
    + ") as line from totals"))
def golden_csv(spark, sf_dir):
    folder = new_folder(spark, "golden")
    rolled = upload.totals(inputs.ledger(spark, sf_dir))
    export.golden_csv(rolled.select("internal_sku", "platform", "year", "month", *duck.SUM_NAMES, "record_count"), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("k10_warnings_sink", duck.with_facts(
    "select job_id, source_line, message from facts where message is not null"))
def warnings_sink(spark, sf_dir):
    folder = new_folder(spark, "warnings")
    facts = inputs.stored_facts(spark, sf_dir).where("validation_status <> 'ok'")
    message = F.get_json_object("validation_warnings", "$[0]")
    records.write_warnings(facts.select("job_id", "source_line", message.alias("message")), folder)
    return spark.read.schema("job_id string, source_line bigint, message string").json(folder)


@query("p7_stamped_facts", duck.with_facts(
    "select platform, user_id, job_id, upload_id, row_key, row_hash from facts"))
def stamped(spark, sf_dir):
    return inputs.wechat_facts(spark, sf_dir).select(
        "platform", "user_id", "job_id", "upload_id", "row_key", "row_hash")


@query("p18_rejected_rows", duck.with_facts(
    "select source_line, order_raw as order_id, line_count, line_no, '金额超出范围' as message, bi as price, bm as quantity "
    "from flagged where failed"))
def rejected_rows(spark, sf_dir):
    rows = formula.formula_rejects(inputs.wechat_raw(spark, sf_dir))
    return rows.select("source_line", "order_id", "line_count", "line_no", "message",
                       F.col("cells")[formula.HEADERS["BI"]].alias("price"), F.col("cells")[formula.HEADERS["BM"]].alias("quantity"))


@query("s3_partition_scan", duck.with_facts(
    f"select {duck.FACT_LIST}, row_key from facts where {duck.PERIOD}"))
def partition_scan(spark, sf_dir):
    facts = inputs.stored_facts(spark, sf_dir)
    rows = paging.of_period(facts, inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    return rows.select(*FACT_COLUMNS, "row_key")


@query("s4_multi_job_scan", duck.with_facts(
    "select job_id, year, month, count(*) as n, cast(sum(net_received) as double) as net from facts "
    "where job_id in ('job-0', 'job-1') group by all"))
def multi_job_scan(spark, sf_dir):
    rows = store.of_jobs(inputs.stored_facts(spark, sf_dir), ["job-0", "job-1"])
    return rows.groupBy("job_id", "year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_received").alias("net"))


@query("s5_small_files", duck.with_facts(
    "select year, month, count(*) as n from facts group by all union all select 1, 1, 1"))
def small_files(spark, sf_dir):
    """A file of one row and one of none count like any other."""
    root = new_folder(spark, "uneven")
    facts = inputs.stored_facts(spark, sf_dir)
    store.write_facts(facts, root)
    one = spark.range(1).select(*[F.lit(1 if n in ("year", "month") else None).cast(facts.schema[n].dataType).alias(n)
                                  for n in facts.columns]).fillna("x", [*store.PARTITIONS])
    store.write_facts(one, root)
    one.limit(0).write.mode("append").parquet(f"{root}/user_id=x/platform=x/year=1/month=1/job_id=none")
    return store.read_facts(spark, root).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("s6_missing_path", duck.with_facts("select platform, count(*) as n from facts group by all"))
def missing_path(spark, sf_dir):
    nothing = store.read_facts(spark, new_folder(spark, "never-written"))
    both = nothing.unionByName(inputs.stored_facts(spark, sf_dir))
    return both.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("s7_single_job_scan", duck.with_facts(
    f"select {duck.FACT_LIST}, job_id from facts where job_id = 'job-1'"))
def single_job_scan(spark, sf_dir):
    return store.of_jobs(inputs.stored_facts(spark, sf_dir), ["job-1"]).select(*FACT_COLUMNS, "job_id")


@query("s10_append_load", duck.with_facts(
    "select user_id, count(*) as n, cast(sum(net_received) as double) as net from facts group by all"))
def append_load(spark, sf_dir):
    table = "loaded_" + new_folder(spark, "x").rsplit("-", 1)[1]
    for user in ("U0", "U1"):
        part = new_folder(spark, "part")
        inputs.stored_facts(spark, sf_dir).where(F.col("user_id") == user).write.parquet(part)
        store.append_parquet(spark, part, table, new_folder(spark, "table") if user == "U0" else None)
    return spark.table(table).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_received").alias("net"))


@query("u1_union_of_jobs", duck.with_facts(
    "select job_id, internal_sku, count(*) as n, cast(sum(qty_sold) as double) as qty from facts group by all"))
def union_of_jobs(spark, sf_dir):
    root = inputs.fact_root(spark, sf_dir)
    # Folders of single jobs carry no partition values of their own, hence the base path.
    jobs = [
        store.read_jobs(spark, root, job) for job in ("job-0", "job-1")
    ]
    return jobs[0].unionByName(jobs[1]).groupBy("job_id", "internal_sku").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty_sold").alias("qty"))


@query("v5_rollup_identity", duck.with_rollup(
    "select internal_sku, year, month, user_id, job_id, "
    "abs(income_total_sum - fee_platform_comm_sum - fee_other_sum - net_received_sum) <= 0.02 as identity_ok "
    "from rollup_rows"))
def rollup_identity(spark, sf_dir):
    rolled = inputs.stored_rollup(spark, sf_dir)
    return rolled.select(
        "internal_sku", "year", "month", "user_id", "job_id", validate.sums_identity().alias("identity_ok"))


@query("e16_export_text", duck.with_facts(
    "select row_key, source_line, " + _NUMBER_CELL.format("net_received") + " as cell from effective"))
def export_cells(spark, sf_dir):
    return inputs.effective_facts(spark, sf_dir).select(
        "row_key", "source_line", export_text(F.col("net_received")).alias("cell"))



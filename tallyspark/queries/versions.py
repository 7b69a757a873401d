"""Merging by key and hash, uploads, jobs and dataset records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import versions
from ..operators.paging import of_period
from ..operators.validate import duplicate_keys, record_problems as find
from ..plans import upload
from ..schemas import (
    AGG_UNIQUE, DATASET_RECORD, DATASET_ROW_RECORD, FACT_COLUMNS, FACT_TABLE, FACT_UNIQUE, UPLOAD_RECORD,
)
from ..session import new_folder
from ..sources.ledger import Ledger
from ..sources.records import read_records
from . import duck, inputs
from .aggregates import JOBS
from .registry import query

# The row index: every line was appended once, in file order; keys repeat, so later lines replace earlier ones.
_LOG = [
    ("dataset_id", "concat('dataset-', l_suppkey % 4)"), ("upload_id", "concat('ULP-', l_returnflag)"),
    ("row_key", "concat_ws(':', 'douyin', l_orderkey, concat('B', l_partkey % 5))"),
    ("row_hash", "concat('h', cast(l_quantity as bigint) % 7)"),
]
# A second upload of the same lines: some unchanged, some with another quantity, some with a new key.
_INCOMING = [
    ("dataset_id", "concat('dataset-', l_suppkey % 4)"), ("upload_id", "'ULP-new'"),
    ("row_key", "concat_ws(':', 'douyin', l_orderkey, concat('B', case when l_linenumber = 6 then 9 else l_partkey % 5 end))"),
    ("row_hash", "concat('h', (cast(l_quantity as bigint) + case when l_linenumber = 1 then 1 else 0 end) % 7)"),
]
_BASE = f"""with log as (select row_number() over () as seq, {duck.select(_LOG)} from lineitem),
incoming as (select row_number() over () + 1000000000000 as seq, {duck.select(_INCOMING)} from lineitem),
latest as (select dataset_id, row_key, arg_max(upload_id, seq) as upload_id, arg_max(row_hash, seq) as row_hash, max(seq) as seq
  from log group by 1, 2),
acted as (select i.*, case when l.row_key is null then 'inserted' when l.row_hash <> i.row_hash then 'updated' else 'unchanged' end as action
  from incoming i left join latest l on i.dataset_id = l.dataset_id and i.row_key = l.row_key)"""


def log(spark, sf_dir):
    return inputs.derive(inputs.lineitem(spark, sf_dir), _LOG).select(
        F.col("source_line").alias("seq"), *[n for n, _ in _LOG])


def incoming(spark, sf_dir):
    return inputs.derive(inputs.lineitem(spark, sf_dir), _INCOMING).select(
        (F.col("source_line") + 1_000_000_000_000).alias("seq"), *[n for n, _ in _INCOMING])


@query("j4_merge_stats", f"{_BASE}\nselect action, count(*) as rows from acted group by action")
def merge_stats(spark, sf_dir):
    return versions.merge_stats(incoming(spark, sf_dir), log(spark, sf_dir))


@query("j5_w5_effective_rows", f"{_BASE}\nselect * from latest")
def effective_rows(spark, sf_dir):
    return versions.effective_rows(log(spark, sf_dir))


@query("j6_existing_rows", f"{_BASE}\nselect i.* from incoming i join latest l on i.dataset_id = l.dataset_id "
       "and i.row_key = l.row_key and i.row_hash = l.row_hash")
def existing_rows(spark, sf_dir):
    return versions.existing_rows(incoming(spark, sf_dir), log(spark, sf_dir))


@query("u2_merge_upsert", f"""{_BASE}, merged as (select seq, dataset_id, upload_id, row_key, row_hash from log union all
  select seq, dataset_id, upload_id, row_key, row_hash from acted where action <> 'unchanged')
select dataset_id, row_key, arg_max(upload_id, seq) as upload_id, arg_max(row_hash, seq) as row_hash, max(seq) as seq
from merged group by 1, 2""")
def merge_upsert(spark, sf_dir):
    return versions.effective_rows(versions.merge_upsert(log(spark, sf_dir), incoming(spark, sf_dir)))


@query("g5_view_uploads", f"{_BASE}\nselect distinct dataset_id, upload_id from latest")
def view_uploads(spark, sf_dir):
    return versions.view_uploads(versions.effective_rows(log(spark, sf_dir)))


@query("s13_view_report", f"{_BASE}\nselect dataset_id, count(*) as row_count, count(distinct upload_id) as uploads from latest group by 1")
def view_report(spark, sf_dir):
    return versions.view_report(versions.effective_rows(log(spark, sf_dir)), ["dataset_id"])


_UPLOADS = [("id", "concat('ULP-', doc_id)"), ("user_id", "source"), ("platform", "lang"), ("file_type", "'settlement'"),
            ("uploaded_at", "doc_id * 60")]
_UPLOAD_ROWS = f"with u as (select {duck.select(_UPLOADS)}, sha256(text) as content_hash from documents)"
_UPLOAD_KEY = ["user_id", "platform", "file_type", "content_hash"]


def uploads(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents")
    return documents.select(*[F.expr(e).alias(n) for n, e in _UPLOADS], F.sha2("text", 256).alias("content_hash"))


@query("j9_w6_upload_duplicates", f"{_UPLOAD_ROWS}\nselect id, first_value(id) over w as first_id, "
       "row_number() over w > 1 as is_duplicate from u window w as (partition by user_id, platform, file_type, content_hash "
       "order by uploaded_at, id)")
def upload_duplicates(spark, sf_dir):
    marked = versions.mark_duplicates(uploads(spark, sf_dir), _UPLOAD_KEY, ["uploaded_at", "id"])
    return marked.select("id", "first_id", "is_duplicate")


@query("j9_content_duplicates", f"{_UPLOAD_ROWS}\nselect content_hash, count(*) as copies from u group by 1 having count(*) > 1")
def content_duplicates(spark, sf_dir):
    return duplicate_keys(uploads(spark, sf_dir), ["content_hash"]).withColumnRenamed("rows", "copies")


_PERIOD = [("user_id", "concat('U', user_id)"), ("dataset_id", "case when user_id % 10 = 3 then nullif('', '') else concat('dataset-', user_id) end")]
_JOB_COLUMNS = [(n, f"case when user_id % 7 = 2 then nullif('', '') else {e} end" if n == "status" else e)
                for n, e in JOBS if n != "user_id"] + _PERIOD  # some jobs have no status
_JOB_ROWS = (f"with j as (select {duck.select(_JOB_COLUMNS)} from events), "
             "d as (select distinct concat('dataset-', user_id) as dataset_id from events where user_id % 2 = 0)")


def _jobs(spark, sf_dir):
    return inputs.read(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in _JOB_COLUMNS])


@query("j11_g13_job_backfill", f"""{_JOB_ROWS}, done as (select distinct dataset_id, id as job_id from j
  where (coalesce(status, '') in ('', 'completed', 'succeeded')) and dataset_id <> '')
select dataset_id, job_id, max(job_id) over (partition by dataset_id) as latest_job_id,
  count(*) over (partition by dataset_id) as job_count from done where dataset_id in (select dataset_id from d)""")
def job_backfill(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumnRenamed("id", "job_id")
    datasets = inputs.read(spark, sf_dir, "events").where("user_id % 2 = 0").select(
        F.concat(F.lit("dataset-"), F.col("user_id").cast("string")).alias("dataset_id"))
    return versions.job_backfill(jobs, datasets)


# One record per user, platform and month, in stored order; some ids are stored more than once.
_RECORDS = [
    ("seq", "o_orderkey"), ("user_id", "concat('U', o_custkey)"),
    ("platform", "case when o_orderkey % 2 = 0 then 'douyin' else 'xiaohongshu' end"),
    ("year", "cast(year(o_orderdate) as integer)"), ("month", "cast(month(o_orderdate) as integer)"),
    ("upload_id", "concat('ULP-', o_orderkey)"),
    ("status", "case when o_orderstatus = 'F' then 'superseded' else 'active' end"),
    ("created_at", "concat('', cast(o_orderdate as date))"), ("updated_at", "concat('', cast(o_orderdate as date))"),
    ("job_id", "concat('job-', o_orderkey)"),
]
_ID = "'dataset-' || substr(sha256(concat_ws(':', user_id, platform, year, month)), 1, 8)"
_RECORD_ROWS = f"r as (select *, {_ID} as id from (select {duck.select(_RECORDS)} from orders))"


def records(spark, sf_dir):
    plain = inputs.read(spark, sf_dir, "orders").select(
        *[F.expr(e).alias(n) for n, e in _RECORDS])
    return plain.withColumn("id", keys.dataset_id(F.col("user_id"), F.col("platform"), F.col("year"), F.col("month")))


_FIELDS = [n for n, _ in _RECORDS]


@query("w7_first_record_per_id", f"with {_RECORD_ROWS}\nselect id, {', '.join(_FIELDS)} from (select *, row_number() over "
       "(partition by id order by seq) as rn from r) where rn = 1")
def first_records(spark, sf_dir):
    return versions.first_rows(records(spark, sf_dir), ["id"], ["seq"])


@query("j3_active_datasets", f"with {_RECORD_ROWS}, q as (select distinct concat('U', c_custkey) as user_id, 'douyin' as platform, "
       "cast(1997 as integer) as year, cast(c_nationkey % 12 + 1 as integer) as month from customer)\n"
       "select r.id, r.seq from r join q using (user_id, platform, year, month) where status = 'active'")
def active_datasets(spark, sf_dir):
    requests = inputs.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"), F.lit("douyin").alias("platform"),
        F.lit(1997).alias("year"), (F.col("c_nationkey") % 12 + 1).cast("int").alias("month"))
    return versions.active_datasets(records(spark, sf_dir), requests).select("id", "seq")


def _catalog(spark, sf_dir, kind, table, schema):
    """Records written as JSON lines, once, and read with their schema."""
    folder = inputs.written(spark, sf_dir, kind, lambda f: table.write.json(f))
    return read_records(spark, folder, schema, lines=True)


@query("s8_upload_records", f"{_UPLOAD_ROWS}\nselect id, user_id, platform, file_type, content_hash, uploaded_at from u")
def upload_records(spark, sf_dir):
    stored = uploads(spark, sf_dir).select(
        "id", F.col("user_id").alias("userId"), "platform", F.col("file_type").alias("fileType"),
        F.col("content_hash").alias("contentHash"), F.timestamp_seconds("uploaded_at").alias("uploadedAt"))
    read = _catalog(spark, sf_dir, "upload-records", stored, UPLOAD_RECORD)
    return read.select("id", F.col("userId").alias("user_id"), "platform", F.col("fileType").alias("file_type"),
                       F.col("contentHash").alias("content_hash"), F.unix_seconds("uploadedAt").alias("uploaded_at"))


@query("s8_dataset_records", f"with {_RECORD_ROWS}\nselect id, user_id, platform, year, month, upload_id, status, job_id, "
       "epoch_us(cast(created_at as timestamp)) as created from r")
def dataset_records(spark, sf_dir):
    stored = records(spark, sf_dir).select(
        "id", F.col("user_id").alias("userId"), "platform", "year", "month", F.col("upload_id").alias("effectiveUploadId"),
        "status", F.to_timestamp("created_at").alias("createdAt"),
        F.struct(F.col("job_id").alias("jobId"), F.array("job_id").alias("jobIds")).alias("metadata"))
    read = _catalog(spark, sf_dir, "dataset-records", stored, DATASET_RECORD)
    job = versions.latest_job(F.col("metadata.jobId"), F.col("metadata.jobIds"))
    return read.select("id", F.col("userId").alias("user_id"), "platform", "year", "month",
                       F.col("effectiveUploadId").alias("upload_id"), "status", job.alias("job_id"),
                       F.unix_micros("createdAt").alias("created"))


@query("s8_index_records", f"{_BASE}\nselect dataset_id, upload_id, row_key, row_hash, count(*) as rows from log group by all")
def index_records(spark, sf_dir):
    stored = log(spark, sf_dir).select(
        F.col("dataset_id").alias("datasetId"), F.col("upload_id").alias("uploadId"), F.col("row_key").alias("rowKey"),
        F.col("row_hash").alias("rowHash"))
    read = _catalog(spark, sf_dir, "index-records", stored, DATASET_ROW_RECORD)
    return read.groupBy(
        F.col("datasetId").alias("dataset_id"), F.col("uploadId").alias("upload_id"), F.col("rowKey").alias("row_key"),
        F.col("rowHash").alias("row_hash")).agg(F.count(F.lit(1)).alias("rows"))


_AT = "2025-01-01"


@query("u6_upsert_datasets", f"""with {_RECORD_ROWS}, old as (select * from (select *, row_number() over (partition by id order by seq) as rn
  from r where month <> 12) where rn = 1),
fresh as (select * from r where month > 6),
new as (select * from (select *, row_number() over (partition by id order by seq desc) as rn from fresh) where rn = 1),
news as (select id, job_id, min(seq) as place from fresh group by all),
all_jobs as (select id, job_id, -1 as place from old union all select id, job_id, place from news where (id, job_id) not in (select (id, job_id) from old)),
lists as (select id, string_agg(job_id, ',' order by place) as job_ids from all_jobs group by id)
select coalesce(old.id, new.id) as id, coalesce(old.user_id, new.user_id) as user_id, coalesce(old.platform, new.platform) as platform,
  coalesce(old.year, new.year) as year, coalesce(old.month, new.month) as month, coalesce(new.upload_id, old.upload_id) as upload_id,
  case when new.id is not null then 'active' else old.status end as status, coalesce(old.created_at, '{_AT}') as created_at,
  case when new.id is not null then '{_AT}' else old.updated_at end as updated_at, coalesce(new.job_id, old.job_id) as job_id, job_ids
from old full join new on old.id = new.id join lists on lists.id = coalesce(old.id, new.id)""")
def upsert_datasets(spark, sf_dir):
    """Several incoming records of one id among them."""
    all_records = records(spark, sf_dir).withColumn("job_ids", F.array("job_id"))
    new = all_records.where("month > 6").select(
        "id", "seq", "user_id", "platform", "year", "month", "upload_id", "job_id", "job_ids")
    merged = versions.upsert_datasets(all_records.where("month <> 12"), new, F.lit(_AT))
    return merged.withColumn("job_ids", F.concat_ws(",", "job_ids"))


# The month that is cleared, of every user.
_HIT = "'dataset-' || substr(sha256(concat_ws(':', user_id, 'douyin', 1995, 3)), 1, 8)"


@query("u5_supersede", f"""with {_RECORD_ROWS}
select seq, case when id = {_HIT} then 'superseded' else status end as status,
  case when id = {_HIT} then '{_AT}' else updated_at end as updated_at,
  case when id = {_HIT} then '{_AT}' end as superseded_at, case when id = {_HIT} then 'manual-clear' end as superseded_by from r""")
def supersede(spark, sf_dir):
    stored = records(spark, sf_dir).withColumns(
        {"superseded_at": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string")})
    chosen = keys.dataset_id(F.col("user_id"), F.lit("douyin"), F.lit(1995), F.lit(3))
    done = versions.supersede(stored, chosen, F.lit("manual-clear"), F.lit(_AT))
    return done.select("seq", "status", "updated_at", "superseded_at", "superseded_by")


@query("u3_replace_period", duck.with_facts(
    f"select {duck.FACT_LIST}, job_id from facts where not ({duck.PERIOD}) "
    f"union all select {duck.FACT_LIST}, 'job-new' as job_id from facts where {duck.PERIOD} and internal_sku <> ''"))
def replace_period(spark, sf_dir):
    facts = inputs.stored_facts(spark, sf_dir)
    period = of_period(facts, inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    fresh = period.where("internal_sku <> ''").withColumn("job_id", F.lit("job-new"))
    return versions.replace_periods(facts, fresh).select(*FACT_COLUMNS, "job_id")


@query("u3_replace_partitions", duck.with_facts(
    f"select year, month, user_id, job_id, count(*) as rows from facts where not ({duck.PERIOD}) group by all "
    f"union all select year, month, user_id, 'job-new', count(*) from facts where {duck.PERIOD} and internal_sku <> '' group by all"))
def replace_partitions(spark, sf_dir):
    """A month brought again by a new job in replace mode: the ledger holds that job's rows alone."""
    book, facts = Ledger(spark, new_folder(spark, "replaced")), inputs.stored_facts(spark, sf_dir)
    upload.upload(book, facts, "first", placed=True)
    period = of_period(facts, inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    upload.upload(book, period.where("internal_sku <> ''").withColumn("job_id", F.lit("job-new")), "new", "replace", placed=True)
    return book.read("facts", FACT_TABLE).groupBy("year", "month", "user_id", "job_id").agg(
        F.count(F.lit(1)).alias("rows"))


@query("u4_clear_period", duck.with_facts(
    f"select year, month, user_id, job_id, count(*) as rows from facts where not ({duck.PERIOD}) group by all"))
def clear_period(spark, sf_dir):
    kept = versions.clear_period(
        inputs.stored_facts(spark, sf_dir), inputs.USER, inputs.PLATFORM, inputs.YEAR, inputs.MONTH)
    return kept.groupBy("year", "month", "user_id", "job_id").agg(F.count(F.lit(1)).alias("rows"))


@query("u4_clear_store", duck.with_facts(
    f"""select 'facts' as kind, job_id as name, count(*) as rows from facts where not ({duck.PERIOD}) group by all
union all select 'effective', job_id, count(*) from facts where not ({duck.PERIOD}) group by all
union all select 'index', upload_id, count(*) from facts where not ({duck.PERIOD}) group by all
union all select 'totals', user_id, count(*) from (select distinct user_id, platform, year, month, internal_sku from facts
  where not ({duck.PERIOD})) group by all
union all select 'datasets', case when {duck.PERIOD} then 'superseded' else 'active' end, count(*)
  from (select distinct user_id, platform, year, month from facts) group by all
union all select distinct 'cleared', job_id, 0 from facts where {duck.PERIOD}"""))
def clear_store(spark, sf_dir):
    """A month gone from facts, view, index and totals in one commit, its dataset superseded. The jobs behind it are returned."""
    book = Ledger(spark, new_folder(spark, "cleared"))
    upload.upload(book, inputs.stored_facts(spark, sf_dir), "first", placed=True)
    jobs = upload.clear(book, inputs.USER, inputs.PLATFORM, inputs.YEAR, inputs.MONTH, "clear")
    named = [("facts", book.read("facts", FACT_TABLE), "job_id"), ("effective", upload.effective(book), "job_id"),
             ("index", book.read("index", upload.INDEX), "upload_id"), ("totals", upload.totals(book), "user_id"),
             ("datasets", upload.datasets(book), "status")]
    found = spark.createDataFrame([("cleared", j, 0) for j in jobs], "kind string, name string, rows long")
    for kind, table, name in named:
        counted = table.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
        found = found.unionByName(counted.select(F.lit(kind).alias("kind"), "name", "rows"))
    return found


_TABLE = ("l_orderkey", "l_partkey", "l_returnflag")


@query("u7_table_difference", """with a as (select l_orderkey, l_partkey, l_returnflag from lineitem),
e as (select l_orderkey, l_partkey, case when l_linenumber = 7 then 'X' else l_returnflag end as l_returnflag from lineitem where l_linenumber <> 6),
b as (select *, 1 as x, 0 as y from a union all select *, 0, 1 from e)
select l_orderkey, l_partkey, l_returnflag, cast(sum(x) as bigint) as actual, cast(sum(y) as bigint) as expected from b group by 1, 2, 3
having sum(x) <> sum(y)""")
def table_difference(spark, sf_dir):
    lines = inputs.read(spark, sf_dir, "lineitem")
    changed = lines.where("l_linenumber <> 6").withColumn(
        "l_returnflag", F.when(F.col("l_linenumber") == 7, F.lit("X")).otherwise(F.col("l_returnflag")))
    return versions.table_difference(lines.select(*_TABLE), changed.select(*_TABLE))


@query("u7_line_difference", """with a as (select row_number() over () as line, concat_ws(',', l_orderkey, l_returnflag) as text from lineitem),
e as (select line, case when line % 100 = 0 then text || 'x' else text end as text from a where line % 1000 <> 1)
select a.line, a.text as actual, e.text as expected from a full join e on a.line = e.line where a.text is distinct from e.text""")
def line_difference(spark, sf_dir):
    actual = inputs.lineitem(spark, sf_dir).select(
        F.col("source_line").alias("line"), F.concat_ws(",", F.col("l_orderkey").cast("string"), "l_returnflag").alias("text"))
    expected = actual.where("line % 1000 <> 1").withColumn(
        "text", F.when(F.col("line") % 100 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return versions.line_difference(actual, expected)


_OLD = [
    ("id", "case when c_custkey % 5 = 0 then concat('old-', c_custkey) else concat('ULP-', c_custkey) end"),
    ("user_id", "c_mktsegment"), ("content_hash", "case when c_custkey % 3 = 0 then concat('n', c_custkey) when c_custkey % 3 = 1 then '' else nullif('', '') end"),
    ("contenthash", "concat('o', c_custkey)"), ("file_name", "case when c_custkey % 2 = 0 then concat(c_name, '.csv') else nullif('', '') end"),
    ("original_filename", "concat(c_name, '.orig.csv')"),
]


@query("u9_migrate_uploads", f"""with o as (select {duck.select(_OLD)} from customer)
select id, user_id, coalesce(nullif(content_hash, ''), contenthash) as content_hash, coalesce(nullif(file_name, ''), original_filename) as file_name,
  original_filename from o where starts_with(id, 'ULP-')""")
def migrate_uploads(spark, sf_dir):
    return versions.migrate_uploads(inputs.read(spark, sf_dir, "customer").select(*[F.expr(e).alias(n) for n, e in _OLD]))


@query("v11_record_problems", f"""with o as (select {duck.select(_OLD)} from customer)
select id, concat_ws(',', case when content_hash is null then 'content_hash' end, case when file_name is null then 'file_name' end, 'object_key') as missing,
  concat_ws(',', case when contenthash is not null then 'contenthash' end) as legacy, starts_with(id, 'ULP-') as id_ok from o""")
def record_problems(spark, sf_dir):
    stored = inputs.read(spark, sf_dir, "customer").select(*[F.expr(e).alias(n) for n, e in _OLD])
    found = find(stored, ["id", "user_id", "content_hash", "file_name", "object_key"], ["contenthash", "stored_path"], "ULP-")
    return found.select("id", F.concat_ws(",", "missing_fields").alias("missing"),
                        F.concat_ws(",", "legacy_fields").alias("legacy"), "id_ok")


def _with_seq(spark, sf_dir):
    """All rows of the three uploads, with the number of the commit that each would have."""
    made = [rows.withColumn("seq", F.lit(k).cast("long"))
            for k, (_, rows) in enumerate(inputs.uploads_of(inputs.stored_facts(spark, sf_dir)), 1)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("j5_effective_facts", duck.with_versions(f"select {duck.FACT_LIST}, job_id, row_key, source_line from latest"))
def effective_facts(spark, sf_dir):
    """What previews, summaries and exports read by default: of each key the row of the last commit, there of the last line."""
    return versions.effective_facts(_with_seq(spark, sf_dir)).select(*FACT_COLUMNS, "job_id", "row_key", "source_line")


@query("j5_effective_month", duck.with_versions(f"""select count(*) as rows, {duck.double('sum(qty_sold)')} as qty_sold,
  {duck.double('sum(net_received)')} as net_received from latest where {duck.PERIOD}"""))
def effective_month(spark, sf_dir):
    """Summary of a month with re-uploads: nothing counts twice."""
    month = of_period(_with_seq(spark, sf_dir), inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    return versions.effective_facts(month).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("qty_sold").alias("qty_sold"), F.sum("net_received").alias("net_received"))


@query("j5_ledger_view", duck.with_versions(f"select {duck.FACT_LIST}, job_id, row_key, row_hash, source_line from latest"))
def ledger_view(spark, sf_dir):
    """The effective view as three uploads have left it in a ledger."""
    return upload.effective(inputs.ledger(spark, sf_dir)).select(*FACT_COLUMNS, "job_id", "row_key", "row_hash", "source_line")


@query("j5_ledger_history", duck.with_versions(f"select {duck.FACT_LIST}, job_id, row_key, seq from latest where {duck.PERIOD}"))
def ledger_history(spark, sf_dir):
    """One month's view worked out anew from the facts of all uploads."""
    book = inputs.ledger(spark, sf_dir)
    return upload.history(book, inputs.month_of(book)).select(
        *FACT_COLUMNS, "job_id", "row_key", F.col("seq").cast("int").alias("seq"))


@query("j5_ledger_versions", duck.with_versions(f"""select v as version, count(*) as rows, {duck.double('sum(qty_sold)')} as qty_sold from
  (select v, qty_sold, row_number() over (partition by v, user_id, platform, year, month, row_key order by seq desc, source_line desc) as place
   from versions, (values (1), (2), (3)) as t(v) where seq <= v) where place = 1 group by v"""))
def ledger_versions(spark, sf_dir):
    """The view at each version: a reader of an earlier one goes on seeing it."""
    book = inputs.ledger(spark, sf_dir)
    shown = [upload.effective(book, version=v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    rows = shown[0].unionByName(shown[1]).unionByName(shown[2])
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("rows"), F.sum("qty_sold").alias("qty_sold"))


@query("g1_effective_totals", duck.with_versions(
    f"select user_id, platform, year, month, internal_sku, {duck.dbl(*duck.SUM_NAMES)}, record_count from totals"))
def effective_totals(spark, sf_dir):
    """Month by SKU sums kept by signed changes: what a re-upload took out of the view is taken out of the sums."""
    return upload.totals(inputs.ledger(spark, sf_dir))


@query("j4_ledger_merges", duck.with_versions("""select job_id, action, cast(sum(rows) as bigint) as rows from (
  select job_id, 'inserted' as action, count(*) as rows from facts group by 1
  union all select job_id, 'updated', count(*) from again group by 1 union all select job_id, 'updated', count(*) from twice group by 1)
  where rows > 0 group by 1, 2"""))
def ledger_merges(spark, sf_dir):
    """How many rows each upload inserted and updated, every row of it counted."""
    merges = inputs.ledger(spark, sf_dir).read("merges", upload.MERGES)
    return merges.groupBy("job_id", "action").agg(F.sum("rows").alias("rows"))


@query("v6_view_problems", duck.with_versions("select 0::bigint as problems, count(*) as rows from latest"))
def view_problems(spark, sf_dir):
    """Repeated keys of the effective view, and totals that are not its roll-up: none, though uploads repeat keys."""
    book = inputs.ledger(spark, sf_dir)
    problems = upload.check_view(book).select(F.lit(1).alias("problems"), F.lit(0).alias("rows"))
    rows = upload.effective(book).select(F.lit(0).alias("problems"), F.lit(1).alias("rows"))
    return problems.unionByName(rows).agg(F.sum("problems").alias("problems"), F.sum("rows").alias("rows"))


@query("v6_fact_keys_unique", duck.with_versions(
    """select 0::bigint as duplicates, count(*) as rows, (select count(*) from (select 1 from versions
  group by user_id, platform, year, month, order_id, internal_sku, line_no having count(*) > 1)) as brought_again from latest"""))
def fact_keys_unique(spark, sf_dir):
    """No key is twice in the effective view, though keys are among the uploads' facts."""
    book = inputs.ledger(spark, sf_dir)
    key = ["user_id", *FACT_UNIQUE]
    view = upload.effective(book)
    parts = [
        duplicate_keys(view, key).select(F.lit(1).alias("duplicates"), F.lit(0).alias("rows"), F.lit(0).alias("brought_again")),
        view.select(F.lit(0).alias("duplicates"), F.lit(1).alias("rows"), F.lit(0).alias("brought_again")),
        duplicate_keys(book.read("facts", FACT_TABLE), key).select(
            F.lit(0).alias("duplicates"), F.lit(0).alias("rows"), F.lit(1).alias("brought_again"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        *[F.sum(n).alias(n) for n in ("duplicates", "rows", "brought_again")])


@query("v6_duplicate_row_keys", f"{_BASE}\nselect dataset_id, row_key, count(*) as rows from log group by 1, 2 having count(*) > 1")
def duplicate_row_keys(spark, sf_dir):
    return duplicate_keys(log(spark, sf_dir), versions.KEY)


@query("v6_duplicate_agg_keys", duck.with_rollup(
    "select platform, year, month, internal_sku, count(*) as rows from rollup_rows group by all having count(*) > 1"))
def duplicate_agg_keys(spark, sf_dir):
    return duplicate_keys(inputs.stored_rollup(spark, sf_dir), AGG_UNIQUE)


@query("v10_tenant_rows", duck.with_facts(
    f"select user_id, count(*) as rows from facts where {duck.PERIOD} group by all"))
def tenant_rows(spark, sf_dir):
    rows = of_period(inputs.stored_facts(spark, sf_dir), inputs.PLATFORM, inputs.YEAR, inputs.MONTH, inputs.USER)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))

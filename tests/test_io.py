import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.rollup import merged_operations, operation_sketches
from tallyspark.operators.versions import bucketed_changes, effective_rows
from tallyspark.plans import export, upload
from tallyspark.schemas import AMOUNTS, FACT_TABLE, JOB_RECORD
from tallyspark.session import new_folder
from tallyspark.sources import quoted, ranges, records, store
from tallyspark.sources.ledger import Ledger
from tallyspark.streaming import jobs as stream_jobs


def fact_rows(spark, rows):
    """Facts with just the given (user, year, month, job, sku, net)."""
    frame = spark.createDataFrame(rows, "user_id string, year int, month int, job_id string, internal_sku string, net string")
    given = {"platform": F.lit("douyin"), "net_received": F.col("net").cast("decimal(18,2)")}
    frame = frame.withColumns(given)
    missing = [f for f in FACT_TABLE.fields if f.name not in frame.columns]
    return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*FACT_TABLE.fieldNames())


ROWS = [("u", 2024, 1, "j1", "a,b", "1.50"), ("u", 2024, 2, "j1", 'q"x', "2.00"), ("w", 2024, 1, "j2", "plain", None)]


def test_store_keeps_types_and_prunes(spark):
    root = new_folder(spark, "t")
    store.write_facts(fact_rows(spark, ROWS), root)
    back = store.read_facts(spark, root)
    assert set(back.columns) == set(FACT_TABLE.fieldNames())
    assert {f.name: f.dataType for f in back.schema} == {f.name: f.dataType for f in FACT_TABLE}
    one = back.where("user_id = 'u' and year = 2024 and month = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_id" in plan
    assert [r["internal_sku"] for r in one.collect()] == ["a,b"]
    assert {r["job_id"] for r in store.read_jobs(spark, root, "j2").collect()} == {"j2"}
    assert store.of_jobs(back, ["j1"]).count() == 2 and store.of_jobs(back, []).count() == 3
    assert store.small_files(spark, root, 10**9).count() == 3


def test_replacing_only_written_partitions(spark):
    root = new_folder(spark, "t")
    store.write_facts(fact_rows(spark, ROWS), root)
    store.write_facts(fact_rows(spark, [("u", 2024, 1, "j1", "new", "5")]), root, replace_only_written=True)
    assert sorted(r["internal_sku"] for r in store.read_facts(spark, root).collect()) == ["new", "plain", 'q"x']


def test_missing_path_is_empty(spark):
    nothing = store.read_facts(spark, new_folder(spark, "none"))
    assert nothing.count() == 0 and nothing.schema == FACT_TABLE
    assert store.read_table(spark, [], FACT_TABLE).count() == 0
    root = new_folder(spark, "some")
    fact_rows(spark, ROWS).write.parquet(root)
    assert store.read_table(spark, [root, new_folder(spark, "none")], FACT_TABLE).count() == len(ROWS)


def test_csv_quotes_only_where_needed(spark):
    folder = new_folder(spark, "csv")
    table = export.agg_export(
        spark.createDataFrame([("a,b", "1.50"), ('q"x', "2.00"), ("plain", "0.05"), (None, None)], "internal_sku string, v string")
        .withColumns({n: F.col("v").cast("decimal(28,2)") for n in (
            "qty_sold_sum", "income_total_sum", "fee_platform_comm_sum", "fee_other_sum", "net_received_sum")}))
    export.export_csv(table.coalesce(1), folder)
    lines = [r["value"] for r in spark.read.text(folder).collect()]
    assert lines[0].startswith("商品编码,销售数量合计")
    assert lines[1:] == ['"a,b"' + ",1.50" * 5, '"q""x"' + ",2" * 5, "plain" + ",0.05" * 5, "" + ",0" * 5]


def test_golden_lines(spark):
    folder = new_folder(spark, "golden")
    export.golden_csv(spark.createDataFrame([('Z"1', 2024, 1.5, None)], "sku string, y int, v double, n int"), folder)
    assert [r["value"] for r in spark.read.text(folder).collect()] == ['"Z""1",2024.00,1.50,']


def test_period_is_filled_in(spark):
    frame = spark.createDataFrame([(None, 0), (2020, 3)], "year int, month int")
    assert [tuple(r) for r in export.with_period(frame, 2024, 10).collect()] == [(2024, 10), (2020, 3)]


def test_files_are_split_by_rows(spark):
    folder = new_folder(spark, "split")
    export.write_csv(spark.range(25).selectExpr("cast(id as string) v").coalesce(1), folder, max_rows=10)
    assert len(spark.read.option("header", True).csv(folder).inputFiles()) == 3


def test_job_list(spark, tmp_path):
    job = {"id": "j", "status": "failed", "createdAt": "2023-02-14T08:30:15.250Z", "year": 2024, "month": 8,
           "fileObjects": {"settlement": "raw/x.csv"}, "metadata": {"jobIds": ["a", "b"]}}
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps([job, {**job, "id": "k"}]))
    rows = records.read_records(spark, str(path), JOB_RECORD).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["j", "k"]
    assert rows[0]["createdAt"].microsecond == 250000 and rows[0]["metadata"]["jobIds"] == ["a", "b"]


def test_inventory_and_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    files = records.file_inventory(spark, str(tmp_path)).collect()
    assert {r["file_name"] for r in files} == {"a.csv", "b.txt"} and len({r["content_hash"] for r in files}) == 1
    profile = records.table_profile(spark.createDataFrame([(1, None), (2, "x")], "a int, b string")).collect()
    assert [(r["column"], r["type"], r["rows"], r["filled"]) for r in profile] == [("a", "int", 2, 2), ("b", "string", 2, 1)]


def test_ingest_takes_each_file_once(spark):
    landing, root, staging, checkpoint = (new_folder(spark, n) for n in ("landing", "facts", "staged", "checkpoint"))
    header = ["订单号", "商品编码", "购买数量", "买家支付金额", "平台补贴", "附加费用", "平台服务费", "达人佣金", "其他费用", "结算金额"]

    def land(order):
        rows = [(order, "S1", "1", "10", "0", "0", "1", "0", "0", "9"), (order, "", "1", "10", "0", "0", "1", "0", "0", "9")]
        spark.createDataFrame(rows, header).coalesce(1).write.mode("append").option("header", True).csv(landing)

    def run(job="a", checkpoint=checkpoint):
        files = stream_jobs.landing_files(spark, landing, header)
        stream_jobs.ingest(files, root, f"{staging}-{job}", checkpoint, "douyin", "u", job, 2024, 10).awaitTermination()
        facts = Ledger(spark, root).read("facts", FACT_TABLE).collect()
        return sorted((r["order_id"], r["job_id"], r["source_line"]) for r in facts)

    land("o1")
    first = run()
    assert first == [("o1", "a-000000000", 2)] and run() == first
    land("o2")
    both = [("o1", "a-000000000", 2), ("o2", "a-000000001", 2)]
    assert run() == both
    warnings = spark.read.json(f"{root}/warnings").collect()  # the rows without a SKU
    assert sorted((r.job_id, r.source_line) for r in warnings) == [("a-000000000", 3), ("a-000000001", 3)]

    again = run("b", new_folder(spark, "checkpoint"))  # another checkpoint leaves the first job's facts alone
    assert set(both) < set(again) and {r[1] for r in again} == {"a-000000000", "a-000000001", "b-000000000"}
    shown = upload.effective(Ledger(spark, root)).collect()
    assert sorted((r.order_id, r.job_id) for r in shown) == [("o1", "b-000000000"), ("o2", "b-000000000")]


def test_sheets_split_without_loss(spark):
    folder = new_folder(spark, "sheets")
    export.write_csv(spark.range(2500).select(F.col("id").cast("string")).coalesce(1), folder, max_rows=1000)
    back = spark.read.option("header", True).csv(folder)
    sizes = sorted(r["count"] for r in back.groupBy(F.input_file_name()).count().collect())
    assert sizes == [500, 1000, 1000] and back.distinct().count() == 2500


def test_compaction_keeps_latest_values(spark):
    root = new_folder(spark, "totals")
    for batch, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("b", 3), ("c", 3)], [("a", 4)])):
        spark.createDataFrame(rows, "k string, n long").write.parquet(f"{root}/batch={batch}")
    before = sorted(map(tuple, stream_jobs.latest_values(spark, root, ["k"]).collect()))
    for _ in range(2):  # a repetition after a crash changes nothing
        stream_jobs.compact(spark, root, ["k"], 2)
        assert sorted(map(tuple, stream_jobs.latest_values(spark, root, ["k"]).collect())) == before
    assert {r.batch for r in spark.read.parquet(root).select("batch").distinct().collect()} == {2, 3}


def test_stream_upsert_ends_like_one_batch(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("source", "log", "checkpoint"))
    schema = "dataset_id string, upload_id string, row_key string, row_hash string, seq long"
    rows = [("d", "u", f"k{i % 5}", f"h{i % 3}", i) for i in range(40)]
    for part in (rows[:15], rows[15:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_jobs.upsert(stream, root, checkpoint).awaitTermination()
    log = stream_jobs.index_log(spark, root)
    for generation in (0, 1, 2):
        got = effective_rows(log.read()).collect()
        assert {r["row_key"]: r["row_hash"] for r in got} == {r[2]: r[3] for r in rows} and log.generation() == generation
        log.compact("seq")
    files = [f for f in log.read().inputFiles()]
    assert len(files) <= 5  # one a bucket and run


def test_merges_leave_the_bucketed_index_in_place(spark):
    """Only the incoming rows are shuffled; files of a batch do not grow with datasets."""
    root = new_folder(spark, "index")
    log = stream_jobs.index_log(spark, root, buckets=8)
    known = spark.range(4000).selectExpr("concat('d', id % 500) as dataset_id", "'u' as upload_id", "concat('k', id) as row_key",
                                         "concat('h', id % 3) as row_hash", "id as seq")
    log.append(known)
    assert len(log.read().inputFiles()) <= 8
    incoming = known.where("seq % 2 = 0").selectExpr("dataset_id", "upload_id", "row_key", "'h0' as row_hash", "seq + 10000 as seq")
    incoming = incoming.unionByName(incoming.selectExpr("'new' as dataset_id", "upload_id", "row_key", "row_hash", "seq").limit(7))
    changes = bucketed_changes(incoming, log.read())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = changes._jdf.queryExecution().executedPlan().toString()
        counted = {r["action"]: r["count"] for r in changes.groupBy("action").count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    side = plan[plan.index("SortMergeJoin"):]
    scan = next(line for line in side.splitlines() if "Bucketed: true" in line)
    above = side[: side.index(scan)].split("Range")[-1]
    assert "Exchange" not in above and "hashpartitioning(dataset_id" in plan
    assert counted == {"inserted": 7, "updated": known.where("seq % 2 = 0 and row_hash <> 'h0'").count()}


def test_unique_uploads_keep_the_first(spark):
    source, root, checkpoint = (new_folder(spark, n) for n in ("source", "uploads", "checkpoint"))
    schema = "id string, user_id string, content_hash string, at int"
    rows = [(f"ULP-{k}", f"u{k % 3}", None if k % 5 == 0 else f"h{k % 4}", k) for k in range(40)]
    for part in (rows[:9], rows[9:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_jobs.unique_uploads(stream, ["user_id", "content_hash"], ["at", "id"], root, checkpoint, buckets=4).awaitTermination()
    first = {}
    for i, user, digest, _ in rows:
        first.setdefault((user, digest), i)
    got = stream_jobs.uploads_log(spark, root, stream.schema, 4).read().collect()
    assert {(r.user_id, r.content_hash): r.id for r in got} == first and len(got) == len(first)


def test_pages_by_number_read_their_ranges_only(spark):
    root = new_folder(spark, "ordered")
    rows = [(k % 7 if k % 11 else None, k) for k in range(5000)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(5)
    ranges.write_ordered(table, root, ["a", "b"], 300)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert ranges.row_count(spark, root) == 5000
    sizes = set()
    for offset, limit in ((0, 50), (295, 10), (2500, 300), (4990, 50), (4999, 1), (5000, 10)):
        page = ranges.page(spark, root, table.schema, ["a", "b"], limit, offset)
        assert [tuple(r) for r in page.collect()] == want[offset: offset + limit]
        sizes.add(len(page.inputFiles()))
    assert max(sizes) <= 4
    ranges.write_ordered(table.limit(0), f"{root}-empty", ["a", "b"])
    assert ranges.page(spark, f"{root}-empty", table.schema, ["a", "b"], 10).count() == 0


def test_lookups_skip_row_groups(spark):
    """By their Bloom filters: the value's neighbours in order are everywhere, so that least and greatest values rule out none."""
    rows = spark.range(200_000).selectExpr("concat('k', (id * 7919) % 200000) as row_key", "id as v", "'u' as user_id").coalesce(1)

    def read(lookup):
        root = new_folder(spark, "looked-up")
        spark.conf.set("parquet.block.size", 200_000)
        spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 200_000)
        try:
            store.write_partitioned(rows, root, ["user_id"], lookup=lookup)
        finally:
            spark.conf.unset("parquet.block.size")
            spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        found = spark.read.parquet(root).where("row_key = 'k777'")
        values = [r.v for r in found.collect()]
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        return values, scan.metrics().get("numOutputRows").get().value()

    with_filter, without = read({"row_key": 200_000}), read(None)
    assert with_filter[0] == without[0] and len(with_filter[0]) == 1
    assert with_filter[1] < without[1] / 3


def test_quoted_sheets_are_read_in_splits(spark, tmp_path):
    """Line breaks, quotes and separators in cells; the same cells and line numbers as a plain reader gives, over many blocks."""
    pick = random.Random(4)
    words = ["a", 'say "hi"', "two\nlines", "three\n\n\nlines", 'x,"y",\n"', "", "  ", "é\n", '"', "plain", "\n"]
    for name, n in (("one.csv", 4000), ("two.csv", 37), ("three.csv", 0)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "two.csv" else "\n")
            writer.writerow(["id", "text, with comma", "last"])
            for k in range(n):
                writer.writerow([k, pick.choice(words) + pick.choice(words), pick.choice(words)])
                if k % 50 == 0:
                    out.write("\n")  # no record
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        found = quoted.read_quoted_sheet(spark, str(tmp_path), new_folder(spark, "quoted"))
        got = {(r.source_file, r.source_line): (r["id"], r["text, with comma"] or "", r["last"] or "") for r in found.collect()}
        blocks = found.select("source_path", "file_block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8") as file:
            given = [r for r in csv.reader(file) if r][1:]
        want.update({(name, k + 2): tuple(r) for k, r in enumerate(given)})
    assert blocks > 8 and got == want
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        quoted.read_quoted_sheet(spark, str(tmp_path), new_folder(spark, "quoted"))


def test_sketches_merge(spark):
    jobs = spark.range(20_000).selectExpr("timestamp_seconds(1700000000 + id * 7) as created_at", "'completed' as status",
                                          "case when id % 9 = 0 then null else (id * 7919) % 20000 end as latency")
    minutes = operation_sketches(jobs, "10 minutes")
    day = {r.window_start: r for r in merged_operations(minutes, "1 day").collect()}
    exact = {r.window_start: r for r in jobs.groupBy(F.window("created_at", "1 day")["start"].alias("window_start")).agg(
        F.count("latency").alias("n"), F.count(F.lit(1)).alias("jobs"), F.sort_array(F.collect_list("latency")).alias("all")).collect()}
    assert set(day) == set(exact)
    for k, r in day.items():
        values = exact[k]["all"]
        for q, p in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(sum(v <= p for v in values) / len(values) - q) < 0.015
        assert r.jobs == exact[k].jobs and r.success_rate == 1


def test_running_totals_keep_their_state_on_disk(spark, tmp_path):
    keys = ["year", "month", "internal_sku"]
    frame = spark.range(60).select(
        F.lit(2024).alias("year"), (F.col("id") % 3).cast("int").alias("month"), F.concat(F.lit("s"), F.col("id") % 5).alias("internal_sku"),
        *[F.col("id").cast("decimal(28,2)").alias(a) for a in AMOUNTS])
    frame.repartition(4).write.parquet(str(tmp_path / "landing"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
    root, name = str(tmp_path / "totals"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    query = stream_jobs.running_totals(stream, keys, root, str(tmp_path / "checkpoint"), compact_every=2)
    query.awaitTermination()
    assert spark.conf.get(name) == before
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 15 and any(m.startswith("rocksdb") for m in state["customMetrics"])
    got = {tuple(r[k] for k in keys): r.record_count for r in stream_jobs.latest_values(spark, root, keys).collect()}
    assert len(got) == 15 and sum(got.values()) == 60

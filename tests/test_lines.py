"""Line numbers over many blocks, files and one order that holds most rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.operators.lines import number_lines, spread_freight, with_file_position
from tallyspark.session import new_folder
from tallyspark.sources import sheets


def skewed_orders(rows=4000, seed=5):
    rng = random.Random(seed)
    return ["hot" if rng.random() < 0.4 else f"o{rng.randrange(600)}" for _ in range(rows)]


def expected(orders):
    totals, seen = Counter(orders), defaultdict(int)
    out = []
    for i, order in enumerate(orders, 1):
        seen[order] += 1
        out.append((i, order, seen[order], totals[order]))
    return out


def test_hot_order_over_blocks(spark):
    orders = skewed_orders()
    folder = new_folder(spark, "lines")
    spark.createDataFrame([(o,) for o in orders], "order_id string").coalesce(1).write.parquet(folder)
    placed = with_file_position(spark.read.parquet(folder), block_rows=137)
    got = number_lines(placed, ["order_id"]).select("source_line", "order_id", "line_no", "line_count").orderBy("source_line")
    assert [tuple(r) for r in got.collect()] == expected(orders)


def test_no_window_spans_a_whole_order(spark):
    folder = new_folder(spark, "lines")
    spark.range(10).selectExpr("'a' as order_id").write.parquet(folder)
    numbered = number_lines(with_file_position(spark.read.parquet(folder)), ["order_id"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "row_number()" in line:
            assert "file_block" in line.split("windowspecdefinition")[1]


def test_csv_lines_over_splits(spark):
    """Files are cut into many small blocks; numbers must follow the file, not the split."""
    folder = new_folder(spark, "csv")
    files = {}
    for f in range(3):
        rows = [(f"{f}-{i}", "x" * (i % 40), "行,\"号") for i in range(700 + f)]
        target = f"{folder}/file{f}"
        spark.createDataFrame(rows, "id string, pad string, note string").coalesce(1).write.option(
            "header", True).option("escape", '"').csv(target)
        files[f] = len(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sheets.read_sheet(spark, f"{folder}/*")
        assert rows.rdd.getNumPartitions() > 10
        got = sheets.with_source_lines(rows, 2).select("id", "source_line", "note").collect()
        staged = sheets.with_source_lines(sheets.stage_rows(rows, new_folder(spark, "staged")), 2)
        assert sorted(map(tuple, staged.select("id", "source_line", "note").collect())) == sorted(map(tuple, got))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == sum(files.values())
    assert all(int(r["id"].split("-")[1]) + 2 == r["source_line"] for r in got)
    assert {r["note"] for r in got} == {"行,\"号"}


def test_freight_is_conserved(spark):
    rng = random.Random(3)
    orders = skewed_orders(1500, 8)
    folder = new_folder(spark, "freight")
    freight = {o: rng.choice([0.0, -3.5, 0.01, 0.05, 10.0, 99.99, 1234.56]) for o in set(orders)}
    spark.createDataFrame([(o, freight[o]) for o in orders], "order_id string, freight double").coalesce(1).write.parquet(folder)
    placed = with_file_position(spark.read.parquet(folder), block_rows=100)
    done = spread_freight(placed, ["order_id"])
    sums = done.groupBy("order_id").agg(
        F.sum(F.col("extra_charge").cast("decimal(18,2)")).alias("s"), F.max("extra_charge").alias("hi"),
        F.min("extra_charge").alias("lo"), F.count(F.lit(1)).alias("n"))
    for r in sums.collect():
        original = freight[r["order_id"]]
        if original > 0:
            assert float(r["s"]) == original
            assert round((r["hi"] - r["lo"]) * 100) in (0, 1)
        else:
            assert (r["hi"], r["lo"]) == (original, original)


def test_files_of_one_name_stay_apart(spark):
    folder = new_folder(spark, "same")
    for part in ("a", "b"):
        spark.createDataFrame([("o",), ("o",)], "order_id string").coalesce(1).write.text(f"{folder}/{part}")
    rows = spark.read.text(f"{folder}/*").select(
        "value", F.concat(F.col("_metadata.file_path"), F.lit("")).alias("source_path"), F.lit("same.csv").alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_block"))
    lines = [r["source_line"] for r in sheets.with_source_lines(rows).collect()]
    assert sorted(lines) == [1, 1, 2, 2]


def test_empty_file_warning(spark):
    folder = new_folder(spark, "empty")
    spark.createDataFrame([("1",)], "a string").coalesce(1).write.option("header", True).csv(f"{folder}/full")
    spark.createDataFrame([("a",)], "v string").coalesce(1).write.text(f"{folder}/bare")
    rows = sheets.read_sheet(spark, [f"{folder}/full", f"{folder}/bare"])
    warned = sheets.empty_file_warnings(spark, f"{folder}/*/part-*", rows).collect()
    assert [r["message"] for r in warned] == [sheets.EMPTY_FILE]

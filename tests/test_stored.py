"""What stored facts and the views on them move and write."""

import glob
import os
import re
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import versions
from tallyspark.plans import formula
from tallyspark.queries import inputs
from tallyspark.schemas import AMOUNTS, FACT_TABLE, PARTITIONS
from tallyspark.session import new_folder
from tallyspark.sources import ranges, sheets, store
from tallyspark.sources.ledger import LOOKUP_VALUES, Ledger

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def tables(spark, files=1):
    """Forty lines, two of one key: an order's id is written with and without blanks."""
    rows = [(k, 5 + k, 1, 1, 2.0, 100.0 + k, 0.1, 0.02, "N", "O", datetime(1997, 5, 1 + k % 20)) for k in range(38)]
    rows += [(99, 5, 1, n, 2.0, 50.0 + n, 0.1, 0.02, "N", "O", datetime(1997, 5, 2)) for n in (1, 7)]
    folder = new_folder(spark, "tables")
    spark.createDataFrame(rows, LINES).repartitionByRange(files, "l_orderkey").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def kinds(folder):
    return {kind: path for (_, of, kind), path in inputs._written.items() if of == folder}


def view(frame):
    return sorted(map(tuple, frame.select(*FACT_TABLE.fieldNames()).collect()), key=repr)


@pytest.mark.parametrize("many", [versions.MANY, 0])
def test_view_writes_only_rows_that_share_a_key(spark, monkeypatch, many):
    monkeypatch.setattr(inputs, "MANY", many)
    folder = tables(spark)
    shown = view(inputs.effective_facts(spark, folder))
    facts = inputs.stored_facts(spark, folder).withColumn("seq", F.lit(1).cast("long"))
    assert facts.count() == 40 and len(shown) == 39
    assert shown == view(versions.last_rows(facts, versions.ROW_KEY, versions.LATEST))
    written = {k: spark.read.parquet(p).count() for k, p in kinds(folder).items() if k in ("latest", "effective")}
    assert written == ({"latest": 1} if many else {"effective": 39})


def test_filters_reach_the_facts_below_the_view(spark):
    one = inputs.effective_facts(spark, tables(spark)).where("year = 1997 and month = 5 and user_id = 'U1'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^]]*\]", plan)
    assert len([f for f in filters if "= 1997)" in f]) == 2, filters  # facts and last rows; the hashes have no months
    assert one.count() == 39


def test_tables_that_readers_divide_are_not_staged(spark):
    apart, whole = tables(spark, 8), tables(spark)
    assert inputs.lineitem(spark, apart).count() == inputs.lineitem(spark, whole).count() == 40
    assert "lines" in kinds(whole) and "lines" not in kinds(apart)
    amounts = [inputs.stored_facts(spark, f).groupBy("order_id").agg(F.sum("net_received")).orderBy("order_id").collect()
               for f in (apart, whole)]
    assert amounts[0] == amounts[1]


def test_shuffles_move_numbers_the_formulas_still_need(spark):
    raw = inputs.wechat_raw(spark, tables(spark))
    plan = formula.formula_facts(raw, gather=PARTITIONS)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions", 1)
    assert "decimal(28,2)" in above and "decimal(28,2)" not in below
    numbered = next(line for line in below.split("Window [row_number()", 1)[1].split("\n")[1:] if "Project [" in line)
    assert "qty_sold" in numbered and "_BI" not in numbered.split(" END")[0].split("CASE")[0]


def test_shuffles_move_whole_cents(spark):
    rows = formula._rows(inputs.wechat_raw(spark, tables(spark)), None, None)
    moved = rows.select(*AMOUNTS, "_freight", "_commission").collect()
    assert len(moved) == 40 and all(v == int(v) for row in moved for v in row)
    shown = formula.formula_facts(inputs.wechat_raw(spark, tables(spark))).where("order_id = '0'").first()
    assert [str(shown[n]) for n in ("recv_customer", "extra_charge", "fee_platform_comm")] == ["100.00", "-1.50", "1.20"]


def test_distinct_columns_are_written_without_dictionary(spark):
    folder = inputs.fact_root(spark, tables(spark))
    parts = glob.glob(os.path.join(folder, "**", "*.parquet"), recursive=True)
    assert parts
    for path in parts:
        group = pq.ParquetFile(path).metadata.row_group(0)
        of = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
        assert not any("DICTIONARY" in e for e in of["row_key"] + of["row_hash"])


def test_filters_of_small_files_are_small(spark):
    root = new_folder(spark, "small")
    store.write_partitioned(spark.range(100).selectExpr("cast(id as string) as row_key", "id % 2 as m"), root, ["m"],
                            lookup={"row_key": LOOKUP_VALUES})
    sizes = [os.path.getsize(p) for p in glob.glob(f"{root}/*/*.parquet")]
    assert sizes and max(sizes) < 200_000


def test_a_month_is_no_job_of_many_tasks(spark):
    month = Ledger(spark, "/none").months(user_id="u", year=2024)
    assert [tuple(r) for r in month.collect()] == [("u", None, 2024, None)] and month.rdd.getNumPartitions() == 1


def test_ordered_and_staged_copies_are_packed_like_facts(spark, tmp_path):
    frame = spark.range(200).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("row_hash"))
    ranges.write_ordered(frame, str(tmp_path / "ordered"), ["id"], 100)
    sheets.stage_rows(frame, str(tmp_path / "staged"))
    for kind in ("ordered/rows", "staged"):
        files = [*(tmp_path / kind).rglob("*.parquet")]
        chunks = [pq.ParquetFile(f).metadata.row_group(0).column(k) for f in files for k in (0, 1)]
        assert chunks and {c.compression for c in chunks} == {"ZSTD"}
        if kind != "staged":
            assert not any(e.endswith("DICTIONARY") for c in chunks if c.path_in_schema == "row_hash" for e in c.encodings)
    assert [r.id for r in ranges.page(spark, str(tmp_path / "ordered"), frame.schema, ["id"], 5, 98).collect()] == [*range(98, 103)]

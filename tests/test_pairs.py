"""Uploads that come as two files: any order of arrival and any restart end like one batch."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import upload
from tallyspark.plans.two_file import xiaohongshu_orders
from tallyspark.session import new_folder
from tallyspark.sources.ledger import Ledger
from tallyspark.sources.sheets import settlement_sheet
from tallyspark.streaming import pairs

ORDER = ["订单编号", "商家SKU编码", "SKU编码", "商品编号", "购买数量", "订单金额", "买家实付金额", "运费", "订单状态", "下单时间"]
SETTLED = ["订单编号", "结算状态", "佣金", "结算金额"]
UPLOAD = "user_id string, platform string, year int, month int, file_type string, path string, arrived_at timestamp"


@pytest.fixture(scope="module")
def store_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pairs.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def sheets(spark):
    """Order and settlement files: of one month twice, the second one corrected, and of another month."""
    folder = new_folder(spark, "pair-sheets")

    def csv(name, columns, rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.option("header", True).csv(f"{folder}/{name}")
        return f"{folder}/{name}"

    def order(number, sku, amount, month=10):
        return (number, sku, "", "n", "2", str(amount), str(amount - 1), "0", "已完成", f"2024-{month:02d}-03 10:00:00")

    return {
        "orders": csv("orders", ORDER, [order("o1", "A", 10), order("o1", "A", 20), order("o2", "B", 30)]),
        "settled": csv("settled", SETTLED, [("o1", "已结算", "1", "25"), ("o2", "待结算", "1", "9")]),
        "settled-2": csv("settled-2", SETTLED, [("o1", "已结算", "2", "26"), ("o2", "已结算", "3", "24")]),
        "orders-11": csv("orders-11", ORDER, [order("o9", "C", 5, 11)]),
    }


def arrival(sheets, name, second):
    month = 11 if name.endswith("-11") else 10
    role = "order" if name.startswith("orders") else "settlement"
    at = datetime.datetime(2024, 12, 1) + datetime.timedelta(seconds=second)
    return ("u", "xiaohongshu", 2024, month, role, sheets[name], at)


def run(spark, batches, restart=False, delay="1 hour", pause=0):
    source, root, staging, checkpoint = (new_folder(spark, n) for n in ("arrivals", "paired", "staged", "checkpoint"))
    for batch in batches:
        spark.createDataFrame(batch, UPLOAD).coalesce(1).write.mode("append").parquet(source)
        if restart:
            pairs.ingest_pairs(spark.readStream.schema(UPLOAD).parquet(source), root, staging, checkpoint, "p", delay).awaitTermination()
            time.sleep(pause)
    stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(source)
    pairs.ingest_pairs(stream, root, staging, checkpoint, "p", delay).awaitTermination()
    return root


def view(spark, root):
    shown = upload.effective(Ledger(spark, root)).collect()
    return sorted((r.month, r.order_id, r.internal_sku, float(r.recv_platform), float(r.net_received)) for r in shown)


@pytest.mark.parametrize("names", [("settled", "orders", "settled-2"), ("settled-2", "orders", "settled")])
def test_any_order_of_arrival(spark, store_state, sheets, names):
    """The file that counts is the last by its time, also where it is read earlier."""
    seconds = {"orders": 1, "settled": 2, "settled-2": 3}
    root = run(spark, [[arrival(sheets, n, seconds[n])] for n in names], restart=names[0] == "settled")
    orders, settled = (settlement_sheet(spark, sheets[n], "two_file", new_folder(spark, "direct")) for n in ("orders", "settled-2"))
    direct = xiaohongshu_orders(orders, settled, 2024, 10).groupBy("order_id", "internal_sku").agg(F.sum("recv_platform").alias("p")).collect()
    got = view(spark, root)
    assert {(r[1], r[2]): r[3] for r in got} == {(r.order_id, r.internal_sku): float(r.p) for r in direct}
    assert upload.check_view(Ledger(spark, root)).count() == 0


def test_missing_files_are_reported_after_the_delay(spark, store_state, sheets):
    """A pair that is there in time is not reported; a file that comes after the report still makes its pair."""
    batches = [[arrival(sheets, "orders-11", 0), arrival(sheets, "orders", 0), arrival(sheets, "settled", 60)],
               [("w", "douyin", 2024, 1, "order", "x", datetime.datetime(2020, 12, 1))], [arrival(sheets, "settled", 9)[:3] + (11,) + arrival(
                   sheets, "settled", 9)[4:]]]
    root = run(spark, batches, True, "2 seconds", 3)
    missing = [(r.user_id, r.month, r.missing) for r in spark.read.json(f"{root}/missing").collect()]
    assert ("u", 11, "settlement") in missing and all(m[1] != 10 for m in missing) and len(missing) == len(set(missing))
    assert {r[0] for r in view(spark, root)} == {10, 11}

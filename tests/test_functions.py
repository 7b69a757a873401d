import hashlib
import json
import math
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import files, keys, numbers, periods, text

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def column_values(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def plain_number(value, default=0.0):
    kept = re.sub(r"[^0-9.-]", "", value or "")
    found = re.match(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)", kept)
    return float(found.group()) if found else default


def plain_round2(value):
    return math.floor((value + 2.220446049250313e-16) * 100 + 0.5) / 100


def test_number_cases(spark):
    cases = {"¥1,234.50": 1234.5, "--": 0.0, "": 0.0, None: 0.0, "1.2.3": 1.2, "5-3": 5.0, "-.5": -0.5, "12元": 12.0,
             "1e5": 15.0, "+7": 7.0, " 8 ": 8.0, "5.": 5.0, ".": 0.0, "１２": 0.0, "-0": 0.0, "3\n": 3.0}
    assert column_values(spark, cases, numbers.parse_number) == list(cases.values())


@FEW
@given(st.lists(st.text(alphabet="0123456789.-¥, e\t元", max_size=12), min_size=1, max_size=60))
def test_numbers_agree(spark, values):
    assert column_values(spark, values, numbers.parse_number) == [plain_number(v) for v in values]


@FEW
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=60))
def test_rounding_agrees(spark, values):
    assert column_values(spark, values, numbers.round2, "double") == [plain_round2(v) for v in values]


def test_rounding_direction(spark):
    assert column_values(spark, [-0.125, 0.125, -2.345, 1.005], numbers.round2, "double")[:2] == [-0.12, 0.13]
    assert column_values(spark, [-1.2, 1.2], numbers.round_up, "double") == [-1.0, 2.0]


def test_three_segments(spark):
    got = column_values(spark, [10, 0, -5, -29, -30, -50], numbers.three_segment_qty, "int")
    assert got == [10, 0, 0, 0, -1, -1]


def test_texts(spark):
    assert column_values(spark, ["　a b﻿", None, " ", "x"], text.clean_text) == ["a b", "", "", "x"]
    assert column_values(spark, ["a​b c　"], text.strip_invisible) == ["abc"]
    assert column_values(spark, ["Z1-红-S", "-9", "X", None], text.left_of_dash) == ["Z1", "-9", "X", ""]


def test_money_texts(spark):
    amounts = ["100.00", "0.50", "0.00", "-12.34", "1234567.80", "10.00"]
    rows = spark.createDataFrame([(a,) for a in amounts], "t string").select(F.col("t").cast("decimal(18,2)").alias("v"))

    def texts(e):
        return [r[0] for r in rows.select(e(F.col("v"))).collect()]

    assert texts(numbers.shortest_text) == ["100", "0.5", "0", "-12.34", "1234567.8", "10"]
    assert texts(numbers.export_text) == ["100", "0.50", "0", "-12.34", "1234567.80", "10"]
    assert texts(numbers.fixed2_text) == amounts
    assert texts(numbers.currency_text) == ["100.00", "0.50", "0.00", "-12.34", "1,234,567.80", "10.00"]
    assert texts(numbers.number_text) == ["100", "0.5", "0", "-12.34", "1,234,567.8", "10"]


def test_periods_of_files(spark):
    cases = {"视频号 2025年8月.xlsx": (2025, 8), "25年09月结算.csv": (2025, 9), "结算10月_2024.csv": (2024, 10),
             "12月 24.csv": (2012, 12), "9月 24.csv": (2024, 9), "8月.csv": (None, None), "2025.csv": (None, None), "13月2024": (2024, 3)}
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    year, month = periods.file_period(F.col("v"))
    assert {r[0]: (r[1], r[2]) for r in frame.select("v", year, month).collect()} == cases


def test_file_kinds(spark):
    assert column_values(spark, ["a/b.CSV", "x.y.xlsx", "none"], files.file_type) == ["settlement", "xlsx", ""]
    names = ["Settlement.csv", "订单.csv", "订单结算.csv", "x.csv"]
    assert column_values(spark, names, lambda c: files.file_role(c, "douyin")) == ["settlement", "orders", "settlement", None]


def test_dataset_id(spark):
    frame = spark.createDataFrame([("u", "douyin", 2024, 10)], "u string, p string, y int, m int")
    got = frame.select(keys.dataset_id(F.col("u"), F.col("p"), F.col("y"), F.col("m"))).first()[0]
    assert got == "dataset-" + hashlib.sha256(b"u:douyin:2024:10").hexdigest()[:8]


def test_row_hash_is_that_of_the_json_list(spark):
    row = {"order_id": 'a"b]', "internal_sku": "红-S", "line_no": None, "qty_sold": 2, "recv_customer": 100,
           "recv_platform": 0.5, "extra_charge": 0, "fee_platform_comm": 1.25, "fee_affiliate": 0, "fee_other": 0,
           "net_received": 99.25}
    money = [k for k in row if k not in ("order_id", "internal_sku", "line_no")]
    frame = spark.createDataFrame([(row["order_id"], row["internal_sku"], None, *[float(row[k]) for k in money])],
                                  "order_id string, internal_sku string, line_no int, " + ", ".join(f"{k} double" for k in money))
    frame = frame.withColumns({k: numbers.money(F.col(k)) for k in money})
    expected = json.dumps([row[k] for k in sorted(row)], ensure_ascii=False, separators=(",", ":"))
    assert frame.select(keys.row_hash()).first()[0] == hashlib.sha256(expected.encode()).hexdigest()


def test_json_texts_are_those_of_the_json_writer(spark):
    texts = ["", "P7-F", "[a]", "a]", '"', "\\", "a\n", "\n", "\t", "\x1f", "\x7f", "红-S", "~ !#", "a'b/c", "\u2028", "😀"]
    written = column_values(spark, texts, lambda v: F.to_json(F.array(v)))
    assert column_values(spark, texts, keys._json_text) == [w[1:-1] for w in written]
    plan = spark.createDataFrame([("a",)], "v string").select(keys._json_text(F.col("v")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in plan  # plain texts do without the writer


def test_row_key(spark):
    frame = spark.createDataFrame([("p", "o", "s", 1), ("p", "o", "s", None)], "p string, o string, s string, n int")
    c = F.col
    got = frame.select(keys.row_key(c("p"), c("o"), c("s"), c("n")), keys.row_key(c("p"), c("o"), c("s"))).collect()
    assert [tuple(r) for r in got] == [("p:o:s:1", "p:o:s"), ("p:o:s:null", "p:o:s")]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cells_without_a_digit_are_not_cast(spark):
    cells = {"": 0.5, "--": 0.5, "¥": 0.5, "-": 0.5, ".": 0.5, "--5": 0.5, "¥5件": 5.0, "a.5": 0.5, "１": 0.5}
    assert column_values(spark, cells, lambda v: numbers.parse_number(v, 0.5)) == list(cells.values())
    frame = spark.createDataFrame([("x",)], "v string").select(numbers.parse_number(F.col("v")))
    assert "RLIKE(v#" in _plan(frame) and "[0-9])" in _plan(frame)


def test_outer_blanks_go_without_a_pattern(spark):
    blanks = [c for c in map(chr, range(0x10000)) if re.match(f"[{text.BLANKS}]", c)]
    ends = [*blanks, "", "\u0085", "\u200b", " \u0085", "\r\n", "\u0085 ", "\u3000\n"]
    values = [f"{a}x{b}y{c}" for a, b, c in zip(ends, reversed(ends), [*ends[5:], *ends[:5]])] + blanks + [" \u0085", "\u0085", ""]
    old = lambda v: F.regexp_replace(v, f"^[{text.BLANKS}]+|[{text.BLANKS}]+$", "")
    assert column_values(spark, values, text.clean_text) == column_values(spark, values, old)
    frame = spark.createDataFrame([("x",)], "v string").select(text.clean_text(F.col("v")))
    assert "Contains(v#" in _plan(frame)

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import paging, rollup, validate, versions

LOG = "dataset_id string, upload_id string, row_key string, row_hash string, seq long"


def random_log(seed, rows, start=0):
    rng = random.Random(seed)
    return [("d", f"u{rng.randrange(3)}", "hot" if rng.random() < 0.3 else f"k{rng.randrange(50)}", f"h{rng.randrange(3)}", start + i)
            for i in range(rows)]


def test_latest_append_wins(spark):
    rows = random_log(1, 500)
    want = {r[2]: (r[1], r[3]) for r in rows}
    got = versions.effective_rows(spark.createDataFrame(rows, LOG)).collect()
    assert {r["row_key"]: (r["upload_id"], r["row_hash"]) for r in got} == want


def test_merge_counts_every_incoming_row(spark):
    log = spark.createDataFrame([("d", "u", "a", "1", 1), ("d", "u", "a", "2", 2), ("d", "u", "b", "1", 3)], LOG)
    new = spark.createDataFrame([("d", "v", "a", "1", 4), ("d", "v", "b", "1", 5), ("d", "v", "c", "1", 6), ("d", "v", "c", "1", 7)], LOG)
    stats = {r["action"]: r["rows"] for r in versions.merge_stats(new, log).collect()}
    assert stats == {"updated": 1, "unchanged": 1, "inserted": 2}


def test_merging_again_changes_nothing(spark):
    log = spark.createDataFrame(random_log(2, 200), LOG)
    batch = versions.effective_rows(spark.createDataFrame(random_log(3, 200, 1000), LOG))
    merged = versions.merge_upsert(log, batch.select(*log.columns))
    again = {r["action"]: r["rows"] for r in versions.merge_stats(batch, merged).collect()}
    assert set(again) == {"unchanged"}
    assert versions.existing_rows(batch, merged).count() == batch.count()


def test_replace_and_clear(spark):
    schema = "user_id string, platform string, year int, month int, v int"
    facts = spark.createDataFrame([("u", "p", 2024, 1, 1), ("u", "p", 2024, 2, 2), ("w", "p", 2024, 1, 3)], schema)
    new = spark.createDataFrame([("u", "p", 2024, 1, 9), ("u", "p", 2024, 1, 8)], schema)
    assert sorted(r["v"] for r in versions.replace_periods(facts, new).collect()) == [2, 3, 8, 9]
    assert sorted(r["v"] for r in versions.clear_period(facts, "u", "p", 2024, 1).collect()) == [2, 3]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "line int, text string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "line int, text string")
    found = {(r["line"], r["text"]): (r["actual"], r["expected"]) for r in versions.table_difference(a, b).collect()}
    assert found == {(1, "x"): (2, 1), (2, "y"): (1, 0), (2, "z"): (0, 1)}
    assert versions.table_difference(a, a).count() == 0


def test_job_lists(spark):
    frame = spark.createDataFrame([(["a", "", "b"], ["b", "c"]), (None, None)], "x array<string>, y array<string>")
    got = [r[0] for r in frame.select(versions.merged_job_ids(F.col("x"), F.col("y"))).collect()]
    assert got == [["a", "b", "c"], []]
    latest = frame.select(versions.latest_job(F.lit(None).cast("string"), F.col("y"))).collect()
    assert [r[0] for r in latest] == ["c", None]


def test_duplicate_merge(spark):
    rows = [("k", 1, "first", None, 10.0, 5.0), ("k", 2, "second", 3.0, 1.5, 7.0), ("one", 3, "only", -2.0, 1.0, 99.0)]
    frame = spark.createDataFrame(rows, "row_key string, source_line long, name string, qty_sold double, recv_customer double, net_received double")
    money = {n: F.col(n).cast("decimal(18,2)") for n in ("qty_sold", "recv_customer", "net_received")}
    others = {n: F.lit(0).cast("decimal(18,2)") for n in ("recv_platform", "extra_charge", "fee_platform_comm", "fee_affiliate", "fee_other")}
    got = {r["row_key"]: r for r in rollup.merge_duplicates(frame.withColumns({**money, **others}), order=["source_line"]).collect()}
    assert (got["k"]["name"], float(got["k"]["qty_sold"]), float(got["k"]["net_received"])) == ("first", 3, 11.5)
    assert (float(got["one"]["net_received"]), got["one"]["source_merge_count"]) == (99, 1)


def test_uploads_without_a_key_part_are_kept(spark):
    rows = [("a", "u", None, 1), ("b", "u", None, 2), ("c", "u", "h", 3), ("d", "u", "h", 0)]
    frame = spark.createDataFrame(rows, "id string, user string, hash string, at int")
    got = versions.mark_duplicates(frame, ["user", "hash"], ["at", "id"]).collect()
    assert {r["id"]: (r["first_id"], r["is_duplicate"]) for r in got} == {
        "a": ("a", False), "b": ("a", True), "c": ("d", True), "d": ("d", False)}


def test_pages(spark):
    frame = spark.range(100).selectExpr("id % 7 as a", "id as b")
    want = sorted((r["a"], r["b"]) for r in frame.collect())
    assert [tuple(r) for r in paging.page(frame, ["a", "b"], 10, 25).collect()] == want[25:35]
    assert [tuple(r) for r in paging.page_after(frame, ["a", "b"], want[24], 10).collect()] == want[25:35]
    assert paging.check_page(1, 10) == (0, 10) and paging.check_page(3, 1000) == (2000, 1000)
    for wrong in ((0, 50), (1, 9), (1, 1001)):
        with pytest.raises(ValueError):
            paging.check_page(*wrong)


def test_walking_pages_with_missing_values(spark):
    """Every row once, also where all line numbers are missing."""
    rows = [(f"o{i % 6}", None if i % 4 == 0 else i % 3, f"k{i}") for i in range(60)] + [(None, None, f"n{i}") for i in range(5)]
    frame = spark.createDataFrame(rows, "order_id string, line_no int, row_key string")
    order, seen = ["order_id", "line_no", "row_key"], []
    while True:
        found = paging.page(frame, order, 10) if not seen else paging.page_after(frame, order, seen[-1], 10)
        part = [tuple(r) for r in found.collect()]
        seen += part
        if len(part) < 10:
            break
    assert len(seen) == len(rows) and set(seen) == set(rows)
    assert [tuple(r) for r in paging.page(frame, order, 10, 30).collect()] == seen[30:40]


def test_search_keeps_wildcards(spark):
    frame = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), ("a\\b",)], "internal_sku string")

    def hits(text):
        return [r[0] for r in frame.where(paging.sku_like(text)).collect()]

    assert hits("a_b") == ["a_b", "axb", "a%b", "a\\b"]
    assert hits("a\\b") == ["a\\b"]


@pytest.mark.parametrize("bad", [("taobao", 2024, 1, "u"), ("douyin", 2024, 13, "u"), ("douyin", 2024, 1, "")])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        paging.check_request(*bad)


def test_facets_need_platform_for_months(spark):
    frame = spark.createDataFrame([("u", "douyin", 2024, 3, "active"), ("u", "douyin", 2023, 1, "superseded"), ("w", "x", 2020, 1, "active")],
                                  "user_id string, platform string, year int, month int, status string")
    assert {tuple(r) for r in rollup.facets(frame, "u").collect()} == {("platform", "douyin"), ("year", "2024")}
    assert ("month", "03") in {tuple(r) for r in rollup.facets(frame, "u", "douyin", 2024).collect()}


def test_empty_summary(spark):
    columns = ", ".join(f"{n} decimal(18,2)" for n in ("qty_sold", "recv_customer", "recv_platform", "extra_charge",
                                                       "fee_platform_comm", "fee_affiliate", "fee_other", "net_received"))
    row = rollup.fact_summary(spark.createDataFrame([], columns)).first()
    assert row["consistency_check"] and float(row["total_net_received"]) == 0


def test_record_problems(spark):
    frame = spark.createDataFrame([("ULP-1", "u", None, "old"), ("x", None, "h", None)], "id string, user_id string, content_hash string, contenthash string")
    rows = {r["id"]: r for r in validate.record_problems(frame, ["user_id", "content_hash", "size"], ["contenthash"], "ULP-").collect()}
    assert rows["ULP-1"]["missing_fields"] == ["content_hash", "size"] and rows["ULP-1"]["legacy_fields"] == ["contenthash"]
    assert rows["x"]["id_ok"] is False

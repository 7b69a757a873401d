"""Commits that change tables together, and what uploads leave in a settlement ledger."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyspark import session
from tallyspark.operators import versions
from tallyspark.operators.rollup import month_sku
from tallyspark.plans import upload
from tallyspark.schemas import AMOUNTS, FACT_TABLE
from tallyspark.session import new_folder
from tallyspark.sources import ledger as ledgers
from tallyspark.sources.ledger import Conflict, Ledger

MONTH = StructType([*ledgers._MONTH, StructField("v", IntegerType())])


@pytest.fixture
def book(spark):
    return Ledger(spark, new_folder(spark, "ledger"))


def rows(spark, *given):
    return spark.createDataFrame([("u", "p", 2024, m, v) for m, v in given], MONTH)


def shown(book, version=None, months=None):
    return sorted((r.month, r.v, r.seq) for r in book.read("t", MONTH, months, version).collect())


def commit(book, label, frame, mode="append", months=None):
    change = book.begin(label)
    change.append("t", frame) if mode == "append" else change.replace("t", frame, months)
    return change.commit()


def test_readers_see_whole_commits(spark, book):
    assert commit(book, "a", rows(spark, (1, 1), (2, 2))) == 1
    change = book.begin("b")
    change.append("t", rows(spark, (1, 3)))
    change.replace("other", rows(spark, (1, 9)))
    assert shown(book) == [(1, 1, 1), (2, 2, 1)] and book.read("other", MONTH).count() == 0  # written, not committed
    pinned = book.version()
    assert change.commit() == 2
    assert shown(book) == [(1, 1, 1), (1, 3, 2), (2, 2, 1)] and shown(book, pinned) == [(1, 1, 1), (2, 2, 1)]
    assert book.read("other", MONTH).count() == 1
    assert commit(book, "c", rows(spark, (1, 4)), "replace") == 3
    assert shown(book) == [(1, 4, 3), (2, 2, 1)] and shown(book, 2) == [(1, 1, 1), (1, 3, 2), (2, 2, 1)]
    empty = book.months(user_id="u", platform="p", year=2024, month=2)
    assert commit(book, "d", rows(spark).limit(0), "replace", empty) == 4 and shown(book) == [(1, 4, 3)]
    assert shown(book, months=empty) == []


def test_a_label_is_committed_once(spark, book):
    assert commit(book, "a", rows(spark, (1, 1))) == 1
    again = book.begin("a")
    assert again.done == 1 and again.commit() == 1 and shown(book) == [(1, 1, 1)]


def test_a_killed_change_leaves_nothing(spark, book, monkeypatch):
    commit(book, "a", rows(spark, (1, 1)))
    for step in ("_publish", "_write"):
        with monkeypatch.context() as broken:
            owner = Ledger if step == "_publish" else ledgers.Change
            broken.setattr(owner, step, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                commit(book, "b", rows(spark, (1, 2)), "replace")
        assert shown(book) == [(1, 1, 1)] and book.version() == 1
    assert commit(book, "b", rows(spark, (1, 2)), "replace") == 2 and shown(book) == [(1, 2, 2)]


def test_changes_of_one_month_exclude_each_other(spark, book):
    commit(book, "a", rows(spark, (1, 1), (2, 1)))
    first, second, third = (book.begin(x) for x in "bcd")
    first.replace("t", rows(spark, (1, 2)))
    second.append("t", rows(spark, (1, 3)))
    third.append("t", rows(spark, (2, 4)))
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert third.commit() == 3 and shown(book) == [(1, 2, 2), (2, 1, 1), (2, 4, 3)]


def test_checkpoint_compaction_and_vacuum_change_nothing_shown(spark, book):
    for k in range(4):
        commit(book, f"a{k}", rows(spark, (1, k), (k + 2, 0)))
    commit(book, "r", rows(spark, (2, 7)), "replace")
    change = book.begin("x")
    change.clear("t", book.months(user_id="u", platform="p", year=2024, month=3))
    change.commit()
    before = [r[:2] for r in shown(book)]
    assert book.checkpoint() == 6 and [r[:2] for r in shown(book)] == before and book.begin("a2").done == 3
    assert commit(book, "late", rows(spark, (3, 5))) == 7 and (3, 5, 7) in shown(book)
    assert book.compact("t", MONTH, "compact") == 8
    tokens = book.units("t").where("month = 1").count()
    assert tokens == 1 and sorted(r[:2] for r in shown(book)) == sorted([*before, (3, 5)])
    after = shown(book)
    gone = book.vacuum(book.version())
    assert gone and shown(book) == after and book.begin("a2").done == 3


def test_months_with_missing_parts(spark, book):
    frame = spark.createDataFrame([("u", None, 2024, None, 1), ("u", None, 2024, 2, 2)], MONTH)
    commit(book, "a", frame)
    assert sorted(r.v for r in book.read("t", MONTH).collect()) == [1, 2]
    assert [r.v for r in book.read("t", MONTH, book.months(user_id="u", year=2024)).collect()] == [1]


def test_only_folders_of_the_months_are_read(spark, book):
    for m in (1, 2, 3):
        commit(book, f"m{m}", rows(spark, (m, m)))
    found = book.read("t", MONTH, book.months(user_id="u", platform="p", year=2024, month=2))
    data = [f for f in found.inputFiles() if "/t/token=" in f]
    assert len(data) == 1 and [r.v for r in found.collect()] == [2]


def facts(spark, given, job):
    """(key, sku, line, amount) as facts of one month; the hash follows the amount."""
    frame = spark.createDataFrame([(k, s, n, str(a), m) for k, s, n, a, m in given],
                                  "row_key string, internal_sku string, source_line long, net string, month int")
    fixed = {"user_id": F.lit("u"), "platform": F.lit("douyin"), "year": F.lit(2024), "job_id": F.lit(job), "upload_id": F.lit(f"ULP-{job}"),
             "source_file": F.lit("f"), "row_hash": F.concat("internal_sku", F.lit("/"), "net"),
             **{n: F.col("net").cast("decimal(28,2)") for n in AMOUNTS}}
    frame = frame.withColumns(fixed)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in FACT_TABLE.fields if f.name not in frame.columns}
    return frame.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in FACT_TABLE.fields])


def test_view_and_totals_follow_commits_not_names(spark, book):
    jobs = ("job-9", "job-10", "job-0c3a")
    uploads = [[("a", "s", 1, 1, 1), ("b", "s", 2, 2, 1), ("c", "t", 3, 4, 1)],
               [("a", "s", 1, 10, 1), ("b", "t", 2, 2, 1), ("d", "s", 1, 7, 2)],
               [("c", "t", 1, 4, 1), ("a", "s", 5, 30, 1), ("a", "s", 9, 40, 1)]]  # a key twice in one upload
    for job, given in zip(jobs, uploads):
        upload.upload(book, facts(spark, given, job), job)
    assert upload.upload(book, facts(spark, uploads[0], jobs[0]), jobs[0]) == 1  # a known label
    view = {r.row_key: (float(r.net_received), r.internal_sku, r.job_id) for r in upload.effective(book).collect()}
    assert view == {"a": (40, "s", jobs[2]), "b": (2, "t", jobs[1]), "c": (4, "t", jobs[2]), "d": (7, "s", jobs[1])}
    sums = {(r.month, r.internal_sku): (float(r.net_received_sum), r.record_count) for r in upload.totals(book).collect()}
    assert sums == {(1, "s"): (40, 1), (1, "t"): (6, 2), (2, "s"): (7, 1)}
    merges = {(r.job_id, r.action): r.rows for r in book.read("merges", upload.MERGES).groupBy("job_id", "action").agg(F.sum("rows").alias("rows")).collect()}
    assert merges == {(jobs[0], "inserted"): 3, (jobs[1], "updated"): 2, (jobs[1], "inserted"): 1, (jobs[2], "updated"): 2, (jobs[2], "unchanged"): 1}
    index = book.read("index", upload.INDEX).groupBy("row_key", "seq").count().collect()
    assert all(r["count"] == 1 for r in index) and upload.check_view(book).count() == 0
    upload.compact(book, "totals", "compact-1")
    assert {(r.month, r.internal_sku): (float(r.net_received_sum), r.record_count) for r in upload.totals(book).collect()} == sums


def test_totals_equal_the_rollup_after_any_uploads(spark, book):
    pick = random.Random(3)
    for k in range(4):
        given = [(f"k{pick.randrange(12)}", f"s{pick.randrange(3)}", n, pick.randrange(-5, 50), pick.randrange(1, 4)) for n in range(20)]
        upload.upload(book, facts(spark, given, f"j{k}"), f"j{k}", "replace" if k == 2 else "merge")
    assert upload.check_view(book).count() == 0
    by = [*ledgers.PERIOD, "internal_sku"]
    rolled = month_sku(upload.history(book), by).select(*upload.TOTALS.fieldNames())
    assert sorted(map(tuple, rolled.collect())) == sorted(tuple(r) for r in upload.totals(book).select(*rolled.columns).collect())


def test_replace_and_clear(spark, book):
    upload.upload(book, facts(spark, [("a", "s", 1, 1, 1), ("b", "s", 2, 2, 1), ("c", "s", 3, 3, 2)], "j1"), "j1")
    upload.upload(book, facts(spark, [("b", "s", 1, 5, 1)], "j2"), "j2", "replace")
    assert sorted((r.row_key, r.job_id) for r in upload.effective(book).collect()) == [("b", "j2"), ("c", "j1")]
    assert upload.clear(book, "u", "douyin", 2024, 1, "clear-1") == ["j2"]
    assert [r.row_key for r in upload.effective(book).collect()] == ["c"]
    assert [r.row_key for r in book.read("index", upload.INDEX).collect()] == ["c"]
    assert sorted((r.month, r.status, r.superseded_by) for r in upload.datasets(book).collect()) == [
        (1, "superseded", "manual-clear"), (2, "active", None)]
    assert upload.clear(book, "u", "douyin", 2024, 1, "clear-2") is None
    # What was cleared is new when it comes again.
    upload.upload(book, facts(spark, [("b", "s", 1, 5, 1)], "j3"), "j3")
    last = book.read("merges", upload.MERGES).where("job_id = 'j3'").collect()
    assert [(r.action, r.rows) for r in last] == [("inserted", 1)] and upload.check_view(book).count() == 0
    with pytest.raises(ValueError):
        upload.upload(book, facts(spark, [], "j4"), "j4", "overwrite")


def test_an_empty_upload(spark, book):
    assert upload.upload(book, facts(spark, [], "j"), "j") == 1 and upload.effective(book).count() == 0


def _exchanged(frame):
    """Columns that the plan shuffles, at most."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_reading_a_ledger_shuffles_no_rows(spark, book):
    upload.upload(book, facts(spark, [("a", "s", 1, 1, 1), ("b", "s", 2, 2, 1)], "j1"), "j1")
    view = upload.effective(book)
    assert "BroadcastHashJoin" in view._jdf.queryExecution().executedPlan().toString() and view.count() == 2
    assert not any("row_key" in line for line in _exchanged(view))


def test_months_of_new_keys_alone_are_not_written_again(spark, book):
    upload.upload(book, facts(spark, [("a", "s", 1, 1, 1), ("b", "s", 2, 2, 2)], "j1"), "j1")
    upload.upload(book, facts(spark, [("c", "s", 1, 3, 1), ("b", "s", 1, 5, 2), ("d", "s", 2, 6, 2), ("d", "s", 3, 7, 2)], "j2"), "j2")
    written = {(r.month, r.row_key) for r in spark.read.parquet(f"{book.root}/effective").where("job_id = 'j1'").collect()}
    assert written == {(1, "a"), (2, "b")}
    assert sorted((r.month, r.seq) for r in book.units("effective").collect()) == [(1, 1), (1, 2), (2, 2)]
    view = sorted((r.row_key, float(r.net_received)) for r in upload.effective(book).collect())
    assert view == [("a", 1), ("b", 5), ("c", 3), ("d", 7)] and upload.check_view(book).count() == 0


def test_a_small_batch_does_not_count_the_keys_of_the_view(spark, book):
    upload.upload(book, facts(spark, [(f"k{i}", "s", 1, i, 1) for i in range(9)], "j1"), "j1")
    known, key = upload.effective(book).drop("seq"), [*ledgers.PERIOD, "row_key"]
    brought = facts(spark, [("k3", "s", 2, 1, 1), ("new", "s", 1, 2, 1), ("twice", "s", 1, 1, 1), ("twice", "s", 2, 1, 1)], "j2")
    met = versions.met_hashes(known, brought, key)
    want = brought.where("row_key <> 'new'").select(F.xxhash64(*key)).distinct()
    assert sorted(r[0] for r in met.collect()) == sorted(r[0] for r in want.collect())
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
    upload.upload(book, brought, "j2")
    view = {r.row_key: float(r.net_received) for r in upload.effective(book).collect()}
    assert view["k3"] == 1 and view["new"] == 2 and len(view) == 11 and upload.check_view(book).count() == 0


def test_what_is_empty_is_known_to_be(spark, book):
    brought = facts(spark, [("a", "s", 1, 1, 1)], "j1")
    met = versions.met_hashes(upload.effective(book), brought, [*ledgers.PERIOD, "row_key"])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and met.count() == 0


def test_only_folders_with_replaced_rows_are_written_again(spark, book, monkeypatch):
    given = [[("a", "s", 1, 1, 1), ("b", "s", 2, 2, 1)], [("c", "s", 1, 3, 1), ("d", "s", 2, 4, 1)], [("c", "s", 1, 5, 1), ("e", "s", 2, 6, 1)]]
    for k, rows_ in enumerate(given, 1):
        upload.upload(book, facts(spark, rows_, f"j{k}"), f"j{k}")
    written = spark.read.parquet(f"{book.root}/effective").groupBy("row_key", "job_id").count().collect()
    assert {(r.row_key, r.job_id): r["count"] for r in written} == {
        ("a", "j1"): 1, ("b", "j1"): 1, ("c", "j2"): 1, ("d", "j2"): 2, ("c", "j3"): 1, ("e", "j3"): 1}
    want = {"a": 1, "b": 2, "c": 5, "d": 4, "e": 6}
    before = sorted(map(tuple, book.units("effective").collect()))
    assert len(before) == 3 and {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want
    assert upload.effective(book, version=2).count() == 4 and upload.check_view(book).count() == 0
    # A log that the driver does not keep is read to the same end, and months that it does not list are replaced alike.
    monkeypatch.setattr(ledgers, "LOCAL_BYTES", 0)
    monkeypatch.setattr(ledgers, "LOCAL_ROWS", 0)
    ledgers._kept.clear()
    assert sorted(map(tuple, book.units("effective").collect())) == before and book.begin("j2").done == 2
    upload.upload(book, facts(spark, [("a", "s", 1, 7, 1), ("d", "s", 1, 8, 1)], "j4"), "j4")
    want |= {"a": 7, "d": 8}
    assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want
    assert book.checkpoint() == 4 and book.begin("j3").done == 3
    assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want
    book.vacuum(4)
    assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want
    assert upload.check_view(book).count() == 0


def test_a_small_batch_is_planned_once(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    with session.plans_for(spark, 1000):
        assert spark.conf.get(names[0]) == "false" and int(spark.conf.get(names[1])) <= session.SMALL_PARTITIONS
    with session.plans_for(spark, session.SMALL_BYTES):
        assert [spark.conf.get(n) for n in names] == before
    assert [spark.conf.get(n) for n in names] == before
    with pytest.raises(ZeroDivisionError):
        session.together(spark, lambda: 1 / 0, lambda: spark.range(3).count())


def test_few_replaced_rows_are_hidden_where_they_lie(spark, book):
    first = [(f"k{n:02}", "s", n, n, 1) for n in range(40)]
    upload.upload(book, facts(spark, first, "j1"), "j1")
    want = {k: float(a) for k, _, _, a, _ in first}
    for k, again in enumerate(([("k03", "t", 1, 100, 1), ("new", "t", 2, 7, 1)], [("k03", "s", 1, 200, 1), ("k05", "s", 2, 300, 1)]), 2):
        upload.upload(book, facts(spark, again, f"j{k}"), f"j{k}")
        want |= {r[0]: float(r[3]) for r in again}
        assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want and upload.check_view(book).count() == 0
    written = spark.read.parquet(f"{book.root}/effective")
    assert written.where("job_id = 'j1'").count() == 40  # not written again
    assert sorted((r.row_key, r.seq) for r in book.read("hidden", upload.HIDDEN).collect()) == [("k03", 2), ("k05", 3)]
    assert upload.effective(book, version=1).count() == 40 and upload.effective(book, version=2).count() == 41
    assert "k03" in {r.row_key for r in upload.effective(book, version=1).where("net_received = 3").collect()}
    upload.compact(book, "effective", "compact")
    assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want
    assert book.units("effective").count() == 1 and upload.check_view(book).count() == 0
    # Many replaced rows: the folder is written again.
    many = [(f"k{n:02}", "s", n, n + 500, 1) for n in range(8, 30)]
    upload.upload(book, facts(spark, many, "j4"), "j4")
    want |= {r[0]: float(r[3]) for r in many}
    assert {r.row_key: float(r.net_received) for r in upload.effective(book).collect()} == want and upload.check_view(book).count() == 0
    assert book.read("hidden", upload.HIDDEN).where("seq > 4").count() == 0
    upload.upload(book, facts(spark, [("k03", "s", 1, 1, 1)], "j5"), "j5", "replace")
    assert [(r.row_key, r.job_id) for r in upload.effective(book).collect()] == [("k03", "j5")]
    assert book.read("hidden", upload.HIDDEN).count() == 0

"""Settlement inputs drawn from the given tables.

The column expressions are plain SQL that Spark and the checking engine read alike, so both sides start from
the same raw text. They produce the untidy cells of real exports: currency signs, thousands commas, units,
dashes, blanks, missing cells, prices of zero and amounts out of range. Only what follows from them is
computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.lines import with_file_position
from ..schemas import PARTITIONS
from ..plans import formula, ingest
from ..plans import upload
from ..sources import store
from ..sources.ledger import Ledger
from ..session import new_folder
from ..operators.rollup import month_sku
from ..operators.versions import (
    HASH, LATEST, MANY, ROW_KEY, alone, among, effective_facts as latest_facts, last_rows, repeated_hashes,
)

PLATFORM = "wechat_video"
USER, YEAR, MONTH = "U1", 1997, 5


def cents(e: str) -> str:
    return f"cast(floor(({e}) * 100 + 0.5) / 100 as decimal(18,2))"


_PRICE = cents("l_extendedprice / l_quantity")
_SALE = cents("l_extendedprice * (1 - l_discount)")
_COUPON = cents("l_extendedprice * l_discount")
_THOUSANDS = "cast(floor(l_extendedprice / l_quantity / 1000) as bigint)"

def plain(e: str) -> str:
    """0 beside the very large prices, so that their sums are exact in doubles."""
    return f"case when l_partkey % 500 = 9 then '0' else {e} end"


# (name, header, expression) of the wechat_video settlement sheet.
WECHAT = [
    ("order_raw", formula.ORDER,
     "case when l_linenumber = 7 then concat(' ', l_orderkey, ' ') else concat('', l_orderkey) end"),
    ("sku_1", formula.SKU_HEADERS[0],
     "case when l_partkey % 10 = 3 then '  ' else concat('P', l_partkey, '-', l_linestatus) end"),
    ("sku_2", formula.SKU_HEADERS[1], "case when l_partkey % 20 = 3 then nullif('', '') else concat(' C', l_partkey) end"),
    ("sku_3", formula.SKU_HEADERS[2], "''"),
    ("sku_4", formula.SKU_HEADERS[3], "nullif('', '')"),
    ("sku_5", formula.SKU_HEADERS[4], "case when l_partkey % 40 = 3 then '' else concat('-', l_partkey) end"),
    ("settled_at", formula.SETTLE_TIME, "concat('', cast(l_shipdate as date))"),
    ("bi", formula.HEADERS["BI"],
     f"case when l_partkey % 50 = 0 then '0' when l_partkey % 500 = 9 and l_linenumber % 4 = 0 then '100000000' when l_partkey % 500 = 9 and l_linenumber % 4 = 1 then '1000000000000000' "
     f"when l_partkey % 500 = 9 and l_linenumber % 4 = 2 then '100000000000000000' when l_partkey % 500 = 9 then '1000000000000000000000000000000' "
     f""
     f"when {_PRICE} >= 1000 then concat('¥', {_THOUSANDS}, ',', lpad(concat('', cast({_PRICE} - {_THOUSANDS} * 1000 "
     f"as decimal(18,2))), 6, '0')) else concat('', {_PRICE}) end"),
    ("bk", formula.HEADERS["BK"], f"concat('', {_SALE})"),
    ("bn", formula.HEADERS["BN"], f"concat('￥', {_COUPON})"),
    ("bt", formula.HEADERS["BT"],
     f"case when l_partkey % 500 = 9 then '' when l_returnflag = 'R' and l_linenumber = 2 then concat('', {_SALE} + {_COUPON}) "
     f"when l_returnflag = 'R' and l_linenumber = 3 then concat('', {_SALE} * 2) "
     f"when l_returnflag = 'R' then concat('', {_SALE}) when l_returnflag = 'A' then '--' else '' end"),
    ("bm", formula.HEADERS["BM"], "concat('', cast(l_quantity as bigint), '件')"),
    ("aj", formula.DISCOUNTS["AJ"], plain(f"concat('', {cents('l_discount * 100')})")),
    ("ak", formula.DISCOUNTS["AK"], plain(f"concat('', {cents('l_tax * 50')}, '元')")),
    ("al", formula.DISCOUNTS["AL"], plain("'-0.30'")),
    ("am", formula.DISCOUNTS["AM"], plain("nullif('', '')")),
    ("ai", formula.HEADERS["AI"], plain(f"case when l_tax > 0.05 then concat('', {cents('l_tax * 100')}) else '-1.5' end")),
    ("as_fee", formula.HEADERS["AS"], plain(f"concat('', {cents('l_extendedprice * 0.01')})")),
    ("at_fee", formula.HEADERS["AT"], plain(f"concat('', {cents('l_extendedprice * 0.002')})")),
    ("au", formula.HEADERS["AU"], plain("'1.50'")),
    ("ba", formula.HEADERS["BA"], plain(f"concat('', {cents('l_extendedprice * l_tax * 0.1')})")),
]
STAMPS = [
    ("user_id", "concat('U', l_suppkey % 2)"),
    ("platform", f"'{PLATFORM}'"),
    ("upload_id", "concat('ULP-', l_partkey % 2)"),
    ("job_id", "concat('job-', l_partkey % 2)"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


PLACE = ("source_path", "source_file", "source_line", "file_block")


def evenly_read(spark: SparkSession, sf_dir: str, table: str) -> bool:
    """Whether the tasks that read a table share its rows: none has more than twice the even share of a core."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _evenly_read:
        tasks = read(spark, sf_dir, table).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"))
        most, rows = tasks.agg(F.max("rows"), F.sum("rows")).first()
        _evenly_read[key] = bool(rows) and most * spark.sparkContext.defaultParallelism <= 2 * rows
    return _evenly_read[key]


_evenly_read: dict[tuple[str, str, str], bool] = {}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the place of each row in its file. A file that readers cannot divide, such as one of a single row group, is
    staged once as several files; else rows are read where they lie."""
    placed = with_file_position(read(spark, sf_dir, "lineitem"))
    if evenly_read(spark, sf_dir, "lineitem"):
        return placed

    def write(folder):
        placed.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "source_line").write.parquet(folder)

    return spark.read.parquet(written(spark, sf_dir, "lines", write))


def derive(table: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Named expressions over a table, with the place of the row where known."""
    place = [c for c in PLACE if c in table.columns]
    return table.select(*place, *[F.expr(e).alias(n) for n, e in columns])


def wechat_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement sheet with its headers, and the stamps of the upload."""
    return derive(lineitem(spark, sf_dir), [(h, e) for _, h, e in WECHAT] + STAMPS)


def wechat_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped facts of the whole sheet in table form."""
    facts = formula.formula_facts(wechat_raw(spark, sf_dir))
    return ingest.fact_table(ingest.stamp(facts))


def placed(ordered: DataFrame) -> DataFrame:
    """An ordered table with the place of each row, from 1: written as it is sorted, then numbered by its parts."""
    folder = new_folder(ordered.sparkSession, "ordered")
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    back = ordered.sparkSession.read.parquet(folder).withColumn("_part", F.shiftright("_id", 33))
    sizes = back.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_id") - F.shiftleft("_part", 33)
    return back.join(starts, "_part").withColumn("place", F.col("_before") + inside + 1).drop("_id", "_part", "_before")


_written: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """Folder of a table that is written once per application and then shared by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        folder = new_folder(spark, kind)
        write(folder)
        _written[key] = folder
    return _written[key]


def fact_root(spark: SparkSession, sf_dir: str) -> str:
    """Rows are gathered by folder before they get their hashes, which are half of a row and do not compress in a shuffle."""
    def write(folder):
        facts = formula.formula_facts(wechat_raw(spark, sf_dir), gather=PARTITIONS)
        store.write_facts(ingest.fact_table(ingest.stamp(facts)), folder, even=False)

    return written(spark, sf_dir, "facts", write)


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_facts(spark, fact_root(spark, sf_dir))


def effective_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of latest versions that views read; stored_facts is the scan by job. All facts come from one commit. Rows whose key
    stands once are read where the facts lie and not written again; of the others the last ones are written. Where very many keys
    stand again, all latest rows are, so that views need not shuffle the facts to leave the earlier ones out."""
    facts = stored_facts(spark, sf_dir)
    committed = facts.withColumn("seq", F.lit(1).cast("long"))
    hashes = written(spark, sf_dir, "repeated", lambda f: repeated_hashes([facts], ROW_KEY).write.parquet(f))
    repeated = spark.read.schema(f"{HASH} long").parquet(hashes)
    count = repeated.count()
    if count > MANY:
        return store.read_facts(spark, written(
            spark, sf_dir, "effective", lambda f: store.write_facts(latest_facts(committed, repeated=repeated), f)))
    if not count:  # known to be empty before plans are made
        return facts
    last = written(spark, sf_dir, "latest", lambda f: store.write_facts(
        last_rows(among(committed, ROW_KEY, repeated), ROW_KEY, LATEST), f))
    return alone(facts, ROW_KEY, repeated).unionByName(store.read_facts(spark, last))


TWICE = 100_000_000  # lines further down: where a key stands again in one upload


def uploads_of(facts: DataFrame) -> list[tuple[str, DataFrame]]:
    """Three uploads in their order: all facts; the first lines of one month again, changed; some of those again, each twice.
    The jobs' names do not sort as they come."""
    month = facts.where((F.col("user_id") == USER) & (F.col("platform") == PLATFORM) & (F.col("year") == YEAR)
                        & (F.col("month") == MONTH) & (F.col("line_no") == 1))

    def changed(rows: DataFrame, job: str, mark: Column, more: Column) -> DataFrame:
        money = {n: (F.col(n) + 1).cast("decimal(28,2)") for n in ("recv_customer", "net_received")}
        return rows.withColumns(
            {"job_id": F.lit(f"job-{job}"), "upload_id": F.lit(f"ULP-{job}"), "row_hash": F.concat("row_hash", mark),
             "qty_sold": (F.col("qty_sold") + more).cast("decimal(28,2)"), **money})

    doubled = month.where("cast(order_id as bigint) % 2 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = changed(doubled, "9", F.concat(F.lit("y"), F.col("k").cast("string")), F.col("k") + 2)
    return [("first", facts), ("again", changed(month, "10", F.lit("x"), F.lit(1))),
            ("twice", twice.withColumn("source_line", F.col("source_line") + TWICE * F.col("k")).drop("k"))]


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """A ledger of those uploads."""
    def write(root):
        for label, rows in uploads_of(stored_facts(spark, sf_dir)):
            upload.upload(Ledger(spark, root), rows, label, placed=True)

    return Ledger(spark, written(spark, sf_dir, "ledger", write))


def month_of(book: Ledger) -> DataFrame:
    return book.months(user_id=USER, platform=PLATFORM, year=YEAR, month=MONTH)


def rollup_root(spark: SparkSession, sf_dir: str) -> str:
    return written(
        spark, sf_dir, "rollup", lambda f: store.write_rollup(month_sku(stored_facts(spark, sf_dir)), f)
    )


def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_rollup(spark, rollup_root(spark, sf_dir))

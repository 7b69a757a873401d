"""Two-file platforms as a stream: an order file waits for its settlement or finance file, and the other way round.

Each tenant, platform and month is a state of its own: the latest file of every role, by the time of arrival. Whenever a batch
brings a file and all roles are there, the pair goes out; so a file that comes again makes the pair anew. A month that still lacks
a role when the delay has passed since the stream has seen its first file is reported, once for each wait. No file is ever too
late: the delay runs by the clock, not by the times of files. State lives in the stream's checkpoint: a restart neither loses
files nor gives a pair twice.

Pairs are joined by the rules of plans/two_file.py and replace their month in the ledger, so that the last pair counts,
whatever the order in which files came.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.ingest import fact_table, stamp, two_file_facts
from ..plans.upload import upload
from ..operators.rollup import merge_duplicates
from ..sources.ledger import PERIOD, Ledger
from ..sources.sheets import settlement_sheet

ROLES = {"xiaohongshu": ("order", "settlement"), "douyin": ("order", "finance")}
PAIR = "user_id string, platform string, year int, month int, status string, files map<string,string>, missing string, made long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """Rows of (file_type, path, arrived_at) of one month to pairs and reports."""

    def __init__(self, roles: Mapping[str, Sequence[str]], delay_ms: int):
        self.roles, self.delay = {k: tuple(v) for k, v in roles.items()}, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "role string", "path string, at long")
        self.made = handle.getValueState("made", "n long")

    def _missing(self, platform: str) -> list[str]:
        return [r for r in self.roles.get(platform, ()) if not self.files.containsKey((r,))]

    def _row(self, key, status: str, files: dict | None, missing: str | None) -> Row:
        n = self.made.get()[0] if self.made.exists() else 0
        return Row(user_id=key[0], platform=key[1], year=key[2], month=key[3], status=status, files=files, missing=missing, made=n)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = 0
        for row in rows:
            time, seen = int(row.arrived_at.timestamp() * 1000), int(row.seen_at.timestamp() * 1000)
            if row.file_type not in self.roles.get(key[1], ()):
                continue
            known = self.files.getValue((row.file_type,)) if self.files.containsKey((row.file_type,)) else None
            if known is None or (time, row.path) >= (known[1], known[0]):
                self.files.updateValue((row.file_type,), (row.path, time))
        missing = self._missing(key[1])
        timers = list(self.handle.listTimers())
        if missing:
            if not timers:
                self.handle.registerTimer(seen + self.delay)
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.made.update((1 + (self.made.get()[0] if self.made.exists() else 0),))
        yield self._row(key, "complete", {r: self.files.getValue((r,))[0] for r in self.roles[key[1]]}, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        missing = self._missing(key[1])
        if missing:
            yield self._row(key, "missing", None, ",".join(missing))

    def close(self) -> None:
        pass


def pairs(uploads: DataFrame, delay: str = "1 day", roles: Mapping[str, Sequence[str]] = ROLES) -> DataFrame:
    """Stream of pairs and reports from a stream of uploads (user_id, platform, year, month, file_type, path, arrived_at).
    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` = STATE_STORE."""
    spark = uploads.sparkSession
    millis = int(spark.sql(f"select cast(interval '{delay}' as interval day to second) as d").selectExpr(
        "extract(day from d) * 86400000 + extract(hour from d) * 3600000 + extract(minute from d) * 60000 "
        "+ extract(second from d) * 1000").first()[0])
    # The time at which a batch is read is the event time: it only ever grows, so that no file is late.
    seen = uploads.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "0 seconds")
    return seen.groupBy(*PERIOD).transformWithState(Pairing(roles, millis), PAIR, "Append", "EventTime")


def ingest_pairs(uploads: DataFrame, root: str, staging: str, checkpoint: str, job: str, delay: str = "1 day") -> StreamingQuery:
    """Facts of every pair into the ledger below ``root``, each pair one job and one commit in place of its month; reports of
    missing files to ``root``/missing. The pairs of a batch are named on the driver, one row each, as jobs are."""

    def each(found: DataFrame, batch: int) -> None:
        spark: SparkSession = found.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        kept = f"{staging}/pairs-{batch}"
        found.write.mode("overwrite").parquet(kept)
        written = spark.read.schema(PAIR).parquet(kept)
        written.where("status = 'missing'").select(*PERIOD, "missing").write.mode("overwrite").json(f"{root}/missing/batch={batch}")
        for pair in written.where("status = 'complete'").orderBy(*PERIOD).collect():
            name = "-".join(str(x) for x in (job, pair.user_id, pair.platform, pair.year, pair.month, pair.made))
            sheets = [settlement_sheet(spark, pair.files[role], "two_file", f"{staging}/{name}-{role}") for role in ROLES[pair.platform]]
            facts = two_file_facts(*sheets, pair.platform, pair.year, pair.month)
            stamped = stamp(facts, platform=pair.platform, user_id=pair.user_id, upload_id=f"ULP-{name}", job_id=name)
            # Orders may bring a SKU in several rows; these rules number no lines, so equal keys are put together.
            merged = merge_duplicates(fact_table(stamped)).drop("source_merge_count")
            upload(Ledger(spark, root), merged, name, "replace")

    return (pairs(uploads, delay).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

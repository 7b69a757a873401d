"""Tables that change together.

A ledger holds named tables, partitioned by tenant, platform and month, under one folder, and a log of commits. A change
writes its rows to folders of its own (``table/token=..``), lists the months it brings in one entry, and publishes that
entry by one rename to the next number of the log. Until then no reader sees any of it, and afterwards all of it: a job
killed on the way leaves folders that nobody reads. A reader takes the state of one version, of all tables alike.

What a month holds at a version: the rows of its last ``replace`` and of every ``append`` behind that, or behind its
last ``clear``, without the folders that a later commit has taken out of it (``drop``). Rows come with ``seq``, the number of
the commit that wrote them, which orders versions of a row whatever the names of jobs are.

    ledger = Ledger(spark, "s3a://lake/settlement")
    change = ledger.begin("upload-17")
    facts = change.append("facts", facts)
    change.replace("effective", rows, months)
    change.commit()
    ledger.read("effective", FACT_TABLE, ledger.months(user_id="u1", year=2024, month=10))

A label is committed once: ``begin`` with a known one gives a change that is done. Two changes that were begun on one version
and touch a month of one table exclude each other; the later commit raises Conflict and can be begun anew. The rename must
fail where its target exists, as it does in HDFS; other stores need a committer that does.

What reaches the driver are names: of commits since the last checkpoint, and of those that still hold rows of the months
read. A log of up to LOCAL_BYTES is kept there whole, each entry read once, so that small commits wait for no jobs on it; a
larger one is read where it lies. ``checkpoint`` puts the log together, ``compact`` a table's months into one commit each, and ``vacuum`` deletes what
no version from a given one on can see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .store import write_partitioned

PERIOD = ("user_id", "platform", "year", "month")
CHECKPOINT_EVERY = 50  # commits
LOOKUP_VALUES = 1_000_000  # row keys that the Bloom filter of a row group is made for
LOCAL_BYTES = 4 << 20  # of a log that the driver keeps
LOCAL_ROWS = 10_000  # months, or folders of months, that the driver lists

_MONTH = [StructField("user_id", StringType()), StructField("platform", StringType()), StructField("year", IntegerType()),
          StructField("month", IntegerType())]
_ENTRY = StructType([
    StructField("name", StringType()), StructField("mode", StringType()), *_MONTH, StructField("token", StringType()),
    StructField("label", StringType())])
_LOGGED = StructType([*_ENTRY.fields, StructField("seq", LongType())])
UNIT = StructType([*_MONTH, StructField("token", StringType())])
_UNIT = StructType([*UNIT.fields, StructField("seq", LongType())])

_kept: dict[tuple[str, int], list[tuple]] = {}  # entries of logs by path and time of their folder


Places = DataFrame | list[tuple]  # months, or (month, token), as a table or as the driver's list


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: StructType) -> DataFrame:
    """A table of a few rows of the driver, whose size the optimizer knows."""
    kinds = {StringType(): pa.string(), IntegerType(): pa.int32(), LongType(): pa.int64()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(
        pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.fieldNames()), schema)


def listed(places: DataFrame) -> Places:
    """Distinct places as a list where they are few, else as the table they are."""
    rows = [tuple(r) for r in places.distinct().limit(LOCAL_ROWS + 1).collect()]
    return places.distinct() if len(rows) > LOCAL_ROWS else sorted(rows, key=repr)


class Conflict(Exception):
    """Another commit has touched the same months since the change was begun."""


def same_month(left: DataFrame, right: DataFrame, how: str, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Join on months, or more keys, where missing parts are equal as well; columns of the left, then others of the right."""
    a, b = left.alias("_a"), right.alias("_b")
    on = reduce(Column.__and__, [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys])
    joined = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("_a.*", *[F.col(f"_b.{c}") for c in right.columns if c not in left.columns])


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Folders

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the entries in a folder of the log, ascending."""
        path = f"{self.root}/{folder}"
        files = self._files(path)
        if not files.exists(self._path(path)):
            return []
        names = (f.getPath().getName() for f in files.listStatus(self._path(path)))
        return sorted(int(n.removeprefix("seq=")) for n in names if n.startswith("seq="))

    def _publish(self, source: str, folder: str, number: int) -> bool:
        """Rename to the number's name; false if there is an entry of that number."""
        jvm, target = self.spark._jvm, f"{self.root}/{folder}/seq={number}"
        self._files(target).mkdirs(self._path(f"{self.root}/{folder}"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(target).toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(source), self._path(target), plain)
        except Exception as problem:
            if "FileAlreadyExists" in str(problem):
                return False
            raise
        return True

    # Reading

    def version(self) -> int:
        """Number of the last commit, 0 if there is none."""
        return max(self._numbers("_log") + self._numbers("_base"), default=0)

    def entries(self, version: int | None = None, after: int | None = None) -> DataFrame:
        """The log up to a version: what the last checkpoint before it kept, and all later entries."""
        version = self.version() if version is None else version
        base = max([n for n in self._numbers("_base") if n <= version], default=0) if after is None else after
        paths = [f"{self.root}/_log/seq={n}" for n in self._numbers("_log") if base < n <= version]
        logged = self.spark.createDataFrame([], _LOGGED)
        if paths:
            logged = self.spark.read.schema(_LOGGED).option("basePath", f"{self.root}/_log").parquet(*paths)
        if after is None and base:
            logged = logged.unionByName(self.spark.read.schema(_LOGGED).parquet(f"{self.root}/_base/seq={base}"))
        return logged

    def _local(self, version: int) -> list[tuple] | None:
        """The log up to a version as rows of the driver, None where it is large. Entries never change once they are published, so
        each is read once; the time of its folder tells it from one of another ledger at the same path."""
        base = max([n for n in self._numbers("_base") if n <= version], default=0)
        names = [f"_base/seq={base}"] * bool(base) + [f"_log/seq={n}" for n in self._numbers("_log") if base < n <= version]
        files, keys, size = self._files(self.root), {}, 0
        for name in names:
            path = self._path(f"{self.root}/{name}")
            keys[name] = (str(path), files.getFileStatus(path).getModificationTime())
            size += 0 if keys[name] in _kept else files.getContentSummary(path).getLength()
        if size > LOCAL_BYTES:
            return None
        unread = [n for n in names if keys[n] not in _kept]
        for folder in ("_base", "_log"):
            some = [n for n in unread if n.startswith(folder)]
            if some:
                reader = self.spark.read.schema(_LOGGED)
                if folder == "_log":  # whose numbers are in the names; a checkpoint holds them
                    reader = reader.option("basePath", f"{self.root}/_log")
                read = reader.parquet(*[f"{self.root}/{n}" for n in some])
                rows = [tuple(r) for r in read.select(*_LOGGED.fieldNames(), F.col("_metadata.file_path")).collect()]
                for n in some:
                    _kept[keys[n]] = [r[:-1] for r in rows if f"/{n}/" in r[-1]]
        while sum(map(len, _kept.values())) > LOCAL_BYTES // 8:
            _kept.pop(next(iter(_kept)))
        return [r for n in names for r in _kept.get(keys[n], ())] if all(keys[n] in _kept for n in names) else None

    def _live(self, name: str, version: int | None) -> Places:
        """(month, token, seq) of everything a table holds at a version, as rows of the driver where the log is small."""
        version = self.version() if version is None else version
        local = self._local(version)
        if local is None:
            mine = self.entries(version).where(F.col("name") == name)
            reset = mine.where("mode not in ('append', 'drop')").groupBy(*PERIOD).agg(F.max("seq").alias("_reset"))
            live = same_month(mine.where("mode not in ('clear', 'drop')"), reset, "left").where("_reset is null or seq >= _reset")
            live = same_month(live, mine.where("mode = 'drop'"), "left_anti", (*PERIOD, "token"))
            return live.select(*PERIOD, "token", "seq")
        reset, dropped, mine = {}, set(), [r for r in local if r[0] == name]
        for _, mode, *month, token, _, seq in mine:
            if mode == "drop":
                dropped.add((*month, token))
            elif mode != "append":
                reset[(*month,)] = max(seq, reset.get((*month,), 0))
        return [(*month, token, seq) for _, mode, *month, token, _, seq in mine if mode not in ("clear", "drop")
                and seq >= reset.get((*month,), 0) and (*month, token) not in dropped]

    def units(self, name: str, version: int | None = None) -> DataFrame:
        """(month, token, seq) of everything a table holds at a version."""
        live = self._live(name, version)
        return local_table(self.spark, live, _UNIT) if isinstance(live, list) else live

    def months(self, **parts) -> DataFrame:
        """One month as a table, to read by; parts that are not given are missing."""
        return self.spark.range(0, 1, 1, 1).select(*[F.lit(parts.get(f.name)).cast(f.dataType).alias(f.name) for f in _MONTH])

    def read(self, name: str, schema: StructType, months: Places | None = None, version: int | None = None, token: bool = False) -> DataFrame:
        """Rows of a table with seq, all or those of the months, or of given folders of months as (month, token); with ``token``
        the folder of each row. Only folders that hold such rows are listed and read."""
        live = self._live(name, version)
        if isinstance(live, list) and isinstance(months, list):
            wanted = set(months)
            live = [u for u in live if u[:len(PERIOD)] in wanted or u[:-1] in wanted]
        elif months is not None:
            if isinstance(months, list):
                months = local_table(self.spark, months, StructType(_UNIT.fields[:len(months[0]) if months else len(PERIOD)]))
            live = local_table(self.spark, live, _UNIT) if isinstance(live, list) else live
            live = same_month(live, months, "left_semi", [c for c in (*PERIOD, "token") if c in months.columns])
        if isinstance(live, list):
            tokens = sorted({u[len(PERIOD)] for u in live})
            live = local_table(self.spark, live, _UNIT)
        else:
            tokens = sorted(r.token for r in live.select("token").distinct().collect())
        paths = [f"{self.root}/{name}/token={t}" for t in tokens]
        with_token = StructType([*schema.fields, StructField("token", StringType())])
        full = StructType([*schema.fields, StructField("seq", LongType()), *with_token.fields[-1:] * token])
        paths = [p for p in paths if self._files(p).exists(self._path(p))]
        if not paths:
            return self.spark.createDataFrame([], full).where(F.lit(False))  # which the optimizer knows to be empty
        rows = self.spark.read.schema(with_token).option("basePath", f"{self.root}/{name}").parquet(*paths)
        # A row per folder of the table, like the driver's list of them; joined otherwise, the whole table would be shuffled.
        return same_month(rows, F.broadcast(live), "inner", (*PERIOD, "token")).select(*full.fieldNames())

    def size(self, name: str, months: Places | None = None, version: int | None = None) -> int:
        """Bytes of the folders that hold a table's rows, of those months where log and months are the driver's lists."""
        live = self._live(name, version)
        if isinstance(live, list):
            wanted = set(months) if isinstance(months, list) else None
            tokens = {u[len(PERIOD)] for u in live if wanted is None or u[:len(PERIOD)] in wanted}
        else:
            tokens = {r.token for r in live.select("token").distinct().collect()}
        paths = [self._path(f"{self.root}/{name}/token={t}") for t in tokens]
        files = self._files(self.root)
        return sum(files.getContentSummary(p).getLength() for p in paths if files.exists(p))

    # Changing

    def begin(self, label: str) -> Change:
        return Change(self, label)

    def committed(self, label: str) -> int | None:
        """The number under which a label was committed."""
        local = self._local(self.version())
        if local is None:
            return self.entries().where(F.col("name").isNull() & (F.col("label") == label)).agg(F.max("seq")).first()[0]
        return max([r[-1] for r in local if r[0] is None and r[-2] == label], default=None)

    def checkpoint(self) -> int:
        """Put the log up to now together: labels, and what the tables hold. Later reads start from there."""
        version = self.version()
        entries = self.entries(version)
        labels = entries.where("name is null")
        names = [r.name for r in entries.where("name is not null").select("name").distinct().collect()]
        kept = [labels] + [self.units(n, version).select(
            F.lit(n).alias("name"), F.lit("append").alias("mode"), *PERIOD, "token", F.lit(None).cast("string").alias("label"), "seq")
            for n in names]
        staged = f"{self.root}/_staged/base-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, kept).select(*_LOGGED.fieldNames()).write.parquet(staged)
        self._publish(staged, "_base", version)
        return version

    def compact(self, name: str, schema: StructType, label: str, months: DataFrame | None = None, how=lambda rows: rows.drop("seq"),
                token: bool = False) -> int:
        """Months that several commits have written, each written again by one. ``how`` puts their rows together."""
        change = self.begin(label)
        if change.done is None:
            live = self.units(name, change.base)
            many = live.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("commits")).where("commits > 1").select(*PERIOD)
            if months is not None:
                many = same_month(many, months.select(*PERIOD), "left_semi")
            change.replace(name, how(self.read(name, schema, many, change.base, token)), many)
        return change.commit()

    def vacuum(self, since: int) -> list[str]:
        """Delete folders of which no version from ``since`` on shows a row, and checkpoints and entries before the last
        checkpoint up to it. Changes that are under way must be done: what is not in the log is taken for left behind."""
        base = max([n for n in self._numbers("_base") if n <= since], default=0)
        names = {r.name for r in self.entries().where("name is not null").select("name").distinct().collect()}
        gone = []
        for name in names:
            later = self.entries(after=since).where(F.col("name") == name).select("token")
            kept = {r.token for r in self.units(name, since).select("token").union(later).distinct().collect()}
            path = f"{self.root}/{name}"
            if self._files(path).exists(self._path(path)):
                for f in self._files(path).listStatus(self._path(path)):
                    if f.getPath().getName().startswith("token=") and f.getPath().getName().removeprefix("token=") not in kept:
                        gone.append(str(f.getPath()))
        for folder, numbers in (("_base", [n for n in self._numbers("_base") if n < base]),
                                ("_log", [n for n in self._numbers("_log") if n <= base])):
            gone += [f"{self.root}/{folder}/seq={n}" for n in numbers]
        for path in gone:
            self._files(path).delete(self._path(path), True)
        return gone


class Change:
    """Rows on their way into a ledger; ``done`` is the version if the label was committed before."""

    def __init__(self, ledger: Ledger, label: str):
        self.ledger, self.label, self.token = ledger, label, uuid.uuid4().hex
        self.done = ledger.committed(label)
        self.base = ledger.version()
        self._entries: list[DataFrame] = []
        self._rows: list[tuple] = []  # of entries whose months the driver has

    def _entry(self, name: str | None, mode: str, places: Places, token: str | None = None) -> None:
        """Months of one entry, or for ``drop`` (month, token)."""
        label = self.label if name is None else None
        if isinstance(places, list):
            self._rows += [(name, mode, *p[:len(PERIOD)], p[-1] if mode == "drop" else token or self.token, label) for p in places]
            return
        held = F.col("token") if mode == "drop" else F.lit(token or self.token)
        self._entries.append(places.select(
            F.lit(name).cast("string").alias("name"), F.lit(mode).alias("mode"), *PERIOD, held.alias("token"),
            F.lit(label).cast("string").alias("label")))

    def _write(self, name: str, rows: DataFrame, even: bool = True, token: str | None = None) -> DataFrame:
        """The rows in a folder of their own, and as they were written."""
        path = f"{self.ledger.root}/{name}/token={token or self.token}"
        lookup = {"row_key": LOOKUP_VALUES} if "row_key" in rows.columns else None
        write_partitioned(rows, path, PERIOD, mode="errorifexists", lookup=lookup, even=even)
        try:
            return self.ledger.spark.read.schema(rows.schema).parquet(path)
        except AnalysisException:
            return self.ledger.spark.createDataFrame([], rows.schema)

    def append(self, name: str, rows: DataFrame, even: bool = True, months: Places | None = None) -> DataFrame:
        """Add rows to a table's months; returns them as written. ``even=False`` is for rows read from folders of months;
        ``months`` are theirs, or more, where they are known."""
        written = self._write(name, rows, even)
        self._entry(name, "append", written.select(*PERIOD).distinct() if months is None else months)
        return written

    def replace(self, name: str, rows: DataFrame, months: Places | None = None, even: bool = True) -> DataFrame:
        """Rows in place of all that the months hold, by default those of the rows; months without rows become empty."""
        written = self._write(name, rows, even)
        if not isinstance(months, list):
            months = (written if months is None else months).select(*PERIOD).distinct()
        self._entry(name, "replace", months)
        return written

    def renew(self, name: str, rows: DataFrame, units: Places, even: bool = True) -> DataFrame:
        """Rows in place of what the units (month, token) hold, in a folder apart from that of appended rows: so these are not
        written again with them when others of the folder are replaced."""
        token = f"{self.token}-renewed"
        written = self._write(name, rows, even, token)
        self._entry(name, "drop", units)
        self._entry(name, "append", listed(written.select(*PERIOD)), token)
        return written

    def clear(self, name: str, months: Places) -> None:
        self._entry(name, "clear", months if isinstance(months, list) else months.select(*PERIOD).distinct())

    def scratch(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written once for this change alone, gone with its commit."""
        path = f"{self.ledger.root}/_scratch/{self.token}/{name}"
        rows.write.parquet(path)
        return self.ledger.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> int:
        """Publish everything at once; returns the version."""
        if self.done is not None:
            return self.done
        ledger = self.ledger
        self._entry(None, "label", [(None,) * len(PERIOD)])
        staged = f"{ledger.root}/_staged/{self.token}"
        entries = [*self._entries, local_table(ledger.spark, self._rows, _ENTRY)]
        reduce(DataFrame.unionByName, entries).coalesce(1).write.parquet(staged)
        mine = ledger.spark.read.schema(_ENTRY).parquet(staged).where("name is not null")
        checked = self.base
        while True:
            version = ledger.version()
            if version > checked:
                since = ledger.entries(version, after=checked)
                if not since.where(F.col("name").isNull() & (F.col("label") == self.label)).isEmpty():
                    raise Conflict(f"{self.label} was committed by another job")
                if not same_month(mine, since.where("name is not null"), "left_semi", ("name", *PERIOD)).isEmpty():
                    raise Conflict(f"months of {self.label} were changed since version {self.base}")
                checked = version
            if ledger._publish(staged, "_log", version + 1):
                break
        self.done = version + 1
        scratch = f"{ledger.root}/_scratch/{self.token}"
        ledger._files(scratch).delete(ledger._path(scratch), True)
        if self.done % CHECKPOINT_EVERY == 0:
            ledger.checkpoint()
        return self.done

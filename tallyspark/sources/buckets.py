"""A keyed log of rows in a fixed number of hash buckets.

Rows are appended in runs: every run sorts its rows into the buckets, one file each, so that the number of files of a batch
does not depend on how many datasets or users it touches. Spark reads such a table bucket by bucket: grouping it by its keys, or
joining it by them, moves none of it, and only the other side of a join is shuffled into the same buckets. Each key is in
one bucket, and what is known of it is one row after grouping, so no key is large on either side.

The log is kept in levels: runs are added to the current generation; ``compact`` writes its latest rows, one file a bucket, as
the next generation and then marks that as ready, in one step. The generation before stays until the next compaction, for
readers that still read it. One writer appends at a time.

Tables are registered in the session's catalog for their bucketing alone; all data lies below the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
NAMED = 1000  # values of the first key that a batch may have for its scan to skip what holds none of them


class Buckets:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, list(keys), buckets

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The last generation that is ready; 0 before any compaction."""
        files = self._files()
        if not files.exists(self._path(self.root)):
            return 0
        names = (f.getPath().getName() for f in files.listStatus(self._path(self.root)))
        return max((int(n.removeprefix("_ready-")) for n in names if n.startswith("_ready-")), default=0)

    def table(self, generation: int | None = None) -> str:
        """Name of a generation's table."""
        generation = self.generation() if generation is None else generation
        name = f"buckets_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{generation}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) "
                       f"into {self.buckets} buckets location '{self.root}/gen={generation}'")
        self.spark.catalog.refreshTable(name)
        return name

    def read(self, like: DataFrame | None = None) -> DataFrame:
        """All rows. Given rows to be looked up, row groups without any value of their first key are skipped where these are
        few; other rows may be left out."""
        rows = self.spark.table(self.table())
        if like is None:
            return rows
        first = self.keys[0]
        values = [r[0] for r in like.select(first).distinct().limit(NAMED + 1).collect()]
        return rows.where(F.col(first).isin(values)) if len(values) <= NAMED else rows

    def _insert(self, rows: DataFrame, table: str) -> None:
        dealt = rows.select(*self.schema.fieldNames()).repartition(self.buckets, *self.keys)
        dealt.sortWithinPartitions(*self.keys).write.insertInto(table)

    def append(self, rows: DataFrame) -> None:
        self._insert(rows, self.table())

    def compact(self, seq: str) -> int:
        """Write the latest row per key by ``seq`` as the next generation; returns its number."""
        now = self.generation()
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        latest = self.read().groupBy(*self.keys).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(*self.keys, "_last.*")
        files, ahead = self._files(), self._path(f"{self.root}/gen={now + 1}")
        files.delete(ahead, True)  # what a killed compaction has left
        self._insert(latest, self.table(now + 1))
        files.create(self._path(f"{self.root}/_ready-{now + 1}"), True).close()
        files.delete(self._path(f"{self.root}/gen={now - 1}"), True)
        return now + 1

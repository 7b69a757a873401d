"""Token counts of documents in flat token files without an index, by their end-of-document ids.

A file is a run of token ids of fixed width, each document followed by one separator id; it is read as blocks (file,
block, tokens), equally long but for the last, and a document may begin and end anywhere. Each block is searched on its
own, vectorised. What a block must know of those before it are two numbers: how many separators, and how many tokens
since the last. They come from a prefix scan over one summary row per block, in two levels: sums over segments of
SEGMENT blocks, a scan over a file's segments, then a scan within each segment. So no task holds a whole file.

Ids take 2 bytes each, or 4 where the vocabulary has more than 65,536. Texts are encoded plainly: what looks like the separator
in a text is text, so that the separator's id stands behind documents only.

Defined cases: no blocks give no documents; two neighbouring separators enclose a document of no tokens; tokens after the
last separator are one more document, marked incomplete; an empty or null block counts as empty. Block numbers of a file
must be distinct; they may have gaps. Documents: null text is empty, null ids stay null, repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tables import written
from .tokens import VOCABULARY, Encoder

SEPARATOR = 50256
WIDTH = 2  # bytes per id of files given without a vocabulary
BLOCK = 250_000  # bytes; from half a megabyte on, the JVM sets objects apart and grows with them
SEGMENT = 4096  # blocks
_TEXTS = 1000


def width_of(vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> int:
    """Bytes of every id, the separator included."""
    return max(Encoder.of(vocabulary, plain=True).width(), 2 if separator < 1 << 16 else 4)


def files_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
             separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Flat token files, one per task, as blocks (file, block, tokens); below block 0 the ids of the file's documents in
    order (-1, -2, ..), nulls as the least whole number, for whoever wants to know which document is which."""
    table = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    width = width_of(vocabulary, separator)
    end = np.array([separator], f"<u{width}").tobytes()

    def work(batches) -> Iterator[pa.RecordBatch]:
        encoder, file, number = Encoder.of(vocabulary, plain=True), TaskContext.get().partitionId(), 0
        rest, order, order_number = bytearray(), [], 0

        def out(number, body):
            return pa.record_batch([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([body], pa.binary())],
                                   names=["file", "block", "tokens"])

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8")
            for at in range(0, batch.num_rows, _TEXTS):
                for found in encoder.encode([x or "" for x in batch.column(1).slice(at, _TEXTS).to_pylist()]):
                    rest += np.frombuffer(found, "<u4").astype(f"<u{width}").tobytes() + end
                while len(rest) >= block:
                    yield out(number, bytes(rest[:block]))
                    del rest[:block]
                    number += 1
            order_number += 1
            yield out(-order_number, ids.tobytes())
        if rest:
            yield out(number, bytes(rest))

    return table.mapInArrow(work, "file long, block long, tokens binary")


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of existing flat files. Spark reads each file whole here, so that a file must stay below 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(0, max(len(body), 1), block):
                    yield pa.record_batch([pa.array([name]), pa.array([k // block], pa.int64()), pa.array([body[k: k + block]], pa.binary())],
                                          names=["file", "block", "tokens"])

    return files.mapInArrow(work, "file string, block long, tokens binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete) of every document; start counts the file's ids, separators included."""
    kind = blocks.schema["file"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            places, sizes, last = [], [], []
            for body in batch.column(2).to_pylist():
                tokens = np.frombuffer(body or b"", f"<u{width}")
                at = np.flatnonzero(tokens == separator).astype("<i8")
                places.append(at.tobytes()), sizes.append(len(tokens)), last.append(int(at[-1]) if len(at) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(last, pa.int64()),
                                   pa.array(places, pa.binary())], names=["file", "block", "size", "last", "places"])

    found = written(blocks.select("file", "block", "tokens").mapInArrow(
        search, f"file {kind}, block long, size long, last long, places binary"), "separators")
    summary = found.select("file", "block", "size", (F.length("places") / 8).cast("long").alias("n"), "last",
                           F.floor(F.col("block") / SEGMENT).cast("long").alias("segment"))

    # Over any run of blocks: tokens, separators, and the place after the last separator, from the run's beginning.
    inside = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = summary.select(
        "*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_in"))
    rows = rows.withColumn("after", F.col("tokens_in") + F.col("last") + 1)
    rows = rows.withColumn("after_in", F.max("after").over(inside))
    segments = rows.groupBy("file", "segment").agg(F.sum("size").alias("s_size"), F.sum("n").alias("s_n"), F.max("after").alias("s_after"))
    whole = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("file", "segment", F.coalesce(F.sum("s_size").over(whole), F.lit(0)).alias("tokens_before"),
                               F.coalesce(F.sum("s_n").over(whole), F.lit(0)).alias("n_before"), "s_after")
    segments = segments.withColumn("after_before", F.coalesce(F.max(F.col("tokens_before") + F.col("s_after")).over(whole), F.lit(0)))
    scanned = rows.join(segments, ["file", "segment"]).select(
        "file", "block", (F.col("tokens_before") + F.col("tokens_in")).alias("base"), (F.col("n_before") + F.col("n_in")).alias("ordinal"),
        F.coalesce(F.col("tokens_before") + F.col("after_in"), "after_before").alias("begun"))

    def documents(batches):
        for batch in batches:
            out = [[], [], [], []]
            for k, (base, ordinal, begun, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))):
                ends = np.frombuffer(places, "<i8") + base
                starts = np.concatenate([[begun], ends + 1])[:-1] if len(ends) else ends
                out[0].append(np.full(len(ends), k)), out[1].append(ordinal + np.arange(len(ends)))
                out[2].append(starts), out[3].append(ends - starts)
            at, ordinal, start, size = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in out)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(ordinal), pa.array(start), pa.array(size),
                                   pa.array(np.ones(len(at), bool))], names=["file", "ordinal", "start", "n_tokens", "complete"])

    ended = found.join(scanned, ["file", "block"]).select("file", "base", "ordinal", "begun", "places").mapInArrow(
        documents, f"file {kind}, ordinal long, start long, n_tokens long, complete boolean")
    totals = segments.join(rows.groupBy("file", "segment").agg(F.sum("size").alias("s_size"), F.sum("n").alias("s_n")), ["file", "segment"])
    totals = totals.groupBy("file").agg(
        F.sum("s_size").alias("size"), F.sum("s_n").alias("ordinal"),
        F.max(F.coalesce(F.col("tokens_before") + F.col("s_after"), "after_before")).alias("start"))
    open_ = totals.where("size > start").select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"),
                                                F.lit(False).alias("complete"))
    return ended.unionByName(open_)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, and where the document lies, of documents laid out as flat files and found again by scanning."""
    files = written(files_of(documents, doc_id, text, **options), "tokens")

    def name(batches):
        for batch in batches:
            file, ids, place = [], [], []
            for f, first, body in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.frombuffer(body, "<i8")
                file.append(np.full(len(got), f)), ids.append(got), place.append(first + np.arange(len(got)))
            file, ids, place = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (file, ids, place))
            yield pa.record_batch([pa.array(file), pa.array(place), pa.array(ids, mask=ids == np.iinfo(np.int64).min)],
                                  names=["file", "ordinal", "doc_id"])

    lists = files.where("block < 0").withColumn("n", F.length("tokens") / 8)
    before = Window.partitionBy("file").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lists = lists.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"), "tokens")
    order = lists.mapInArrow(name, "file long, ordinal long, doc_id long")
    separator = options.get("separator", SEPARATOR)
    counts = scan(files.where("block >= 0"), separator, width_of(options.get("vocabulary", VOCABULARY), separator))
    return counts.join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")

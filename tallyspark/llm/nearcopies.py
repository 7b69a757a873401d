"""Near copies by SetSketch registers: bands of registers find candidates, a joint likelihood weighs them, sets decide.

A document's set is its distinct runs of five words (lower-cased A-Z, split at space and \\x09-\\x0D), as 64-bit hashes;
fewer words are one run. Register i of a SetSketch is floor(1 - log_b(x)), cut to 0..q+1, of the least x over the set,
x being exponentially distributed with rate a and fixed by hash and i. The greater of two registers is the register of
the union, so sketches merge. With b = 1.1 two registers agree with a probability close to the Jaccard similarity.

1. Documents with one set are one class, counted and merged by a digest of the set before anything is compared.
2. The registers of each class fall into bands; classes that agree in a band meet in its bucket.
3. In each bucket the least class is the pivot. Likelihood of the register comparison (given both set sizes) estimates
   the similarity; each class keeps its likeliest pivot if that estimate is not clearly too low.
4. These pairs are confirmed on full sets and joined to components.
5. In buckets that still hold several components, all classes outside the largest are compared with all of the bucket,
   by registers. Components between which some pair may be like enough form a cluster.
6. In each cluster, the members outside its largest component are compared with all members on full sets, likeliest
   first, until they are joined or no candidate is left. That gives the remaining links that join components.

Steps 5 and 6 work in blocks of bounded size and hand on at most one row per member and block, never pairs of a group
of copies, which step 4 has joined. At a similarity of 0.75 a pair shares no band with probability 1e-5 (40 bands of 5
registers), and falls below the estimate's limit, 5 standard deviations away, with probability 1e-6. Links are exact.

Defined cases: null and wordless texts have an empty set and stay alone; rows of one id count as one node; rows without an
id stay alone, with a null component, and are kept. Only the columns named are read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import written
from .texts import mix, shingle_hashes, slices, utf8, word_hashes

WORDS = 5
PERCENT = 75
BASE = 1.1
RATE = 20.0
TOP = 254  # q: registers hold 0..q+1
BANDS, ROWS = 40, 5
LEAST_ESTIMATE = 0.6
BLOCK = 512  # classes of a bucket compared at a time
_factors = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The set of every text, ascending."""
    values, ranges = shingle_hashes(*word_hashes(data, offsets), words)
    return [np.unique(values[a:b]) for a, b in zip(ranges[:-1], ranges[1:])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch of every set (sets x registers); of an empty set all registers are 0."""
    out = np.zeros((len(sets), len(_factors)), np.uint8)
    full = np.array([i for i, s in enumerate(sets) if len(s)], int)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    scaled = np.empty_like(values)
    for k, factor in enumerate(_factors):
        np.multiply(values, factor, out=scaled)
        least = (np.minimum.reduceat(scaled, starts).astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
        out[full, k] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1)
    return out


def merged(*sketches: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets."""
    return np.maximum.reduce(sketches)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, row by row, given registers and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v, c, log = 1 - u, (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the slope of the log-likelihood falls: halve the interval that holds its zero
        j = (low + high) / 2
        in_a, in_b = 1 - c * (u - v * j), 1 - c * (v - u * j)
        p_more, p_less = np.maximum(-np.log(in_a) / log, 1e-12), np.maximum(-np.log(in_b) / log, 1e-12)
        d_more, d_less = -c * v / (log * in_a), -c * u / (log * in_b)
        slope = more * d_more / p_more + less * d_less / p_less - same * (d_more + d_less) / (1 - p_more - p_less)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def sketches(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and registers of every row."""

    def work(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sizes, digests, marks = [], [], []
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                rows = registers(sets)
                for s, row in zip(sets, rows):
                    sizes.append(len(s))
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    marks.append(row.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                   pa.array(marks, pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, "doc_id long, n_shingles long, digest binary, registers binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node): the bucket is the number of the band and its registers as they are."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1)).reshape(batch.num_rows, BANDS, ROWS).astype(np.int64)
            keys = np.repeat(np.arange(BANDS)[None, :], batch.num_rows, axis=0)
            for k in range(ROWS):
                keys = keys << 8 | rows[:, :, k]
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(nodes)], names=["bucket", "node"])

    return classes.select("node", "registers").mapInArrow(work, "bucket long, node long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimate, without those clearly too unlike."""
    sides = [classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
             for x in "ab"]

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(f"n_{x}").to_numpy().astype(float) for x in "ab")
            found = estimate(_matrix(batch.column("r_a")), _matrix(batch.column("r_b")), n_a, n_b)
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "estimate"])
            yield out.filter(pa.array(found >= LEAST_ESTIMATE))

    near = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")  # else the sizes alone rule it out
    return pairs.join(sides[0], "a").join(sides[1], "b").where(near).mapInArrow(work, "a long, b long, estimate double")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id and more) with the set of the document as bytes. Both sides are shuffled, whatever
    their sizes: texts are too large to be sent anywhere twice, and small lists too unsure to stay small."""
    names = wanted.columns[1:]
    table = documents.hint("merge").join(wanted, "doc_id").select("doc_id", *names, "text")

    def work(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            out = []
            for a, b in slices(offsets):
                out += [s.tobytes() for s in shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])]
            yield pa.record_batch([*batch.columns[:-1], pa.array(out, pa.binary())], names=["doc_id", *names, "items"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[:-1])
    return table.mapInArrow(work, f"{kinds}, items binary")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose full sets are as like as asked for.

    Each set goes where its partner's is needed: to the pair's b, next to b's own set.
    """
    wanted = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("b")).union(pairs.select("b", "b")).distinct()

    def compare(batches):
        for batch in batches:
            linked = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                      for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    table = written(_sets(documents, wanted).withColumnRenamed("doc_id", "a"), "sets")
    own = table.where("a = b").select("b", F.col("items").alias("own"))
    return table.where("a <> b").join(own, "b").select("a", "b", "items", "own").mapInArrow(compare, "a long, b long")


class _Union:
    """Components of numbers that are joined one by one."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, node, component, ..) of keys with several components, dealt so that each row outside the key's largest
    component (``minor``) meets every row of the key in one block (i, j)."""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    plan = sizes.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("largest"))
    plan = plan.where("most < n").select(
        key, "largest", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("n") / (8 * BLOCK)).cast("int").alias("alls"))
    dealt = rows.join(plan, key).withColumn("at", F.expr(
        """concat(transform(sequence(0, minors - 1), k -> struct(k as i, int(pmod(xxhash64(node, 1), alls)) as j, false as minor)),
                  if(component = largest, array(), transform(sequence(0, alls - 1), k -> struct(
                     int(pmod(xxhash64(node, 2), minors)) as i, k as j, true as minor))))"""))
    return dealt.withColumn("at", F.explode("at")).select(*rows.columns, "at.i", "at.j", "at.minor")


class _Members:
    """Rows of one block: who may be like whom, by registers."""

    def __init__(self, table):
        self.node, self.component = (table.column(c).to_numpy() for c in ("node", "component"))
        self.size = table.column("n_shingles").to_numpy().astype(float)
        self.marks = _matrix(table.column("registers").combine_chunks())
        minor = table.column("minor").to_numpy(zero_copy_only=False)
        self.left, self.right = np.flatnonzero(minor), np.flatnonzero(~minor)

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of other components that share a band with row i and may be like enough, and their estimates."""
        j = self.right[self.component[self.right] != self.component[i]]
        j = j[100 * np.minimum(self.size[j], self.size[i]) >= PERCENT * np.maximum(self.size[j], self.size[i])]
        same = self.marks[j] == self.marks[i]
        near = same.mean(axis=1) >= LEAST_ESTIMATE - 0.1  # registers agree about as often as elements do
        near[near] = same[near].reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)
        j = j[near]
        if not len(j):
            return j, np.empty(0)
        found = estimate(np.repeat(self.marks[i][None], len(j), axis=0), self.marks[j], self.size[i], self.size[j])
        return j[found >= LEAST_ESTIMATE], found[found >= LEAST_ESTIMATE]


def _clusters(buckets: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component, cluster) of the classes that some class of another component may be like."""
    rows = buckets.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = _in_blocks(rows.select("bucket", "node", "component"), "bucket")
    rows = rows.join(classes.select("node", "n_shingles", "registers"), "node")

    def near(table):
        members, joined, met = _Members(table), _Union(), set()
        for i in members.left.tolist():
            j, _ = members.candidates(i)
            if len(j):
                met.add(i), met.update(j.tolist())
                for other in np.unique(members.component[j]).tolist():
                    joined.join(int(members.component[i]), other)
        at = np.array(sorted(met), int)
        component = members.component[at]
        roots = np.array([joined.root(int(c)) for c in component], np.int64)
        return pa.table({"node": members.node[at], "component": component, "root": roots})

    found = written(rows.groupBy("bucket", "i", "j").applyInArrow(near, "node long, component long, root long"), "near")
    clusters = components(found.select(F.col("component").alias("a"), F.col("root").alias("b")))
    nodes = found.select("node", "component").distinct()
    return nodes.join(clusters.withColumnRenamed("component", "cluster"), nodes["component"] == clusters["node"]).select(
        nodes["node"], nodes["component"], "cluster")


def _links_across(clusters: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join components of one cluster."""
    wanted = written(_in_blocks(clusters, "cluster"), "blocks")
    members = wanted.select("node", "component", "cluster").distinct().join(classes.select("node", "n_shingles", "registers"), "node")
    with_sets = written(_sets(documents, members.withColumnRenamed("node", "doc_id")), "sets").withColumnRenamed("doc_id", "node")
    rows = wanted.select("node", "cluster", "i", "j", "minor").join(with_sets, ["node", "cluster"])

    def link(table):
        members, joined, out = _Members(table), _Union(), []
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        for i in members.left.tolist():
            j, found = members.candidates(i)
            mine = int(members.component[i])
            for k in j[np.argsort(-found)].tolist():
                other = int(members.component[k])
                if joined.root(mine) != joined.root(other) and _linked(sets[i], sets[k]):
                    joined.join(mine, other)
                    out.append((int(members.node[i]), int(members.node[k])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")


def near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = written(sketches(documents), "sketches")
    known = marks.where("digest is not null and doc_id is not null")
    classes = written(
        known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                                    F.first("registers").alias("registers")), "classes")
    several = _buckets(classes).groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = written(_buckets(classes).join(several.drop("n"), "bucket"), "buckets")
    starred = buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = _likely(starred, classes)
    best = likely.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
    links = written(confirm(written(best, "pairs"), documents), "links")
    parts = written(components(links), "parts")
    clusters = written(_clusters(buckets.select("bucket", "node"), parts, classes), "clusters")
    links = links.unionByName(written(_links_across(clusters, classes, documents), "links"))
    parts = written(components(links), "parts")
    classed = classes.select("digest", "node").join(parts, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    by_set = marks.select("doc_id", "n_shingles", "digest").join(classed, "digest", "left")
    return by_set.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

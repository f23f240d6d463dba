"""Near-duplicate vectors by p-stable hashing, checked by exact cosine.

Equal vectors form a class and are one node. Unit vectors at cosine c lie at the
Euclidean distance sqrt(2 - 2c); a hash is floor((g . x + b) / WIDTH) for a
Gaussian g, and a table's bucket joins `k` hashes. k follows from the number of
classes, so that unrelated vectors share a bucket with about `ROWS_A_BUCKET` others
at every size, and the number of tables follows from k, so that a pair at the
threshold is missed by all tables with a chance of at most `MISS` (more
similar pairs far less). All pairs of a bucket are compared in blocks of bounded
size, by one matrix product in double precision. A linked pair belongs to the first table in which it meets, so each is
counted once; a block passes on how many links each of its vectors has there, and as many links as join the same
vectors: at most two rows a vector, never the pairs.

Results for odd input: vectors that are NULL, empty, all zero, or hold NULL or
non-finite components link with nothing; vectors of different lengths never link;
repeated rows are rows of one class and count as links of each other; components are
named by their smallest id, NULL last. Nodes are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

from .cells import each_cell
from .common import mix64
from .components import components

WIDTH = 1.8
MISS = 1e-3
ROWS_A_BUCKET = 64
CELL = 1024
SEED = 11


def same_hash(distance: float) -> float:
    """Chance that one hash agrees for two points at this distance."""
    t = WIDTH / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """(hashes a table, tables) for so many classes."""
    far, near = same_hash(math.sqrt(2)), same_hash(math.sqrt(2 - 2 * threshold))
    k = max(1, round(math.log(max(classes / ROWS_A_BUCKET, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near ** k))


def _unit(rows) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that neither tiny nor huge components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Tables:
    """Buckets of unit vectors in all tables; the planes of a vector length are drawn once."""

    def __init__(self, k: int, tables: int):
        self.k, self.tables, self.made = k, tables, {}

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """(vector, table) as 64-bit numbers."""
        k, tables, size = self.k, self.tables, units.shape[1]
        if size not in self.made:
            draw = np.random.RandomState(SEED)  # its stream is the same in all versions
            self.made[size] = draw.standard_normal((size, k * tables)), draw.uniform(0, WIDTH, k * tables)
        turn, shift = self.made[size]
        steps = np.floor((units @ turn + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, k)
        bucket = np.broadcast_to(mix64(np.arange(tables, dtype=np.uint64) + np.uint64(size << 20)), steps.shape[:2])
        for j in range(k):
            bucket = mix64(bucket + steps[:, :, j])
        return bucket


def _hash(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Tables(k, tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column(1).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                nodes = batch.column(0).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == size)
                    bucket = hashes.buckets(_unit(np.array([vectors[i] for i in mine], dtype=np.float64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(mine))), pa.array(np.repeat(nodes[mine], tables))],
                        ["bucket", "table", "node"])
    return run


def _bytes(kind: str):
    """(node, size, vector) with the vector as the bytes of its components, as wide as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v, dtype=kind).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["node", "size", "vector"])
    return run


def _met_before(buckets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket of one of these tables."""
    out = np.zeros(len(a), dtype=bool)
    for table in range(buckets.shape[1]):
        out |= buckets[a, table] == buckets[b, table]
    return out


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n points reaches over the pairs."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(threshold: float, k: int, tables: int, kind: str):
    """Blocks, sorted by cell, to rows (a, b, n): what a vector's links in the block count (b is NULL), and links that join the same
    vectors as all links of the block do. A pair belongs to the first table in which it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Tables(k, tables)
        for cell in each_cell(batches):
            left, right = np.flatnonzero(cell["left"].astype(bool)), np.flatnonzero(cell["right"].astype(bool))
            n, nodes, sizes, table = len(cell["node"]), cell["node"], cell["size"].astype(np.float64), int(cell["table"][0])
            if n < 2 or not len(left) or not len(right):
                continue
            units = _unit(np.frombuffer(b"".join(cell["vector"]), dtype=kind).reshape(n, -1))
            i, j = np.nonzero(units[left] @ units[right].T >= threshold)
            a, b = left[i], right[j]
            if len(left) == n and len(right) == n:  # a part with itself
                a, b = a[a < b], b[a < b]
            if len(a):
                fresh = ~_met_before(hashes.buckets(units)[:, :table], a, b)
                a, b = a[fresh], b[fresh]
            if not len(a):
                continue
            count = np.bincount(a, sizes[b], n) + np.bincount(b, sizes[a], n)
            some, label = np.flatnonzero(count), _least_reached(n, a, b)
            joined = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[nodes[some], nodes[joined]]), pa.array([None] * len(some) + nodes[label[joined]].tolist(), pa.int64()),
                 pa.array(np.r_[count[some], np.zeros(len(joined))].astype(np.int64))], ["a", "b", "n"])
    return run


def similar_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Per row: key, n_links (other rows at cosine >= threshold), component_id and kept."""
    spark = vectors.sparkSession
    valid = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = cut(spark, vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).select(
        "id", "vector", F.coalesce(valid, F.lit(False)).alias("valid")).select(
        "id", "valid", F.when(F.col("valid"), F.xxhash64("vector")).alias("node"), "vector"), "vectors")
    classes = cut(spark, rows.where("valid").groupBy("node").agg(F.min("id").alias("rep"), F.count("node").alias("size"), F.any_value("vector").alias("vector")), "vector-classes")
    k, tables = plan(classes.count(), threshold)
    kind = "f4" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "f8"
    hashed = cut(spark, classes.select("node", "vector").mapInArrow(_hash(k, tables), "bucket bigint, table int, node bigint"), "vector-buckets")
    crowded = hashed.groupBy("bucket").agg(F.count("node").alias("n")).where("n > 1")
    packed = classes.select("node", "size", "vector").mapInArrow(_bytes(kind), "node bigint, size bigint, vector binary")
    members = hashed.join(crowded, "bucket").join(packed, "node")
    # Block (i, j) of a bucket, i <= j, holds its parts i and j; a bucket of one part is one block.
    parts = F.ceil(F.col("n") / CELL).cast("int")
    members = members.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int"))
    blocks = members.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "table", "node", "size", "vector",
        (F.col("part") <= F.col("other")).alias("left"), (F.col("part") >= F.col("other")).alias("right"))
    found = cut(spark, blocks.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _links(threshold, k, tables, kind), "a bigint, b bigint, n bigint"), "vector-links")
    beside = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("beside"))
    links = found.where("b IS NOT NULL").select("a", "b")
    labels = components(links)
    named = (classes.select("node", "rep", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
             .join(beside.withColumnRenamed("a", "node"), "node", "left"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("node", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "id")
    return rows.select("id", "node").join(named, "node", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))

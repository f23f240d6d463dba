"""Exact top-k inner products by norm buckets.

Vectors become integers floor(SCALE * x). All rows are ordered by length, longest first, and cut into groups;
query rows form groups of their own. A cell is a group of queries and a group of candidates and is
worked on by one task; a cell is not made when no product in it can reach any of the queries' bounds.
The k-th best product of a query among the longest rows is its first bound.

Inside a cell the candidates come in buckets of near length, longest first. A bucket asks of a query
the cosine t = bound / (|query| * longest of the bucket):

- t > 1: the bucket and all after it can't hold a better row (length pruning of the bucket);
- t below `COORDINATE_FROM`: length pruning, the rows with |row| >= bound / |query| are multiplied;
- t from there on: coordinate pruning. For the query's largest coordinates q_f a row at cosine t or more
  has its own within t q_f +- sqrt((1 - q_f^2)(1 - t^2)); rows outside one of these ranges are skipped.

All that are left are verified by their integer product, and the bound rises from bucket to bucket. Bounds are
taken with a margin over rounding and pass equal products on, so pruning loses no row and no
tie. Each cell returns at most k rows a query, and a query's cells meet in one ranking that
keeps k rows a task before the shuffle.

Results for odd input: vectors that are NULL or hold NULL or non-finite components, or such
whose scaled components aren't finite, take no part; empty vectors have product 0 with each other;
vectors of different lengths aren't compared; zero vectors take part; a repeated row is a
candidate of its own, also under the query's id; NULL ids are candidates only, and last among ties;
products beyond a long count as the nearest long; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.session import cut

from .cells import each_cell

SCALE = 256
BUCKET = 1024
QUERIES_A_GROUP = 8192
LEAST_GROUP, LARGEST_GROUP, GROUPS = 512, 65_536, 64  # candidates a group: rows / GROUPS, within these sizes
COMPONENTS_A_GROUP = 1 << 23  # and no more than these, for long vectors
SEEDS = 2048
COORDINATE_FROM = 0.9
FOCUS = 3
MARGIN = 1e-9
EXACT = float(1 << 52)
LONG = (1 << 63) - 1  # the nearest long is within plus and minus this


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, vector) to (row, id, dims, norm, vector): vector as the bytes of the narrowest type, by its length."""
    for batch in batches:
        rows, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for row, key, vector in zip(rows, ids, batch.column(2).to_pylist(), strict=True):
            with np.errstate(over="ignore"):
                x = np.floor(np.asarray(vector, dtype=np.float64) * SCALE)
            most = float(np.abs(x).max(initial=0.0))
            if not math.isfinite(most):
                continue
            kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
            out.append((row, key, len(x), most * float(np.linalg.norm(x / most)) if most else 0.0, x.astype(kind).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "id", "dims", "norm", "vector"])


def _matrix(vectors: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of a cell as doubles, which hold each scaled component exactly."""
    out = np.empty((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i] = np.frombuffer(v, dtype={2: np.int16, 4: np.int32, 8: np.float64}[len(v) // dims if dims else 8])
    return out


class _Cell:
    """One group of queries against one group of candidates, which come longest first."""

    def __init__(self, cell: dict[str, np.ndarray], k: int):
        asks, dims = cell["ask"].astype(bool), int(cell["dims"][0])
        self.k, self.dims = k, dims
        self.q_row, self.q_id, self.q_norm = cell["row"][asks], cell["id"][asks], cell["norm"][asks]
        self.bound = cell["bound"][asks].copy()
        self.row, self.id, self.named, self.norm = (cell[c][~asks] for c in ("row", "id", "named", "norm"))
        self.queries, self.rows = _matrix(cell["vector"][asks], dims), _matrix(cell["vector"][~asks], dims)
        self.best: list[list[tuple]] = [[] for _ in self.q_row]
        self.exact = self.q_norm.max(initial=0.0) * self.norm.max(initial=0.0) < EXACT
        unit = self.queries / np.where(self.q_norm > 0, self.q_norm, 1.0)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.at_focus = np.take_along_axis(unit, self.focus, axis=1)

    def _passing(self, products: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return products >= (bound if self.exact else bound - np.abs(bound) * 1e-12)

    def _products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products of each query with each row, as doubles where they are exact and else as longs."""
        if self.exact:
            return self.queries[queries] @ self.rows[rows].T
        left, right = ([[int(v) for v in x] for x in some] for some in (self.queries[queries], self.rows[rows]))
        return np.array([[max(-LONG, min(LONG, sum(map(mul, a, b)))) for b in right] for a in left], dtype=np.int64).reshape(len(left), len(right))

    def _keep(self, query: int, products: np.ndarray, rows: np.ndarray) -> None:
        """Take verified rows into the k best of a query and raise its bound."""
        good = self._passing(products, self.bound[query]) & (self.row[rows] != self.q_row[query])
        products, rows = products[good], rows[good]
        if not len(rows):
            return
        order = np.lexsort((self.row[rows], self.id[rows], ~self.named[rows], -products))[:self.k]
        held = self.best[query]
        held += [(-int(products[i]), not self.named[rows[i]], int(self.id[rows[i]]), int(rows[i])) for i in order]
        held.sort(key=lambda h: (h[0], h[1], h[2], self.row[h[3]]))
        del held[self.k:]
        if len(held) == self.k:
            self.bound[query] = max(self.bound[query], float(-held[-1][0]))

    def _by_length(self, queries: np.ndarray, begin: int, end: int) -> None:
        """Verify the rows that are long enough for each query's bound."""
        need = np.maximum(self.bound[queries], 0) / np.maximum(self.q_norm[queries], 1e-300) * (1 - MARGIN)
        order = np.argsort(-need, kind="stable")
        for lo in range(0, len(order), 256):
            some = queries[order[lo:lo + 256]]
            last = begin + int(np.searchsorted(-self.norm[begin:end], -need[order[lo:lo + 256]].min(), side="right"))
            rows = np.arange(begin, last)
            products = self._products(some, rows)
            for i in np.flatnonzero(self._passing(products, self.bound[some][:, None]).any(axis=1)).tolist():
                self._keep(int(some[i]), products[i], rows)

    def _by_coordinate(self, queries: np.ndarray, cosine: np.ndarray, begin: int, end: int) -> None:
        """Verify the rows whose coordinates leave the cosine possible."""
        unit = self.rows[begin:end] / np.where(self.norm[begin:end] > 0, self.norm[begin:end], 1.0)[:, None]
        cosine = np.clip(cosine * (1 - MARGIN), 0.0, 1.0)
        for query, t in zip(queries.tolist(), cosine.tolist(), strict=True):
            q, at = self.at_focus[query], self.focus[query]
            spread = np.sqrt(np.maximum(1 - q * q, 0) * (1 - t * t)) + MARGIN
            low, high = np.where(q >= -t, q * t - spread, -2.0), np.where(q <= t, q * t + spread, 2.0)
            left = np.flatnonzero((unit[:, at[0]] >= low[0]) & (unit[:, at[0]] <= high[0]))
            for j in range(1, len(at)):
                x = unit[left, at[j]]
                left = left[(x >= low[j]) & (x <= high[j])]
            if len(left):
                rows = begin + left
                self._keep(query, self._products(np.array([query]), rows)[0], rows)

    def search(self) -> None:
        for begin in range(0, len(self.row), BUCKET):
            end = min(begin + BUCKET, len(self.row))
            reach = self.q_norm * self.norm[begin]
            live = np.flatnonzero(reach * (1 + MARGIN) + MARGIN >= self.bound)
            if not len(live):
                return  # rows only get shorter and bounds higher
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where(reach[live] > 0, self.bound[live] / reach[live], -1.0)
            near = (cosine >= COORDINATE_FROM) & (self.dims > 0)
            if not near.all():
                self._by_length(live[~near], begin, end)
            if near.any():
                self._by_coordinate(live[near], cosine[near], begin, end)

    def result(self) -> pa.RecordBatch:
        rows = [(int(self.q_row[i]), int(self.q_id[i]), -score, None if unnamed else key, int(self.row[at]))
                for i, held in enumerate(self.best) for score, unnamed, key, at in held]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "score", "id", "row"])


def _search(k: int):
    """Cells, sorted by cell with the longest rows first, to the k best rows of each query in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in each_cell(batches):
            if columns["ask"].any() and not columns["ask"].all():
                cell = _Cell(columns, k)
                cell.search()
                yield cell.result()
    return run


FOUND = "query bigint, query_id bigint, score bigint, id bigint, row bigint"
CELL = ["cell", "ask", "row", "id", "named", "dims", "norm", "bound", "vector"]


def _searched(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Queries (with bound) and rows, both with `cell`, to what the cells find."""
    asked = queries.withColumn("ask", F.lit(True)).select(*CELL)
    offered = rows.withColumns({"ask": F.lit(False), "bound": F.lit(0.0)}).select(*CELL)
    return asked.unionByName(offered).repartition("cell").sortWithinPartitions("cell", F.col("norm").desc()).mapInArrow(_search(k), FOUND)


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each row whose key is divisible by `every`."""
    spark, x = vectors.sparkSession, F.col("vector")
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    plain = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(
        F.coalesce(usable, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "id", "vector")
    whole = cut(spark, plain.mapInArrow(_integers, "row bigint, id bigint, dims int, norm double, vector binary"), "integer-vectors")
    size = whole.agg(F.count("row").alias("rows"), F.max("dims").alias("dims"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    if not size["queries"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # Groups of near length, longest first; the row number splits equal lengths.
    group_rows = min(max(LEAST_GROUP, min(LARGEST_GROUP, size["rows"] // GROUPS)), max(1, COMPONENTS_A_GROUP // max(1, size["dims"])))
    by_length = ["dims", F.col("norm").desc(), "row"]
    rows = cut(spark, whole.repartitionByRange(math.ceil(size["rows"] / group_rows), *by_length).withColumns({
        "group": F.spark_partition_id(), "named": F.col("id").isNotNull()}).withColumn("key", F.col("id")).withColumn("id", F.coalesce("id", F.lit(0))), "length-groups")
    groups = cut(spark, rows.groupBy("dims", "group").agg(F.max("norm").alias("top")), "groups")
    some = math.ceil(size["queries"] / min(QUERIES_A_GROUP, max(1, COMPONENTS_A_GROUP // max(1, size["dims"]))))
    queries = rows.where(F.col("key") % every == 0).withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(some)).cast("int"))

    # First bounds from the longest rows, which stand in one group a vector length.
    first = groups.groupBy("dims").agg(F.min("group").alias("group"))
    longest = Window.partitionBy("dims").orderBy(F.col("norm").desc(), "row")
    seeds = rows.join(first, ["dims", "group"]).withColumn("place", F.row_number().over(longest)).where(F.col("place") <= SEEDS)
    seeds = seeds.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(some - 1))))
    cell = F.xxhash64("dims", "lot")
    seeded = _searched(queries.withColumns({"cell": cell, "bound": F.lit(float("-inf"))}), seeds.withColumn("cell", cell), k)
    bounds = cut(spark, seeded.groupBy(F.col("query").alias("row")).agg(F.when(F.count("score") == k, F.min("score").cast("double")).alias("bound")), "first-bounds")

    bounded = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    reached = bounded.join(groups.withColumnRenamed("group", "part"), "dims").where(F.col("norm") * F.col("top") * (1 + MARGIN) + MARGIN >= F.col("bound"))
    reached = reached.withColumn("cell", F.xxhash64("dims", "lot", "part"))
    cells = reached.groupBy("dims", F.col("part").alias("group"), "lot", "cell").agg(F.count("row").alias("asked"))
    found = _searched(reached, rows.join(cells, ["dims", "group"]), k)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")

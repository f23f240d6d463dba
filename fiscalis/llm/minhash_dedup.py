"""Near-duplicates by MinHash bands, verified with odd sketches and then on full sets.

1. Each document's set of word shingles gives `BANDS` band hashes of `BAND_ROWS`
   MinHash samples each, and an odd sketch: the least hash in each of `BINS` bins is
   a further MinHash sample, and all of them are folded into a parity bitmap of
   `SKETCH_BITS` bits. The population count of two sketches' XOR estimates how
   many samples differ, most precisely at high similarity (for sets smaller than the
   bins, it is nearly the size of the symmetric difference).
2. Documents with equal sets are one class; from here on a class is one node. Its text is
   fetched by the written number of one of its rows.
3. In each band bucket every node is paired with two leaders only, the bucket's least
   node and one drawn by a hash. Pairs whose sketches differ too much go; the rest are
   confirmed on the full shingle sets. Components of confirmed links follow.
4. Where a bucket still holds several components, nodes outside its largest
   component are compared, in blocks of bounded size, with all nodes of the bucket that
   belong to other components: by sketch, and at once on the full sets that come
   with the rows. Only links that join components leave a block. So nothing is
   skipped, and a bucket that is one component, however large, costs two comparisons a node.

A pair at the least similarity shares no band with probability
(1 - 0.8 ** 4) ** 32 < 1e-7, and its sketches differ too much with a chance below
1e-6. Shingles are held as 64-bit hashes. Nothing is sampled or capped.

Results for odd input: NULL and empty texts have an empty set and link with
nothing; rows with one id are judged as rows, and a component is named by its
smallest id, NULL last; repeated rows belong to one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

from .cells import each_cell
from .common import distinct, mix64, row_slices, text_buffer
from .components import components
from .words import SPACE_SEPARATORS, WordScanner, gram_hashes

BANDS, BAND_ROWS = 32, 4
SAMPLES = BANDS * BAND_ROWS
BINS = 1024
SKETCH_BITS = 2048
CELL = 1024  # rows of one side of a block
# Below so many rows (24 bytes each) a list of nodes is broadcast, else joined by shuffles.
BROADCAST_ROWS = 1_000_000


def most_odd(one, other, similarity: float, exp, sqrt):
    """XOR population count that sets of these sizes at `similarity` exceed with a chance below 1e-6.

    A bin of both sets agrees if the least hash of their union is in both. A sample that
    differs flips a bit of its own. The bound is five standard deviations above the
    mean, over the number of agreeing bins and over flips that cancel out. Works on
    numbers, arrays and columns, with their `exp` and `sqrt`.
    """
    def filled(n):
        return BINS * (1 - exp(n * (-1.0 / BINS)))
    union = (one + other) / (1 + similarity)
    both = filled(union)
    flips = filled(one) + filled(other) - both * (2 * similarity)
    left = exp(flips * (-2.0 / SKETCH_BITS))
    # The bins' samples are drawn from the union without replacement; a few elements more for uneven bins.
    by_bins = both * (4 * similarity * (1 - similarity)) * (1.05 - both / union) * left * left
    by_bits = (1 - left * left) * (SKETCH_BITS / 4) - flips * left * left
    return (1 - left) * (SKETCH_BITS / 2) + sqrt(by_bins + by_bits + 1.0) * 5 + 1


def _sets(data: np.ndarray, offsets: np.ndarray, scanner: WordScanner, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    tokens = scanner.scan(data, offsets)
    hashed, whole = gram_hashes(tokens, words)
    short = np.diff(tokens.first)
    fewer = {n: gram_hashes(tokens, n)[0] ^ np.uint64(n) for n in set(short[short < words].tolist()) - {0}}
    out = []
    for r, n in enumerate(short.tolist()):
        a = tokens.first[r]
        if n >= words:
            out.append(distinct(hashed[a:a + n - words + 1]))
        else:
            out.append(fewer[n][a:a + 1] if n else hashed[:0])
    return out


def _signature(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, (factor[:, None] * low[i:i + 4096] + shift[:, None]).min(axis=1), out=least)
    return least


def _odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of the least hash of each bin, as 64-bit words; `shingles` are sorted."""
    least = np.zeros(BINS, dtype=np.uint64)
    taken = np.zeros(BINS, dtype=bool)
    at = (shingles & np.uint64(BINS - 1)).astype(np.int64)
    least[at[::-1]] = shingles[::-1]  # the first of a bin is written last
    taken[at] = True
    bit = mix64(least[taken]) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def _samplers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(2 * SAMPLES, dtype=np.uint64) + np.uint64(77))
    return (seeds[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        one, two = mix64(shingles).sum(dtype=np.uint64), mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mix64(np.array([one ^ np.uint64(len(shingles))], dtype=np.uint64))[0].astype(np.int64)), int(two.astype(np.int64))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, (factor, shift) = WordScanner(SPACE_SEPARATORS, lower=True), _samplers()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets):
                sets = _sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], scanner, words)
                mins = np.array([_signature(s, factor, shift) for s in sets], dtype=np.uint32).reshape(-1, SAMPLES)
                bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
                for j in range(BAND_ROWS):
                    bands = mix64(bands + mins[:, j::BAND_ROWS])
                bands = mix64(bands + np.arange(BANDS, dtype=np.uint64))
                sketch = np.array([_odd_sketch(s) for s in sets], dtype=np.int64).reshape(-1, SKETCH_BITS // 64)
                keys = np.array([_set_key(s) for s in sets], dtype=np.int64).reshape(-1, 2)

                def lists(matrix: np.ndarray) -> pa.Array:
                    n, width = matrix.shape
                    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(matrix.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                     lists(bands), lists(sketch)], ["id", "row", "n_shingles", "node", "check", "bands", "sketch"])
    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(SPACE_SEPARATORS, lower=True)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets):
                sets = _sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], scanner, words)
                wanted = batch.column(0).slice(lo, hi - lo).to_pylist()
                rows = [(node, s.tobytes()) for node, s in zip(wanted, sets, strict=True) if len(s) and _set_key(s)[0] == node]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _cell_links(cell: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the queries and the rows of one block that join components not yet joined here.

    Two nodes that share several buckets are compared in that of the first band they share only.
    """
    rows, asked = np.flatnonzero(~cell["asked"]), np.flatnonzero(cell["asked"])
    sketch, bands, comps, sizes = cell["sketch"][rows], cell["bands"][rows], cell["comp"][rows], cell["size"][rows].astype(np.float64)
    here, of, sets, out = cell["bucket"][0], {}, {}, []

    def root(comp: int) -> int:
        while of.get(comp, comp) != comp:
            comp = of[comp]
        return comp

    def members(i: int) -> set:
        if i not in sets:
            sets[i] = set(np.frombuffer(cell["shingles"][i], dtype=np.uint64).tolist())
        return sets[i]
    for i in asked.tolist():
        apart = np.bitwise_count(sketch ^ cell["sketch"][i]).sum(axis=1)
        bound = most_odd(sizes, float(cell["size"][i]), percent / 100, np.exp, np.sqrt)
        at = np.flatnonzero((apart <= bound) & (comps != cell["comp"][i]))
        at = at[cell["bands"][i][(bands[at] == cell["bands"][i]).argmax(axis=1)] == here]
        for k in at[np.argsort(apart[at], kind="stable")].tolist():  # the most similar first
            j = int(rows[k])
            one, other = root(int(cell["comp"][i])), root(int(comps[k]))
            if one != other:
                x, y = members(i), members(j)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    of[max(one, other)] = min(one, other)
                    out.append((int(cell["node"][i]), int(cell["node"][j])))
    return out


def _join_components(percent: int):
    """Rows sorted by cell to the links found in each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in each_cell(batches, lists=("sketch", "bands")):
            cell["asked"], cell["sketch"] = cell["asked"].astype(bool), cell["sketch"].view(np.uint64)
            if found := _cell_links(cell, percent):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80, row: str | None = None) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key reachable by links of Jaccard
    similarity >= percent / 100) and kept (whether that is its own key).

    `row` names a column of unique numbers in a written table; without it, such a table is written.
    """
    spark = docs.sparkSession
    similarity = percent / 100
    kind = docs.schema[key].dataType.simpleString()
    if row is None:
        docs = cut(spark, docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.monotonically_increasing_id().alias("row")), "numbered")
    else:
        docs = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.col(row).alias("row"))
    signed = cut(spark, docs.select("id", "body", "row").mapInArrow(
        _sign(words), f"id {kind}, row bigint, n_shingles bigint, node bigint, `check` bigint, bands array<bigint>, sketch array<bigint>"), "signatures")
    full = signed.where("n_shingles > 0")
    # One row per class of equal sets; its rows agree in bands and sketch.
    classes = cut(spark, full.groupBy("node", "check").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("size")), "classes")
    sketches = classes.select("node", "sketch", F.col("size").cast("double").alias("size"))
    marked = classes.select("node", "sketch", "bands", F.col("size").cast("double").alias("size"))
    buckets = classes.select(F.explode("bands").alias("bucket"), "node")
    # Two leaders of a bucket: its least node, often the same for a node's buckets, and one drawn by bucket.
    drawn = F.struct(F.xxhash64("node", "bucket"), F.col("node").alias("node"))
    crowded = cut(spark, buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.min(drawn).alias("drawn"), F.count("node").alias("n")).where("n > 1"), "crowded")
    members = cut(spark, buckets.join(crowded, "bucket").select("bucket", "node", "leader", F.col("drawn.node").alias("drawn"), "n"), "members")

    def full_sets(wanted: DataFrame, most: int) -> DataFrame:
        """(node, shingles) of the nodes in `wanted`, at most `most` rows; only their texts are read by Python again."""
        wanted = wanted.distinct().join(classes.select("node", "row"), "node")
        texts = docs.select("row", "body").join(F.broadcast(wanted) if most <= BROADCAST_ROWS else wanted, "row").select("node", "body")
        return texts.mapInArrow(_full_sets(words), "node bigint, shingles binary").dropDuplicates(["node"])

    # Pairs of a node and a leader of one of its buckets, by sketch and then on full sets.
    led = members.select(F.explode(F.array("leader", "drawn")).alias("leader"), "node").where("node != leader")
    pairs = led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    near = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "x", "size": "m"}), "a").join(
        sketches.withColumnsRenamed({"node": "b", "sketch": "y", "size": "n"}), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    near = cut(spark, near.where(apart <= most_odd(F.col("m"), F.col("n"), similarity, F.exp, F.sqrt)).select("a", "b"), "near-pairs")
    ends = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node")))
    sets = cut(spark, full_sets(ends, 2 * near.count()), "full-sets")
    paired = near.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    links = cut(spark, paired.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")
    labels = components(links)

    # Buckets of more than two nodes that still hold several components.
    mixed = _mixed_buckets(spark, members.where("n > 2"), labels)
    rows = mixed.count()
    if rows:
        sets = full_sets(mixed.select("node"), rows)
        found = cut(spark, _between_components(mixed.join(marked, "node").join(sets, "node"), percent), "links")
        if not found.isEmpty():
            labels = components(links.union(found))
    named = classes.select("node", "check", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("node", "check", "component_id")
    out = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"), "check").join(named, ["node", "check"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _mixed_buckets(spark, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, comp, main, n, others) of buckets with several components: the largest one, and the rows in all and outside it."""
    rows = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("comp"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("node").alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("comp").alias("comps")).where("comps > 1")
    sizes = sizes.select("bucket", F.col("top.comp").alias("main"), "n", (F.col("n") - F.col("top.n")).alias("others"))
    return cut(spark, rows.join(sizes, "bucket"), "mixed-buckets")


def _between_components(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of nodes outside the largest component of a bucket, compared with all its rows in blocks."""
    blocks, asks = F.ceil(F.col("n") / CELL).cast("int"), F.ceil(F.col("others") / CELL).cast("int")
    own = F.xxhash64("node", F.lit(3))
    kept = ["bucket", "node", "comp", "size", "sketch", "bands", "shingles"]
    have = rows.select(*kept, F.lit(False).alias("asked"), F.pmod(own, blocks).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), asks - 1)).alias("q"))
    asked = rows.where("comp != main").select(*kept, F.lit(True).alias("asked"),
                                              F.explode(F.sequence(F.lit(0), blocks - 1)).alias("r"), F.pmod(own, asks).cast("int").alias("q"))
    cells = have.unionByName(asked).withColumn("cell", F.xxhash64("bucket", "r", "q"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_components(percent), "a bigint, b bigint")

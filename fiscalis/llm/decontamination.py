"""Benchmark decontamination by winnowing.

Every text is cut into words; of each run of `window - gram + 1` consecutive
word grams the one with the least hash is a fingerprint. Two texts that share
`window` consecutive words share the grams between them, hence also the
fingerprint chosen there: no shared window is missed. Fingerprints of documents
are joined with those of the benchmark; each hit carries the words around it and
is extended word by word, so results never rest on hashes.

Only document fingerprints that a Bloom filter of the benchmark's fingerprints
lets through are shuffled. Its size is fixed (`FILTER_BITS`), whatever the
benchmark's; a crowded filter lets more rows through and changes no result.
Items shorter than the window count as one window each and are looked up by the
hash of all their words.

Results for odd input: NULL and empty texts have no words and hit nothing (an
item without words has no window); repeated rows are judged each, also under one
id; items with the same text are all reported; with `nameless`, as the
registered query and the pipeline have it, passages of items without id are hits like any other, and
these items count as one but are not in the id lists; the lists have each id once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

from .common import distinct, row_slices, text_buffer
from .words import SYMBOL_SEPARATORS, WordScanner, gram_hashes, least_positions

WINDOW, GRAM = 10, 5
FILTER_BITS = 1 << 23  # one MB

FOUND = "array<struct<h:bigint,size:int,at:int,before:int,words:string>>"


def _fingerprints(tokens, window: int, gram: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word positions, hashes): winnowed grams under `window`, all runs of each short size."""
    hashed, _ = gram_hashes(tokens, gram)
    least = least_positions(hashed, window - gram + 1)
    last = np.repeat(tokens.first[1:], np.diff(tokens.first))
    chosen = distinct(least[np.arange(len(least)) + window <= last])
    yield window, chosen, hashed[chosen]
    for n in short:
        hashed, whole = gram_hashes(tokens, n)
        at = np.flatnonzero(whole)
        yield n, at, hashed[at] ^ np.uint64(n)


def _probe(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) % np.uint64(len(bits) * 64)
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _scan(window: int, gram: int, short: list[int], bits: np.ndarray | None):
    """Batches of (id, text) to (row, id, n_words, found); without `bits` every fingerprint is reported, and a text
    shorter than the window as one run. `row` is unique among the rows of one run of the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(SYMBOL_SEPARATORS, lower=True)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets):
                part = scanner.fold[data[offsets[lo]:offsets[hi]]]
                tokens = scanner.scan(part, offsets[lo:hi + 1] - offsets[lo])
                counts = np.diff(tokens.first)
                found = [[] for _ in range(hi - lo)]
                sizes = short if bits is not None else sorted({int(n) for n in counts if 0 < n < window})
                for size, at, hashes in _fingerprints(tokens, window, gram, sizes):
                    owner = np.searchsorted(tokens.first, at, side="right") - 1
                    keep = _probe(hashes, bits) if bits is not None else (counts[owner] >= window if size == window else counts[owner] == size)
                    around = window - gram if size == window else 0
                    ahead = window if size == window else size
                    for i, h, r in zip(at[keep].tolist(), hashes[keep].astype(np.int64).tolist(), owner[keep].tolist(), strict=True):
                        a = max(i - around, int(tokens.first[r]))
                        b = min(i + ahead, int(tokens.first[r + 1]))
                        words = b" ".join(part[s:e].tobytes() for s, e in zip(tokens.start[a:b], tokens.end[a:b], strict=True))
                        found[r].append({"h": h, "size": size, "at": i - int(tokens.first[r]), "before": i - a, "words": words.decode()})
                kind = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + lo, row + hi)), batch.column(0).slice(lo, hi - lo),
                                                  pa.array(counts.astype(np.int64)), pa.array(found, kind)], ["row", "id", "n_words", "found"])
            row += batch.num_rows
    return run


def _extend(window: int):
    """Pairs of surroundings to the document words that lie in a shared window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                a, b, i, j = x["words"].split(" "), x["item_words"].split(" "), x["before"], x["item_before"]
                left = 0
                while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                right = 0
                while right < min(len(a) - i, len(b) - j) and a[i + right] == b[j + right]:
                    right += 1
                if left + right >= x["size"]:
                    rows.append((x["row"], x["item_id"], x["at"] - left, x["at"] + right))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                                              pa.array(columns[3], pa.int32())], ["row", "item_id", "start", "stop"])
    return run


def contaminated_words(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text",
                       window: int = WINDOW, gram: int = GRAM, nameless: bool = False) -> DataFrame:
    """One row per document: key, n_words, hits (merged word ranges [start, stop) inside
    occurrences of benchmark windows), items (ids as text, of items with an occurring window, sorted)
    and unnamed (whether a window of an item without id occurs). Items without id count with `nameless` only."""
    spark = docs.sparkSession
    marks = cut(spark, items.select(F.col(item_key).cast("string").alias("id"), text).mapInArrow(
        _scan(window, gram, [], None), f"row bigint, id string, n_words bigint, found {FOUND}"), "benchmark-marks")
    # Items of one text share a mark; the ids meet again after the join.
    if not nameless:
        marks = marks.where(F.col("id").isNotNull())
    marks = marks.select("id", F.inline("found")).groupBy("h", "size", F.col("before").alias("item_before"), F.col("words").alias("item_words")).agg(
        F.collect_set("id").alias("item_ids"), F.bool_or(F.col("id").isNull()).alias("unnamed"))
    marks = marks.withColumn("item_ids", F.when(F.col("unnamed"), F.concat("item_ids", F.array(F.lit(None).cast("string")))).otherwise(F.col("item_ids"))).drop("unnamed")
    marks = cut(spark, marks, "benchmark-index")
    short = sorted(r["size"] for r in marks.where(F.col("size") < window).select("size").distinct().collect())
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    slots = marks.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")).select(
        F.expr(f"int(((p & {FILTER_BITS - 1})) >> 6)").alias("word"), F.expr("shiftleft(1L, int(p & 63))").alias("bit"))
    found = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    kind = docs.schema[key].dataType.simpleString()
    scanned = cut(spark, docs.select(F.col(key).alias("id"), text).mapInArrow(
        _scan(window, gram, short, bits), f"row bigint, id {kind}, n_words bigint, found {FOUND}"), "document-marks")
    pairs = scanned.where(F.size("found") > 0).select("row", F.inline("found")).join(marks, ["h", "size"]).select(
        "row", "size", "at", "before", "words", F.explode("item_ids").alias("item_id"), "item_before", "item_words")
    spans = pairs.mapInArrow(_extend(window), "row bigint, item_id string, start int, stop int")
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
                                       F.sort_array(F.collect_set("item_id")).alias("items"), F.bool_or(F.col("item_id").isNull()).alias("unnamed"))
    merged = F.expr("""aggregate(spans, cast(array() AS array<struct<start:int,stop:int>>), (acc, s) ->
        CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).stop
             THEN concat(slice(acc, 1, size(acc) - 1),
                         array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop))))
             ELSE concat(acc, array(s)) END)""")
    hits = per_row.select("row", merged.alias("hits"), "items", "unnamed")
    none = "cast(array() AS array<struct<start:int,stop:int>>)"
    return scanned.select("row", "id", "n_words").join(hits, "row", "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("hits", F.expr(none)).alias("hits"),
        F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"))


def contamination_digest(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return judged.select(key, "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

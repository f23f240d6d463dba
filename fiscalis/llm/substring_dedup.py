"""Repeated passages across documents, found with FM-indexes over shards of content.

A window is `window` consecutive words. Of the word grams in a window the one with the
least hash is its anchor; equal windows have equal anchors, and a run of
windows with the same anchor is a segment.

1. Anchors of all documents are counted. Those of one document only can't belong to a
   repeated window; the others are put in a Bloom filter of fixed size
   (`FILTER_BITS`), which is broadcast. A crowded filter lets more segments
   through and changes no result.
2. Segments whose anchor passes are brought together by anchor: a shard holds all
   windows that could equal any of its own. Equal segments are one, with
   the smallest document id. Anchors of very many documents (a passage that a third of
   the corpus shares) would fill a shard with variants of one line; a second filter
   names them, and their windows are dealt out singly, by their own hash.
3. Each shard builds a compressed FM-index of its segments and streams them through it:
   backward search over the wavelet matrix gives, for each position, the interval of
   suffixes that match; where the match has `window` words or more, the
   smallest document id in the group of suffixes that share the window is reported.
   Anchors and segments travel sorted and packed, one value per task and shard.
4. Windows seen in a smaller document mark their words; documents are
   joined with the marks once.

Words are compared as bytes inside the index. Nothing is sampled or capped; the shards follow the volume.

Results for odd input: NULL and empty texts have no words; rows of one id are not
smaller than each other, so repeated rows keep their words; NULL ids count as larger than all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.session import bounded_batches, cut

from .common import distinct, mix64, row_slices, text_buffer
from .fm_index import FMIndex
from .words import SPACE_SEPARATORS, WordScanner, gram_hashes, least_positions

WINDOW, GRAM = 13, 4
FILTER_BITS = 1 << 27  # 16 MB
HOT_DOCUMENTS = 20_000
SHARD_WORDS = 1_000_000
FLUSH = 1_000_000
LAST = (1 << 63) - 1


def _anchors(tokens, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window positions, positions of their anchors, hash of each word position)."""
    hashed, _ = gram_hashes(tokens, gram)
    last = np.repeat(tokens.first[1:], np.diff(tokens.first))
    at = np.flatnonzero(np.arange(len(hashed)) + window <= last)
    return at, least_positions(hashed, window - gram + 1)[at], hashed


def _slices(batches: Iterator[pa.RecordBatch], scanner: WordScanner):
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in row_slices(offsets):
            part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            yield batch.slice(lo, hi - lo), part, at, scanner.scan(part, at)


def _flat(*arrays: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([x.view(np.uint64) for x in arrays]).tobytes(), codec="zstd", asbytes=True)


def _unflat(data: pa.Scalar, n: int, columns: int) -> np.ndarray:
    raw = pa.decompress(data.as_buffer(), decompressed_size=8 * n * columns, codec="zstd")
    return np.frombuffer(raw, dtype=np.uint64).reshape(columns, n)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(part, [(n, data), ...]) of rows (part, n, data) sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((n, data))
    if held:
        yield part, held


def _pack_anchors(window: int, gram: int, parts: int):
    """(id, text) to (part, n, data): the anchors of each document with its id, packed by part of the hashes."""
    def packed(held: list) -> pa.RecordBatch:
        h, own = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((h, part))
        h, own = h[order], own[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        some = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([cuts[p + 1] - cuts[p] for p in some], pa.int64()),
                                           pa.array([_flat(h[cuts[p]:cuts[p + 1]], own[cuts[p]:cuts[p + 1]]) for p in some], pa.binary())], ["part", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, _, _, tokens in _slices(batches, WordScanner(SPACE_SEPARATORS, lower=False)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, anchor, hashed = _anchors(tokens, window, gram)
            anchor = distinct(anchor)
            owner = np.searchsorted(tokens.first, anchor, side="right") - 1
            order = np.lexsort((owner, hashed[anchor]))
            h, row = hashed[anchor][order], owner[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)]
            held.append((h[fresh], ids[row[fresh]].astype(np.int64)))
            size += int(fresh.sum())
            if size > FLUSH:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)
    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed anchors to (h, n): those of several ids, with the number of rows that have them."""
    for _, held in _by_part(batches):
        h, own = np.concatenate([_unflat(data, n, 2) for n, data in held], axis=1)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        end = np.r_[begin[1:], len(h)]
        many = own[begin] < own[end - 1]
        yield pa.RecordBatch.from_arrays([pa.array(h[begin][many].view(np.int64)), pa.array((end - begin)[many])], ["h", "n"])


def _probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for shift in (0, 31):
        at = (hashes >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def bloom_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of a column `h`; the driver gets at most bits / 64 rows."""
    slots = hashes.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 31))).alias("p")).select(
        F.expr(f"int((p & {bits - 1}L) >> 6)").alias("word"), F.expr("shiftleft(1L, int(p & 63))").alias("bit"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    found = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _found_segments(tokens, window: int, gram: int, shared: np.ndarray, hot: np.ndarray):
    """First and last window, anchor hash, digest and row of the segments whose anchor is shared.

    A segment has at most `window - gram + 1` windows, so its first and last window hold all its
    words and their hashes tell it from others.
    """
    at, anchor, hashed = _anchors(tokens, window, gram)
    keep = _probe(shared, hashed[anchor]) if len(at) else np.zeros(0, dtype=bool)
    at, anchor = at[keep], anchor[keep]
    single = _probe(hot, hashed[anchor]) if len(at) else keep[:0]
    # A segment ends where the anchor or the run of windows does; hot windows stand alone.
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | single[1:]][:len(at)])
    first, last = at[begin], at[np.r_[begin[1:], len(at)][:len(begin)] - 1]
    alone, _ = gram_hashes(tokens, window)
    h = np.where(single[begin], alone[first], hashed[anchor[begin]])
    digest = mix64(alone[first] + mix64(alone[last] + (last - first).astype(np.uint64)))
    return first, last, h, digest, np.searchsorted(tokens.first, first, side="right") - 1


def _pack_segments(window: int, gram: int, shared: np.ndarray, hot: np.ndarray, shards: int):
    """(id, text) to (part, n, data): distinct segments with least and largest id, packed by shard."""
    def packed(held: list) -> pa.RecordBatch:
        h, digest, low, high = (np.concatenate([x[k] for x in held]) for k in range(4))
        words = pa.concat_arrays([x[4] for x in held])
        order, begin, end = _same(digest, h, low)
        least, most = low[order][begin], np.maximum.reduceat(high[order], begin)
        h, digest, words = h[order][begin], digest[order][begin], words.take(pa.array(order[begin]))
        part = (mix64(h) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        table = pa.RecordBatch.from_arrays([pa.array(x[by].view(np.int64)) for x in (h, digest, least, most)] + [words.take(pa.array(by))],
                                           ["h", "digest", "low", "high", "words"])
        cuts = np.searchsorted(part[by], np.arange(shards + 1)).tolist()
        some = [p for p in range(shards) if cuts[p + 1] > cuts[p]]
        out = []
        for p in some:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(table.slice(cuts[p], cuts[p + 1] - cuts[p]))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([cuts[p + 1] - cuts[p] for p in some], pa.int64()), pa.array(out, pa.binary())],
                                          ["part", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, part, offsets, tokens in _slices(batches, WordScanner(SPACE_SEPARATORS, lower=False)):
            first, last, h, digest, owner = _found_segments(tokens, window, gram, shared, hot)
            if not len(first):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            order, begin, _ = _same(digest, h, ids)
            least, most = ids[order][begin], np.maximum.reduceat(ids[order], begin)
            pick = order[begin]
            by = np.argsort(first[pick], kind="stable")  # in order of text, so that each text is split once
            words, row, out = [], -1, []
            for a, b, r in zip(first[pick][by].tolist(), last[pick][by].tolist(), owner[pick][by].tolist(), strict=True):
                if r != row:
                    row, words, base = r, part[offsets[r]:offsets[r + 1]].tobytes().split(), int(tokens.first[r])
                out.append(b" ".join(words[a - base:b - base + window]))
            held.append((h[pick][by], digest[pick][by], least[by], most[by], pa.array(out, pa.binary())))
            size += len(out)
            if size > FLUSH // 4:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)
    return run


def _same(digest: np.ndarray, h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by segment and `least`, and where each segment begins and ends in it."""
    order = np.lexsort((least, h, digest))
    d, k = digest[order], h[order]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])][:len(d)])
    return order, begin, np.r_[begin[1:], len(d)][:len(begin)]


def _places(window: int, gram: int, shared: np.ndarray, hot: np.ndarray):
    """(id, text, mark) to (id, mark, at, h, digest): where segments stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, tokens in _slices(batches, WordScanner(SPACE_SEPARATORS, lower=False)):
            first, _, h, digest, owner = _found_segments(tokens, window, gram, shared, hot)
            if len(first):
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array((first - tokens.first[owner]).astype(np.int32)),
                                                  pa.array(h.view(np.int64)), pa.array(digest.view(np.int64))], ["id", "mark", "at", "h", "digest"])
    return run


def _search(window: int):
    """A shard's packed segments to (h, digest, begin, stop, first): runs of a segment's windows
    that a document smaller than its largest one has, with the smallest id."""
    def shard(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([b for _, data in held for b in pa.ipc.open_stream(data.as_buffer())])
        h, digest, low, high = (table.column(k).to_numpy() for k in range(4))
        order, begin, _ = _same(digest, h, low)
        high = np.maximum.reduceat(high[order], begin)
        h, digest, low = h[order][begin], digest[order][begin], low[order][begin]
        ids, ends, vocabulary = [], [], {}
        for words in table.column(4).take(pa.array(order[begin])):
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words.as_py().split(b" ")]
            ids.append(0)
            ends.append(len(ids) - 1)
        ids, ends = np.array(ids, dtype=np.int64), np.array(ends)
        starts = np.r_[0, ends[:-1] + 1]
        index = FMIndex(ids, len(vocabulary) + 1)
        group = index.groups(window)
        owner = np.searchsorted(ends, index.suffixes)
        least = np.minimum.reduceat(low[owner], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        firsts = np.full(len(ids), LAST)
        for which, at, lo, hi in index.intervals(starts, ends, ids, window):
            matched = hi > lo
            firsts[(starts[which] + at)[matched]] = least[group[lo[matched]]]
        counts = ends - starts - window + 1
        own = np.repeat(np.arange(len(ends)), counts)
        place = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        first = firsts[starts[own] + place]
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (first[1:] != first[:-1])])
        stop = place[np.r_[new[1:], len(own)] - 1] + 1
        keep = first[new] < high[own[new]]
        new, stop = new[keep], stop[keep]
        return pa.RecordBatch.from_arrays([pa.array(h[own[new]]), pa.array(digest[own[new]]), pa.array(place[new].astype(np.int32)), pa.array(stop.astype(np.int32)),
                                           pa.array(first[new])], ["h", "digest", "begin", "stop", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_part(batches):
            yield shard(held)
    return run


def _remove(window: int):
    """(id, text, windows) to (id, n_words, n_removed, kept): `windows` are runs of windows whose words go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for text, windows in zip(batch.column(1).slice(lo, 256), batch.column(2).slice(lo, 256), strict=True):
                    words = text.as_py().encode().split() if text.is_valid else []
                    n = len(words)
                    if windows.is_valid:
                        begin, stop = (windows.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, stop + window - 1, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                    rows.append((n, n - len(words), b" ".join(words).decode()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                                  pa.array(columns[2], pa.string())], ["id", "n_words", "n_removed", "kept"])
    return run


def _text_mark(text: Column) -> Column:
    """Tells apart texts that come under one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: key, n_words, n_removed and kept, the text without words of windows that also
    start in a document of a smaller key, joined by single spaces."""
    if not 8 <= window <= 16 or not 0 < gram < window:
        raise ValueError("windows of 8 to 16 words, longer than the grams")
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("text"))
    packed, least = "part int, n bigint, data binary", int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(64, 2 * least)
    anchors = plain.select("id", "text").mapInArrow(_pack_anchors(window, gram, parts), packed).repartition(parts, "part").sortWithinPartitions("part")
    anchors = cut(spark, anchors.mapInArrow(_shared_anchors, "h bigint, n bigint"), "shared-anchors")
    shared = bloom_bits(anchors, FILTER_BITS)
    hot = bloom_bits(anchors.where(F.col("n") > HOT_DOCUMENTS), FILTER_BITS // 16)
    # An anchor's row stands for a segment of about `window + 5` words.
    shards = max(least, (anchors.agg(F.sum("n")).first()[0] or 0) * (window + 5) // SHARD_WORDS + 1)
    segments = plain.select("id", "text").mapInArrow(_pack_segments(window, gram, shared, hot, shards), packed)
    runs = segments.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(
        _search(window), "h bigint, digest bigint, begin int, stop int, first bigint")
    places = plain.select("id", "text", _text_mark(F.col("text")).alias("mark")).mapInArrow(
        _places(window, gram, shared, hot), "id bigint, mark bigint, at int, h bigint, digest bigint")
    seen = places.join(runs, ["h", "digest"]).where(F.col("first") < F.col("id"))
    marks = seen.groupBy("id", "mark").agg(F.collect_list(F.struct((F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("stop")).alias("stop"))).alias("windows"))
    joined = plain.withColumn("mark", _text_mark(F.col("text"))).join(marks, ["id", "mark"], "left")
    return joined.select(F.col("key").alias("id"), "text", "windows").mapInArrow(
        _remove(window), f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", key)

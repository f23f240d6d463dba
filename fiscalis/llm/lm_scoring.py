"""Language-model scores from a log-frequency Bloom filter.

Counts of all n-grams up to `ORDER` words over all training texts are quantised on a
log scale: level q stands for a count of about `BASE ** (q - 1)`. An n-gram of
level q is put in a Bloom filter q times, as (n-gram, 1) to (n-gram, q). A count
is read by probing (n-gram, 1), (n-gram, 2), ... until a probe fails; a false
positive can only raise it, by little. Probabilities come from these counts by
Dirichlet smoothing from the longest context to the single word:

    p(w | c) = (count(c w) + K * p(w | shorter c)) / (count(c) + K)
    p(w) = (count(w) + 1) / (N + V + 1)

The filter grows with the corpus: no n-gram is left out. It consists of blocks by
n-gram hash, as many as the number of training words asks for, each built by one task from
the exact counts of its n-grams with `BITS_AN_ENTRY` bits an entry (a small corpus shares `LEAST_BITS`). An n-gram's hash has as many bits as tell the counted n-grams apart
(`SPARE_BITS` more than their number needs); sorted hashes travel as packed differences, one array per task and block.
A filter of bounded size (`HEAD_BITS`) holds the n-grams of the highest levels, from a level of `HEAD_LEVEL` on at least, and is
broadcast; it answers most probes. An n-gram that it does not show at such a level is looked up in the blocks: every lot of texts
(`LOT_BYTES`) asks each block for its distinct n-grams of that kind, the questions meet their
block by its number, and the answers go back to the lot. This is the same at every size; a larger corpus raises
the level from which the broadcast filter answers.

The base score needs exact word counts: words of at least a count that
`HEAD_WORDS` words reach travel with the job, the others of each text are joined by
word. The joined words are rare by construction, so the join has no hot key.

Results for odd input: NULL texts count as empty, so they have one token (the end); rows are
scored one by one, repeated or not; without training rows every count is 0, N and V are 0
and the scores are those of the smoothed formulas.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

from .common import distinct, mix64, row_slices, text_buffer
from .words import SPACE_SEPARATORS, WordScanner

ORDER = 2
BASE = 1.5
LEVELS = 64
PARTS = 256
HEAD_BITS = 1 << 27  # the largest broadcast filter, 16 MB
LEAST_BITS = 1 << 28  # of all blocks together, 32 MB; a fourth of it for the broadcast filter
HEAD_LEVEL = 2
PART_GRAMS = 1 << 22  # n-grams of the training texts, repeats included, for each block beyond the first PARTS
PROBES = 3
BITS_AN_ENTRY = 10
SMOOTHING = 5.0
HEAD_WORDS = 200_000
FLUSH = 400_000
SPARE_BITS = 24
LOT_BYTES = 8 << 20  # of texts whose n-grams are asked for together
START, END = np.uint64(0x51A7), np.uint64(0xE0D)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts with a level; 0 for none."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.ceil(BASE ** levels.astype(np.float64) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(high, low)) / 2, 0.0)


def _sequences(data: np.ndarray, offsets: np.ndarray, scanner: WordScanner) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each between START and END, and where each text begins."""
    tokens = scanner.scan(data, offsets)
    rows = np.arange(len(offsets) - 1)
    first = tokens.first + 2 * np.arange(len(offsets))
    out = np.empty(len(tokens.hash) + 2 * len(rows), dtype=np.uint64)
    out[np.arange(len(tokens.hash)) + 2 * tokens.rows() + 1] = tokens.hash
    out[first[:-1]] = START
    out[first[1:] - 1] = END
    return out, first


def _grams(sequence: np.ndarray, first: np.ndarray, n: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each place, their lowest `spare` bits cleared, and which of them lie in one text."""
    out = np.zeros(len(sequence), dtype=np.uint64)
    for j in range(n):
        out[n - 1:] = mix64(out[n - 1:] ^ sequence[j:len(sequence) - n + 1 + j])
    depth = np.arange(len(sequence)) - np.repeat(first[:-1], np.diff(first))
    return (out ^ np.uint64(n)) >> np.uint64(spare) << np.uint64(spare), depth >= n - 1


def _merge(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][:len(hashes)])
    return hashes[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts


def _pack(hashes: np.ndarray, part: int, parts: int, spare: int) -> bytes:
    """Sorted hashes of one part as compressed differences, byte by byte, without the bytes that are zero in all."""
    steps = (hashes - np.uint64(part * ((1 << 64) // parts))) >> np.uint64(spare)
    steps[1:] -= steps[:-1].copy()
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(hashes), width], dtype="<u4").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: pa.Buffer, part: int, parts: int, spare: int) -> np.ndarray:
    n, width = np.frombuffer(data, dtype="<u4", count=2).tolist()
    raw = pa.decompress(data.slice(8), decompressed_size=n * width, codec="zstd")
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T
    return (np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) << np.uint64(spare)) + np.uint64(part * ((1 << 64) // parts))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes // np.uint64((1 << 64) // parts)).astype(np.int64)


def _cuts(hashes: np.ndarray, parts: int) -> list[int]:
    """Where each part begins in sorted hashes, and their end."""
    return np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)).tolist() + [len(hashes)]


def _count_grams(order: int, count: int, spare: int):
    """Texts to (part, hashes, counts): sorted n-gram hashes with their counts in this task, by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, held, size = WordScanner(SPACE_SEPARATORS, lower=True), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, counts = _merge(held)
            cuts = _cuts(hashes, count)
            parts = [p for p in range(count) if cuts[p + 1] > cuts[p]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([_pack(hashes[cuts[p]:cuts[p + 1]], p, count, spare) for p in parts], pa.binary()),
                 pa.array([pa.compress(counts[cuts[p]:cuts[p + 1]].astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for p in parts], pa.binary())],
                ["part", "hashes", "counts"])
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in row_slices(offsets):
                sequence, first = _sequences(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], scanner)
                for n in range(1, order + 1):
                    hashes, whole = _grams(sequence, first, n, spare)
                    held.append(np.unique(hashes[whole], return_counts=True))
                    size += len(held[-1][0])
                if size > 5 * FLUSH:
                    held = [_merge(held)]
                    size = len(held[0][0])
                if size > 10 * FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
    return run


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix64(hashes + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))


def _slot(mixed: np.ndarray, probe: int, bits: int | np.ndarray) -> np.ndarray:
    """Bit positions, within its block of so many bits, of each n-gram at a level."""
    return ((mixed >> np.uint64(21 * probe)) % np.asarray(bits, dtype=np.uint64)).astype(np.int64)


def _read_levels(hashes: np.ndarray, bitmap: np.ndarray, start: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels read from blocks that begin at byte `start` and have `bits`, by probing until a probe fails."""
    out = np.zeros(len(hashes), dtype=np.int64)
    live = np.arange(len(hashes))
    for level in range(1, LEVELS + 1):
        if not len(live):
            break
        mixed = _mixed(hashes[live], level)
        for probe in range(PROBES):  # most of those that aren't there fail at the first one
            at = _slot(mixed, probe, bits[live])
            found = (bitmap[start[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, mixed = live[found], mixed[found]
        out[live] = level
    return out


def _bitmap(hashes: np.ndarray, levels: np.ndarray, least: int) -> bytes:
    bits = max(-(-BITS_AN_ENTRY * int(levels.sum()) // 64) * 64, least, 64)
    odd = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        mixed = _mixed(hashes[levels >= level], level)
        for probe in range(PROBES):
            odd[_slot(mixed, probe, bits)] = True
    return np.packbits(odd, bitorder="little").tobytes()


BLOCK = "part int, bitmap binary, head binary, head_levels binary, n bigint, levels array<bigint>"


def _build(count: int, spare: int, least: int):
    """A part's packed counts to its block: the bitmap, its n-grams of HEAD_LEVEL or more with their levels, and how
    many n-grams have each level; the rows of one part come one after the other."""
    def block(part: int, pairs: list) -> pa.RecordBatch:
        hashes, counts = _merge(pairs)
        levels = level_of(counts)
        head = levels >= HEAD_LEVEL
        packed = pa.compress(levels[head].astype(np.uint8).tobytes(), codec="zstd", asbytes=True)
        columns = [[part], [_bitmap(hashes, levels, least)], [_pack(hashes[head], part, count, spare)], [packed], [int(head.sum())], [np.bincount(levels, minlength=LEVELS + 1).tolist()]]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "bitmap", "head", "head_levels", "n", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairs = None, []
        for batch in batches:
            for p, hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if p != part and pairs:
                    yield block(part, pairs)
                    pairs = []
                part = p
                known = _unpack(hashes.as_buffer(), p, count, spare)
                raw = pa.decompress(counts.as_buffer(), decompressed_size=4 * len(known), codec="zstd")
                pairs.append((known, np.frombuffer(raw, dtype=np.uint32).astype(np.int64)))
                if len(pairs) > 64:
                    pairs = [_merge(pairs)]
        if pairs:
            yield block(part, pairs)
    return run


def _heads(least: int, count: int, spare: int, bits: int):
    """Blocks to the part of the broadcast filter that holds their n-grams of a level or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, out = batch.column(0).to_pylist(), []
            for part, head, packed, n in zip(parts, batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                hashes = _unpack(head.as_buffer(), part, count, spare)
                levels = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=n, codec="zstd"), dtype=np.uint8).astype(np.int64)
                out.append(_bitmap(hashes[levels >= least], levels[levels >= least], bits))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], ["part", "bitmap"])
    return run


@dataclass
class Model:
    bitmap: np.ndarray  # the broadcast filter, part by part
    start: np.ndarray   # first byte of each part
    bits: np.ndarray    # bits of each part
    least: int          # the level from which it answers
    order: int
    tokens: int         # N
    distinct: int       # V
    spare: int          # cleared low bits of an n-gram's hash
    head: dict[bytes, int]
    blocks: DataFrame | None = None  # (part, bitmap, ...) of the whole filter

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """What the broadcast filter shows; levels below `least` are for the blocks to say."""
        part = _part_of(hashes, len(self.bits))
        return _read_levels(hashes, self.bitmap, self.start[part], self.bits[part])

    def log_probabilities(self, sequence: np.ndarray, first: np.ndarray, levels) -> np.ndarray:
        """log10 probability of each text, its words and its end, from a function that gives the levels of n-grams."""
        total = self.tokens + self.distinct + 1
        probability, context = None, None
        for n in range(1, self.order + 1):
            hashes, whole = _grams(sequence, first, n, self.spare)
            asked, back = np.unique(hashes, return_inverse=True)
            counts = count_of(levels(asked))[back]
            if n == 1:
                probability = (counts + 1) / total
            else:
                before = np.r_[0.0, context[:-1]]  # the count of the n - 1 words before
                longer = (np.minimum(counts, before) + SMOOTHING * probability) / (before + SMOOTHING)
                probability = np.where(whole, longer, probability)
            context = counts
        scores = np.log10(probability)
        scores[first[:-1]] = 0.0  # START is given
        return np.add.reduceat(scores, first[:-1]) if len(first) > 1 else np.zeros(0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "c"])
    for batch in batches:
        for text in batch.column(0):
            counts[b""] += 1  # the end of a text; no word is empty
            if text.is_valid:
                counts.update(text.as_py().encode().lower().split())
            if len(counts) > FLUSH:
                yield from rows()
                counts.clear()
    yield from rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a table with one text column; the empty word is the end of a text."""
    return cut(texts.sparkSession, texts.mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def fit_model(texts: DataFrame, counts: DataFrame, order: int = ORDER) -> Model:
    """The model of a table with one text column, whose `word_counts` are given."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("c").alias("v")).first()
    # The least count that no more than HEAD_WORDS words reach, from a histogram on a log scale.
    bins = sorted(counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("c").alias("n")).collect(), key=lambda r: -r["bin"])
    head, least = 0, None
    for r in bins:
        if head + r["n"] > HEAD_WORDS:
            break
        head, least = head + r["n"], r["bin"]
    found = counts.where(F.floor(F.log2("c") * 8) >= least).toArrow().to_pydict() if least is not None else {"word": [], "c": []}
    spark, tokens = texts.sparkSession, totals["n"] or 0
    parts = max(PARTS, 1 << (tokens * order // PART_GRAMS).bit_length())
    spare = max(0, 64 - (tokens * order + 1).bit_length() - SPARE_BITS)
    packed = texts.mapInArrow(_count_grams(order, parts, spare), "part int, hashes binary, counts binary")
    blocks = cut(spark, packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_build(parts, spare, LEAST_BITS // parts), BLOCK), "filter-blocks")
    sizes = {r["level"]: r["n"] for r in blocks.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    bits, lowest = 0, LEVELS + 1
    while lowest > HEAD_LEVEL and bits + BITS_AN_ENTRY * (lowest - 1) * sizes.get(lowest - 1, 0) <= HEAD_BITS:
        lowest -= 1
        bits += BITS_AN_ENTRY * lowest * sizes.get(lowest, 0)
    built = blocks.select("part", "head", "head_levels", "n").mapInArrow(_heads(lowest, parts, spare, LEAST_BITS // 4 // parts), "part int, bitmap binary").toArrow()
    held = dict(zip(built.column("part").to_pylist(), built.column("bitmap"), strict=True))
    size = np.array([8 * len(held[p].as_buffer()) if p in held else 64 for p in range(parts)], dtype=np.int64)
    start = np.cumsum(size // 8) - size // 8
    bitmap = np.zeros(int(size.sum()) // 8, dtype=np.uint8)
    for part, row in held.items():
        bitmap[start[part]:start[part] + size[part] // 8] = np.frombuffer(row.as_buffer(), dtype=np.uint8)
    return Model(bitmap, start, size, lowest, order, tokens, totals["v"], spare, dict(zip(found["word"], found["c"], strict=True)), blocks)


def _scored_slice(scanner: WordScanner, logs: dict[bytes, float], kept: list, names: list[str], rows: np.ndarray,
                  data: np.ndarray, at: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """The columns `kept` with row, n_tokens, known, base, score and rare of the texts in `data`."""
    folded = scanner.fold[data]
    n, known, base, words_of, times_of, ends = [], [], [], [], [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        words = folded[a:b].tobytes().split()
        words.append(b"")
        found = list(map(logs.get, words))
        values = [x for x in found if x is not None]
        n.append(len(words))
        known.append(len(values))
        base.append(math.fsum(values))
        if len(values) < len(words):
            rest = Counter([w for w, x in zip(words, found, strict=True) if x is None])
            words_of.extend(rest)
            times_of.extend(rest.values())
        ends.append(len(words_of))
    rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(words_of, pa.binary()), pa.array(times_of, pa.int64())], ["word", "times"]))
    return pa.RecordBatch.from_arrays([*kept, pa.array(rows), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                                       pa.array(base, pa.float64()), pa.array(score), rare], [*names, "row", "n_tokens", "known", "base", "score", "rare"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number and with that of the first row of their slice."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        _, offsets = text_buffer(batch.column("_text"))
        for lo, hi in row_slices(offsets, LOT_BYTES):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(row + lo, row + hi)), pa.array(np.full(hi - lo, row + lo))],
                                             [*batch.schema.names, "row", "slice"])
        row += batch.num_rows


def _distinct(sequence: np.ndarray, first: np.ndarray, order: int, spare: int = 0) -> np.ndarray:
    return distinct(np.concatenate([hashes[whole] for hashes, whole in (_grams(sequence, first, n, spare) for n in range(1, order + 1))]))


def _lot(data: np.ndarray, offsets: np.ndarray, scanner: WordScanner, order: int, spare: int) -> tuple[np.ndarray, list[tuple]]:
    """The distinct n-grams of many texts, and (first row, end row, sequences) of their slices."""
    slices = [(lo, hi, _sequences(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], scanner)) for lo, hi in row_slices(offsets)]
    return distinct(np.concatenate([_distinct(*sequences, order, spare) for _, _, sequences in slices])), slices


def _ask(model: Model):
    """Dealt rows to (slice, lot, part, hashes): the distinct n-grams of each lot that the broadcast filter doesn't answer, by
    block. A lot is the rows of a slice that one batch holds, named by its first row; it has one row at least."""
    count, spare = len(model.bits), model.spare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(SPACE_SEPARATORS, lower=True)
        for batch in batches:
            slices, rows = batch.column("slice").to_numpy(), batch.column("row").to_numpy()
            data, offsets = text_buffer(batch.column("_text"))
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                hashes, _ = _lot(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], scanner, model.order, spare)
                hashes = hashes[model.levels(hashes) < model.least]
                cuts = _cuts(hashes, count)
                parts = [p for p in range(count) if cuts[p + 1] > cuts[p]] or [0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts), slices[lo])), pa.array(np.full(len(parts), rows[lo])), pa.array(parts, pa.int32()),
                     pa.array([_pack(hashes[cuts[p]:cuts[p + 1]], p, count, spare) for p in parts], pa.binary())], ["slice", "lot", "part", "hashes"])
    return run


def _answer(count: int, spare: int):
    """(part, slice, lot, data) to (slice, lot, part, levels); a part's bitmap, without slice, comes before its questions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bitmap = None, np.zeros(0, dtype=np.uint8)
        for batch in batches:
            out = []
            for part, piece, lot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if piece is None:
                    held, bitmap = part, np.frombuffer(data.as_buffer(), dtype=np.uint8)
                    continue
                hashes = _unpack(data.as_buffer(), part, count, spare)
                levels = np.zeros(len(hashes), dtype=np.int64)  # a part without a block has no n-gram
                if held == part:
                    levels = _read_levels(hashes, bitmap, levels, np.full(len(hashes), 8 * len(bitmap)))
                out.append((piece, lot, part, pa.compress(levels.astype(np.uint8).tobytes(), codec="zstd", asbytes=True), len(hashes)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "lot", "part", "levels", "n"])
    return run


def _score_dealt(model: Model):
    """The rows of a slice and the answers to its questions to scored rows."""
    logs, model = {w: math.log10(c + 1) for w, c in model.head.items()}, replace(model, head={})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scanner = WordScanner(SPACE_SEPARATORS, lower=True)
        left = left.take(pa.array(np.argsort(left.column("row").to_numpy())))
        rows, answers = left.column("row").to_numpy(), {}
        for lot, part, levels, n in zip(*(right.column(c).to_pylist() for c in ("lot", "part", "levels", "n")), strict=True):
            answers.setdefault(lot, []).append((part, pa.decompress(levels, decompressed_size=n, codec="zstd", asbytes=True)))
        lots, out = sorted(answers), []
        edges = [*np.searchsorted(rows, lots).tolist(), len(rows)]
        for lot, lo, hi in zip(lots, edges[:-1], edges[1:], strict=True):
            data, at = text_buffer(left.column("_text").slice(lo, hi - lo))
            hashes, slices = _lot(data, at, scanner, model.order, model.spare)
            found = model.levels(hashes)
            found[found < model.least] = np.frombuffer(b"".join(levels for _, levels in sorted(answers[lot])), dtype=np.uint8)

            def read(asked: np.ndarray, hashes=hashes, found=found) -> np.ndarray:
                # n-grams across two texts are not among them; nothing reads their counts.
                return found[np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)]
            for begin, end, sequences in slices:
                kept = [left.column("_keep").slice(lo + begin, end - begin).combine_chunks()]
                out.append(_scored_slice(scanner, logs, kept, ["_keep"], rows[lo + begin:lo + end], data[at[begin]:at[end]], at[begin:end + 1] - at[begin],
                                         model.log_probabilities(*sequences, read)))
        return pa.Table.from_batches(out)
    return run


def _score_by_blocks(asked: DataFrame, model: Model, schema: str) -> DataFrame:
    kind, parts, light = asked.schema["_keep"].dataType.simpleString(), len(model.bits), replace(model, blocks=None)
    dealt = cut(asked.sparkSession, asked.mapInArrow(_deal, f"_keep {kind}, _text string, row bigint, slice bigint"), "dealt")
    asks = dealt.select("_text", "row", "slice").mapInArrow(_ask(replace(light, head={})), "slice bigint, lot bigint, part int, hashes binary")
    none = F.lit(None).cast("long")
    questions = model.blocks.select("part", none.alias("slice"), none.alias("lot"), F.col("bitmap").alias("data")).union(
        asks.select("part", "slice", "lot", "hashes"))
    answers = questions.repartition(parts, "part").sortWithinPartitions("part", F.col("slice").asc_nulls_first()).mapInArrow(
        _answer(parts, model.spare), "slice bigint, lot bigint, part int, levels binary, n bigint")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score_dealt(light), schema)


def score_texts(rows: DataFrame, model: Model, counts: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns with n_tokens, n_known, train_tokens, base_score and score."""
    asked = rows.select(F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    kind = asked.schema["_keep"].dataType.simpleString()
    schema = f"_keep {kind}, row bigint, n_tokens bigint, known bigint, base double, score double, rare array<struct<word:binary,times:bigint>>"
    scored = cut(rows.sparkSession, _score_by_blocks(asked, model, schema), "scored")
    rare = scored.select("row", F.inline("rare")).join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_base"))
    out = scored.select("_keep", "row", "n_tokens", "known", "base", "score").join(rare, "row", "left")
    cost = math.log10(model.tokens + model.distinct + 1)
    return out.select("_keep.*", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * cost).alias("base_score"), "score")

"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding picks the cut of a text into vocabulary pieces with the largest sum of piece
scores. The best score up to a position depends on the `M` positions before it only
(`M` is the longest piece), so a chunk of text is a transfer matrix in max-plus
algebra: entry (s, t) is the best score from "the first s characters belong to a piece
of the chunk before" to "a piece reaches t characters into the next chunk".

1. Giant texts, of two or more chunks of `GIANT` characters, become rows (text, chunk). Tasks compute
   the transfer matrix of each chunk; matrices are combined by bands of `BAND` chunks, bands of bands and so on, which gives
   the scores at every chunk's left boundary.
2. With these scores, each chunk fills in its own back pointers, and for every possible overhang at its right boundary the entry
   it comes from. These small maps are composed from the right in the same bands, which fixes each chunk's exit.
3. Every chunk is traced back on its own, in any task.
4. Inside a chunk the same is done once more with parts of `CHUNK` characters, side by side in numpy arrays, by an associative scan
   in log2(parts) rounds.

A text below two such chunks is one chunk. Where no piece of the vocabulary has a space after another character it
falls into segments before each run of spaces, which no piece crosses; short segments are solved
by a plain search, once each, and remembered up to a bound; long ones as in 4.

Among cuts of equal score the one whose last piece is longest wins, then the piece
before it, and so on; chunks keep to this rule, so the result does not depend on them.

A space is written as U+2581 and one is put in front of a text. Characters without a
piece, also a U+2581 of the text itself, become one piece per UTF-8 byte, at the cost
of an unknown piece (`UNKNOWN` below the least score). Decoding therefore gives the
text back exactly.

Results for odd input: NULL and empty texts have no pieces, and decode to an empty
text; rows are encoded one by one, repeated or not. Ids outside the vocabulary fail.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
LITERAL = 0x110000  # stands for U+2581 in the text itself; no vocabulary has it
UNKNOWN = 10.0
CHUNK = 512
GIANT = 1 << 15  # characters of a chunk that is a row of its own
BAND = 64        # chunks whose matrices or maps one task combines
REMEMBER = 300_000
BATCH_CHARS = 1 << 16
NONE = -np.inf


@dataclass
class Vocabulary:
    """Pieces of a model as a trie in hash tables of numpy arrays."""
    text: list[bytes]            # decoded bytes of each id
    byte_ids: list[int]          # id of each byte
    unknown: float
    longest: int
    splits: bool                 # no piece crosses from another character to a space
    chars: np.ndarray            # sorted code points of the vocabulary
    keys: np.ndarray             # open-addressed (node, char) keys, -1 where free
    nexts: np.ndarray
    score: np.ndarray            # by node; NONE where no piece ends
    ident: np.ndarray
    ids_of: dict = field(default_factory=dict)    # segments solved so far, with their ids, score and decoded bytes

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie nodes reached, -1 for none."""
        key = node * len(self.chars) + char
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 19)).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int64)
        live = np.arange(len(key))
        while len(live):
            found = self.keys[slot[live]]
            hit = found == key[live]
            out[live[hit]] = self.nexts[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
            slot[live] = (slot[live] + 1) & (len(self.keys) - 1)
        return out


def load_vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """Read on the driver; the arrays travel with the job (their size is that of the vocabulary)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, text, byte_ids = {}, [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            text.append(piece.replace(chr(SPACE), " ").encode())
    return build_vocabulary(pieces, text, byte_ids)


def build_vocabulary(pieces: dict[str, tuple[int, float]], text: list[bytes], byte_ids: list[int]) -> Vocabulary:
    chars = np.array(sorted({ord(c) for p in pieces for c in p}), dtype=np.int64)
    place = {int(c): i for i, c in enumerate(chars)}
    edges, score, ident = {}, [NONE], [-1]
    for piece, (i, s) in pieces.items():
        node = 0
        for c in piece:
            node = edges.setdefault((node, place[ord(c)]), len(score))
            if node == len(score):
                score.append(NONE)
                ident.append(-1)
        score[node], ident[node] = float(s), i
    size = 1 << 19
    if len(edges) > size // 2:
        raise ValueError("vocabulary too large")
    keys, nexts = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
    for (node, c), after in edges.items():
        key = node * len(chars) + c
        slot = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 19)
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], nexts[slot] = key, after
    mark = chr(SPACE)
    return Vocabulary(text, byte_ids, min((s for _, s in pieces.values()), default=0.0) - UNKNOWN, max(map(len, pieces), default=1),
                      not any(mark in p.lstrip(mark) for p in pieces), chars, keys, nexts, np.array(score), np.array(ident, dtype=np.int32))


def code_points(segment: str) -> np.ndarray:
    codes = np.frombuffer(segment.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    codes[codes == SPACE] = LITERAL
    codes[codes == 0x20] = SPACE
    return codes


def piece_ends(codes: np.ndarray, left: np.ndarray, vocabulary: Vocabulary, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the pieces that end at each character, by length from `longest` to one.

    `left` is the number of characters from each position to the end of its segment; no piece in a segment is longer than `longest`.
    A character without a piece has id -1 - code point.
    """
    n = len(codes)
    scores = np.full((n + longest, longest), NONE)
    ids = np.zeros((n + longest, longest), dtype=np.int32)
    char = np.searchsorted(vocabulary.chars, codes)
    known = np.r_[vocabulary.chars, -1][char] == codes
    begin, node = np.flatnonzero(known), np.zeros(int(known.sum()), dtype=np.int64)
    for length in range(1, longest + 1):
        if not len(begin):
            break
        node = vocabulary.step(node, char[begin + length - 1])
        begin, node = begin[node >= 0], node[node >= 0]
        ends = vocabulary.ident[node] >= 0
        at = begin[ends] + length - 1
        scores[at, longest - length] = vocabulary.score[node[ends]]
        ids[at, longest - length] = vocabulary.ident[node[ends]]
        more = left[begin] > length
        begin, node = begin[more], node[more]
        more = known[begin + length]
        begin, node = begin[more], node[more]
    lone = np.flatnonzero(scores[:n, longest - 1] == NONE)
    scores[lone, longest - 1] = vocabulary.unknown
    ids[lone, longest - 1] = -1 - codes[lone]
    return scores, ids


def forward(scores: np.ndarray, starts: np.ndarray, size: int, entry: np.ndarray, over: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of many chunks side by side, from the scores at their left boundaries.

    `entry[c, s]` is the best score with the first s characters of chunk c taken by
    a piece from before. Returns best[c, j] and the length of the piece that ends at
    j (0: it came from before) for j up to `size`, and with `over` for the overhangs beyond,
    reached by pieces that begin inside the chunk.
    """
    n, longest = entry.shape
    last = size + longest - 1 if over else size
    best = np.full((n, longest + last + 1), NONE)
    back = np.zeros((n, last + 1), dtype=np.int8 if longest < 128 else np.int32)
    best[:, longest] = entry[:, 0]
    rows = np.arange(n)
    for j in range(1, last + 1):
        reach = best[:, j:j + longest] + scores[starts + j - 1]
        if j > size:
            reach[:, longest - (j - size):] = NONE  # pieces that begin in the next chunk
        at = reach.argmax(axis=1)
        most = reach[rows, at]
        if j < longest:
            before = entry[:, j] >= most
            best[:, longest + j] = np.where(before, entry[:, j], most)
            back[:, j] = np.where(before, 0, longest - at)
        else:
            best[:, longest + j] = most
            back[:, j] = longest - at
    return best[:, longest:], back


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two stacks of matrices in max-plus algebra."""
    out = np.full((*a.shape[:-1], b.shape[-1]), NONE)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k:k + 1] + b[..., k:k + 1, :], out=out)
    return out


def running_products(matrices: np.ndarray) -> np.ndarray:
    """Product of the first i + 1 matrices for each i, in log2(n) rounds."""
    out, width = matrices.copy(), 1
    while width < len(out):
        out[width:] = max_plus(out[:-width], out[width:])
        width *= 2
    return out


def _traced(back: np.ndarray, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """For each chunk, the ids of its pieces that end at `at` or before, as 32-bit integers."""
    rows, at, steps = np.arange(len(at)), at.copy(), []
    counts = np.zeros(len(at), dtype=np.int64)
    while len(rows):
        length = back[rows, at[rows]].astype(np.int64)
        rows, length = rows[length > 0], length[length > 0]
        if len(rows):
            steps.append((rows, ids[starts[rows] + at[rows] - 1, ids.shape[1] - length]))
            counts[rows] += 1
            at[rows] -= length
            rows = rows[at[rows] > 0]
    ends = np.cumsum(counts)
    flat = np.empty(int(counts.sum()), dtype=np.int32)
    for k, (rows, found) in enumerate(steps):
        flat[ends[rows] - 1 - k] = found  # found from the last piece to the first
    whole = flat.tobytes()
    out = [whole[4 * a:4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
        spelled: list[int] = []
        for piece in np.frombuffer(out[i], dtype=np.int32).tolist():
            char = -1 - piece
            spelled += [piece] if piece >= 0 else [vocabulary.byte_ids[b] for b in chr(SPACE if char == LITERAL else char).encode()]
        out[i] = np.array(spelled, dtype=np.int32).tobytes()
    return out


def _from_start(n: int, longest: int) -> np.ndarray:
    entry = np.full((n, longest), NONE)
    entry[:, 0] = 0.0
    return entry


def encode_short(segments: list[str], vocabulary: Vocabulary) -> list[tuple[bytes, float]]:
    """Segments that are chunks of their own, solved side by side."""
    lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    ends, order = np.cumsum(lengths), order.tolist()
    out: list = [None] * len(segments)
    lo = 0
    while lo < len(order):
        full = np.searchsorted(ends, ends[lo] - lengths[lo] + BATCH_CHARS) + 1
        hi = int(min(full, np.searchsorted(lengths, lengths[lo] + lengths[lo] // 4 + 1, side="right")))
        part, sizes = [segments[i] for i in order[lo:hi]], lengths[lo:hi]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        codes = code_points("".join(part))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
        most = int(sizes.max())
        longest = min(vocabulary.longest, most)
        scores, ids = piece_ends(codes, left, vocabulary, longest)
        scores = np.concatenate([scores, np.full((most, longest), NONE)])
        best, back = forward(scores, starts, most, _from_start(len(part), longest), over=False)
        traced = _traced(back, ids, starts, sizes, vocabulary)
        for i, found, score in zip(order[lo:hi], traced, best[np.arange(len(part)), sizes].tolist(), strict=True):
            out[i] = (found, score)
        lo = hi
    return out


class Chunk:
    """A part of a text: `size` characters, and in `codes` up to `longest` - 1 more that its last pieces may reach.

    Its own parts of `chunk` characters are worked on side by side.
    """

    def __init__(self, codes: np.ndarray, size: int, final: bool, vocabulary: Vocabulary, chunk: int = CHUNK):
        self.vocabulary, self.final, self.longest = vocabulary, final, vocabulary.longest
        self.chunk = max(chunk, self.longest)
        count = max(1, size // self.chunk)  # the last part takes the rest, so none is shorter than a piece
        self.starts, self.rest = np.arange(count) * self.chunk, size - (count - 1) * self.chunk
        scores, self.ids = piece_ends(codes, len(codes) - np.arange(len(codes)), vocabulary, self.longest)
        self.scores = np.concatenate([scores, np.full((self.chunk + self.longest, self.longest), NONE)])
        self.matrices = None

    def _matrices(self) -> np.ndarray:
        """The transfer matrices of all parts; every entry state is a lane of its own."""
        if self.matrices is None:
            longest, count = self.longest, len(self.starts)
            unit = np.full((longest, longest), NONE)
            np.fill_diagonal(unit, 0.0)
            self.matrices = np.empty((count, longest, longest))
            each = max(1, BATCH_CHARS // (longest * longest))
            for lo in range(0, count - 1, each):
                some = self.starts[lo:min(lo + each, count - 1)]
                best, _ = forward(self.scores, np.repeat(some, longest), self.chunk, np.tile(unit, (len(some), 1)), over=True)
                self.matrices[lo:lo + len(some)] = best[:, self.chunk:].reshape(len(some), longest, longest)
            if not self.final:
                best, _ = forward(self.scores, np.repeat(self.starts[-1:], longest), self.rest, unit, over=True)
                self.matrices[-1] = best[:, self.rest:]
        return self.matrices

    def matrix(self) -> np.ndarray:
        """From the overhang at the left boundary to that at the right; not of a final chunk."""
        return running_products(self._matrices())[-1]

    def enter(self, entry: np.ndarray) -> np.ndarray:
        """Fill in back pointers from the scores at the left boundary; returns for each overhang at the right the one at the left
        that it comes from. A final chunk has the overhang 0 only, and its score in `score`."""
        count = len(self.starts)
        entries = np.empty((count, self.longest))
        entries[0] = entry
        if count > 1:
            entries[1:] = (entry[None, :, None] + running_products(self._matrices()[:-1])).max(axis=1)
        self.backs, self.comes = [], np.zeros((count, self.longest), dtype=np.int64)
        each = max(1, BATCH_CHARS // self.chunk)
        for lo in range(0, count - 1, each):
            some = self.starts[lo:min(lo + each, count - 1)]
            _, back = forward(self.scores, some, self.chunk, entries[lo:lo + len(some)], over=True)
            self.backs.append(back)
            self.comes[lo:lo + len(some)] = self._sources(back, self.chunk)
        self.each = each
        best, self.tail = forward(self.scores, self.starts[-1:], self.rest, entries[-1:], over=not self.final)
        self.score = float(best[0, self.rest])
        ends = self._sources(self.tail, self.rest, 1 if self.final else self.longest)[0]
        self.comes[-1, :len(ends)] = ends
        at = ends
        for c in range(count - 2, -1, -1):
            at = self.comes[c, at]
        return at

    def _sources(self, back: np.ndarray, size: int, overhangs: int | None = None) -> np.ndarray:
        """For every overhang at the right: the entry at the left that the best cut comes from."""
        at = np.tile(np.arange(size, size + (overhangs or self.longest)), (len(back), 1))
        rows = np.arange(len(back))[:, None]
        while True:
            step = back[rows, at]
            if not step.any():
                return at
            at = at - step

    def trace(self, overhang: int = 0) -> bytes:
        """The ids of the pieces that begin in the chunk, given the overhang at its right."""
        exits = np.zeros(len(self.starts), dtype=np.int64)
        exits[-1] = overhang
        for c in range(len(exits) - 2, -1, -1):
            exits[c] = self.comes[c + 1, exits[c + 1]]
        out = []
        for k, back in enumerate(self.backs):
            mine = slice(k * self.each, k * self.each + len(back))
            out += _traced(back, self.ids, self.starts[mine], self.chunk + exits[mine], self.vocabulary)
        return b"".join(out + _traced(self.tail, self.ids, self.starts[-1:], self.rest + exits[-1:], self.vocabulary))


def encode_long(segment: str, vocabulary: Vocabulary, chunk: int = CHUNK) -> tuple[bytes, float]:
    """One long segment by transfer matrices of its chunks."""
    whole = Chunk(code_points(segment), len(segment), True, vocabulary, chunk)
    whole.enter(_from_start(1, vocabulary.longest)[0])
    return whole.trace(), whole.score


def encode(texts: list[str | None], vocabulary: Vocabulary, chunk: int = CHUNK) -> list[tuple[bytes, float]]:
    """Ids (32-bit integers) and score of each text."""
    return [(ids, score) for ids, score, _ in encode_and_decode(texts, vocabulary, chunk)]


def encode_and_decode(texts: list[str | None], vocabulary: Vocabulary, chunk: int = CHUNK) -> list[tuple[bytes, float, str]]:
    """Ids, score and the text decoded from the ids of each text; a segment is encoded and decoded once while it is remembered."""
    cut = [(re.findall(r" +[^ ]*", " " + t) if vocabulary.splits else [" " + t]) if t else [] for t in texts]
    known, met = vocabulary.ids_of, set(chain.from_iterable(cut))
    if len(known) > REMEMBER:  # those of these texts stay, the frequent ones among them
        kept = {s: known[s] for s in met.intersection(known)}
        known.clear()
        known.update(kept)
    new = met.difference(known)
    short = [s for s in new if len(s) <= chunk]
    long_ = [s for s in new if len(s) > chunk]
    solved = encode_short(short, vocabulary)
    pieces, at = _pieces(b"".join([ids for ids, _ in solved]), vocabulary), 0
    for s, (ids, score) in zip(short, solved, strict=True):
        end = at + len(ids) // 4
        known[s] = ids, score, b"".join(pieces[at:end])
        at = end
    for s in long_:
        ids, score = encode_long(s, vocabulary, chunk)
        known[s] = ids, score, b"".join(_pieces(ids, vocabulary))
    out = []
    for segments in cut:
        found = list(map(known.__getitem__, segments))
        out.append((b"".join([ids for ids, _, _ in found]), math.fsum([score for _, score, _ in found]), _text([back for _, _, back in found])))
    for s in long_:
        del known[s]
    return out


def _pieces(ids: bytes, vocabulary: Vocabulary) -> list[bytes]:
    return list(map(vocabulary.text.__getitem__, np.frombuffer(ids, dtype=np.int32).tolist()))


def _text(pieces: Iterable[bytes]) -> str:
    return b"".join(pieces)[1:].decode("utf-8", errors="replace")


def decode(ids: bytes | list[int], vocabulary: Vocabulary) -> str:
    """The text of ids, given as a list or as 32-bit integers."""
    if isinstance(ids, bytes):
        ids = np.frombuffer(ids, dtype=np.int32).tolist()
    return _text(map(vocabulary.text.__getitem__, ids))


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices with a bounded number of characters and their texts (last column)."""
    for batch in batches:
        lo, size, texts = 0, 0, []
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size > most:
                yield batch.slice(lo, i + 1 - lo), texts
                lo, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(lo), texts


def _encode(vocabulary: Vocabulary, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _runs(batches):
            found = encode_and_decode(texts, vocabulary)
            scores = pa.array([score for _, score, _ in found])
            same = pa.array([back == (t or "") for (_, _, back), t in zip(found, texts, strict=True)])
            yield _columns(batch.columns[:-1], batch.schema.names[:-1], [ids for ids, _, _ in found], scores, same, digest)
    return run


def _columns(kept: list, names: list[str], ids: list[bytes], scores: pa.Array, same: pa.Array, digest: bool) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    if digest:
        last = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
    else:
        last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
    return pa.RecordBatch.from_arrays([*kept, pa.array(sizes), scores, same, last], [*names, "n_pieces", "score", "round_trip", "ids"])


# --- giant texts: chunks as rows ---------------------------------------------------

PART = "number bigint, c bigint"


def _split_giants(longest: int, giant: int):
    """(number, text) to its chunks (number, c, final, size, part), a part with the characters that its last pieces may reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = " " + value.as_py()
                count = max(1, len(text) // giant)  # the last takes the rest
                for c in range(count):
                    lo, hi = c * giant, (c + 1) * giant if c < count - 1 else len(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([c]), pa.array([c == count - 1]), pa.array([hi - lo]), pa.array([text[lo:hi + longest - 1]])],
                        ["number", "c", "final", "size", "part"])
    return run


def _each_row(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """`work` gives the values of (number, c, data, score) for a row's columns."""
    for batch in batches:
        out = [work(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["number", "c", "data", "score"])


def _chunk_matrices(vocabulary: Vocabulary):
    def work(number, c, size, part):
        return number, c, Chunk(code_points(part), size, False, vocabulary).matrix().tobytes(), None
    return lambda batches: _each_row(batches, work)


def _chunk_sources(vocabulary: Vocabulary):
    """Chunks with their entry to where each overhang at the right comes from, and the score of final ones."""
    def work(number, c, final, size, part, entry):
        chunk = Chunk(code_points(part), size, final, vocabulary)
        comes = chunk.enter(np.frombuffer(entry))
        return number, c, comes.astype(np.int64).tobytes(), chunk.score if final else None
    return lambda batches: _each_row(batches, work)


def _chunk_ids(vocabulary: Vocabulary):
    def work(number, c, final, size, part, entry, overhang):
        chunk = Chunk(code_points(part), size, final, vocabulary)
        chunk.enter(np.frombuffer(entry))
        return number, c, chunk.trace(int.from_bytes(overhang, "little")), None
    return lambda batches: _each_row(batches, work)


def _in_order(group: pa.Table) -> list[tuple[int, bytes]]:
    return sorted(zip(group.column("c").to_pylist(), group.column("data").to_pylist(), strict=True))


def _band_product(longest: int):
    """The matrices of a band of chunks to their product."""
    def run(group: pa.Table) -> pa.Table:
        first = group.column("c")[0].as_py()
        stack = np.stack([np.frombuffer(m).reshape(longest, longest) for _, m in _in_order(group)])
        return _parts([(group.column("number")[0].as_py(), first // BAND, running_products(stack)[-1].tobytes())])
    return run


def _parts(rows: list[tuple]) -> pa.Table:
    return pa.table({"number": pa.array([r[0] for r in rows], pa.int64()), "c": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _band_entries(longest: int):
    """The matrices of a band and the scores at its left boundary to those at the right boundary of each chunk."""
    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        rows, entry = [], np.frombuffer(known.column("data")[0].as_py()) if len(known) else _from_start(1, longest)[0]
        for c, matrix in _in_order(group) if len(group) else []:
            entry = (entry[:, None] + np.frombuffer(matrix).reshape(longest, longest)).max(axis=0)
            rows.append((group.column("number")[0].as_py(), c + 1, entry.tobytes()))
        return _parts(rows)
    return run


def _entries(matrices: DataFrame, longest: int, most: int) -> DataFrame:
    """(number, c, data): the scores at the left boundary of each chunk but the first, from products of bands of chunks,
    of bands of bands, and so on: log(chunks) / log(BAND) rounds. `most` is the largest c."""
    spark, kind = matrices.sparkSession, f"{PART}, data binary"
    band = F.floor(F.col("c") / BAND).alias("band")
    none = matrices.where("false")
    if most >= BAND:
        above = cut(spark, matrices.groupBy("number", band).applyInArrow(_band_product(longest), kind), "band-products")
        known = _entries(above, longest, most // BAND).withColumnRenamed("c", "band")
    else:
        known = none.withColumnRenamed("c", "band")
    return cut(spark, matrices.groupBy("number", band).cogroup(known.groupBy("number", "band")).applyInArrow(_band_entries(longest), kind), "entries")


def _band_maps(group: pa.Table) -> pa.Table:
    """The maps of a band of chunks to one, from the overhang at its right to that at its left."""
    at = None
    for c, comes in reversed(_in_order(group)):
        at = np.frombuffer(comes, dtype=np.int64) if at is None else np.frombuffer(comes, dtype=np.int64)[at]
    return _parts([(group.column("number")[0].as_py(), c // BAND, at.tobytes())])


def _band_exits(group: pa.Table, known: pa.Table) -> pa.Table:
    """The maps of a band and the overhang at its right to that at the right of each chunk."""
    rows, at = [], int.from_bytes(known.column("data")[0].as_py(), "little") if len(known) else 0
    for c, comes in reversed(_in_order(group)) if len(group) else []:
        rows.append((group.column("number")[0].as_py(), c, at.to_bytes(8, "little")))
        at = int(np.frombuffer(comes, dtype=np.int64)[at])
    return _parts(rows)


def _exits(sources: DataFrame, most: int) -> DataFrame:
    """(number, c, data): the overhang at the right of each chunk, composed from the right in the same rounds. The last is 0."""
    spark, kind = sources.sparkSession, f"{PART}, data binary"
    band = F.floor(F.col("c") / BAND).alias("band")
    if most >= BAND:
        above = cut(spark, sources.groupBy("number", band).applyInArrow(_band_maps, kind), "band-maps")
        known = _exits(above, most // BAND).withColumnRenamed("c", "band")
    else:
        known = sources.where("false").withColumnRenamed("c", "band")
    return cut(spark, sources.groupBy("number", band).cogroup(known.groupBy("number", "band")).applyInArrow(_band_exits, kind), "exits")


def _encode_giants(giants: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(number, ids, score) of (number, text), every chunk worked on in a task of its own choice."""
    spark, longest, kind = giants.sparkSession, vocabulary.longest, f"{PART}, data binary, score double"
    chunks = cut(spark, giants.mapInArrow(_split_giants(longest, GIANT), f"{PART}, final boolean, size bigint, part string").repartition("number", "c"), "chunks")
    most = chunks.agg(F.max("c")).first()[0] or 0
    matrices = cut(spark, chunks.where("NOT final").select("number", "c", "size", "part").mapInArrow(_chunk_matrices(vocabulary), kind).drop("score"), "matrices")
    start = F.lit(_from_start(1, longest)[0].tobytes())
    entered = cut(spark, chunks.join(_entries(matrices, longest, most).withColumnRenamed("data", "entry"), ["number", "c"], "left").select(
        "number", "c", "final", "size", "part", F.coalesce("entry", start).alias("entry")), "entered")
    sources = cut(spark, entered.mapInArrow(_chunk_sources(vocabulary), kind), "sources")
    exits = _exits(sources.drop("score"), most)
    traced = entered.join(exits.withColumnRenamed("data", "overhang"), ["number", "c"])
    ids = traced.select("number", "c", "final", "size", "part", "entry", "overhang").mapInArrow(_chunk_ids(vocabulary), kind)
    whole = ids.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda x: x["data"]).alias("ids"))
    return whole.join(sources.where(F.col("score").isNotNull()).select("number", "score"), "number")


def _finish(digest: bool, vocabulary: Vocabulary):
    """(kept columns, text, ids of its chunks, score) to the encoder's columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, parts, score = batch.columns[-3:]
            joined = [b"".join(p) for p in parts.to_pylist()]
            same = pa.array([decode(ids, vocabulary) == t for ids, t in zip(joined, text.to_pylist(), strict=True)], pa.bool_())
            yield _columns(batch.columns[:-3], batch.schema.names[:-3], joined, score, same, digest)
    return run


def encode_texts(rows: DataFrame, vocabulary: Vocabulary, keep: list[Column], text: str = "text", digest: bool = False) -> DataFrame:
    """`keep` columns with n_pieces, score, round_trip (decoding gives the text back) and
    ids; with `digest`, ids is the SHA-256 of the ids as little-endian 32-bit integers.
    Texts of two chunks or more (`GIANT` characters each) are spread over tasks."""
    spark = rows.sparkSession
    asked = rows.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])
    schema = f"{fields}, n_pieces bigint, score double, round_trip boolean, ids {'string' if digest else 'array<int>'}"
    long_ = F.coalesce(F.char_length("_text") + 1 >= 2 * GIANT, F.lit(False))
    short = asked.where(~long_).mapInArrow(_encode(vocabulary, digest), schema)
    kept = [F.col(f"`{f.name}`") for f in asked.schema.fields[:-1]]
    giants = cut(spark, asked.where(long_).select(F.struct(*kept).alias("keep"), F.col("_text").alias("text"), F.monotonically_increasing_id().alias("number")), "giants")
    if giants.isEmpty():
        return short
    found = _encode_giants(giants.select("number", "text"), vocabulary).select("number", "ids", "score")
    return short.unionByName(giants.join(found, "number").select("keep.*", "text", "ids", "score").mapInArrow(_finish(digest, vocabulary), schema))


def decode_ids(rows: DataFrame, vocabulary: Vocabulary, keep: list[Column], ids: str = "ids") -> DataFrame:
    """`keep` columns with the decoded text."""
    asked = rows.select(*keep, F.col(ids).alias("_ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x, vocabulary) if x else "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])
    return asked.mapInArrow(run, f"{fields}, text string")

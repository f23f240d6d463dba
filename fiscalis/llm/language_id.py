"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over
hashed byte bigrams and trigrams tells the languages with +1 from those with -1
(log-ratio of their smoothed n-gram distributions, all languages weighing the
same). A text's outputs are compared with every codeword by a logistic loss per
bit, weighted by how well the bit's classifier separates that language
(mean over spread of its output on the language's own n-grams); the nearest codeword
is the answer, and a small lead over the second marks the text as ambiguous.

Up to `EXHAUSTIVE` languages the code is exhaustive (every split once); beyond
that it is the random code of 10 log2 n bits with the largest least distance
among 200 drawn with a fixed seed. Training counts n-grams of all training rows;
the model is languages x `FEATURES` numbers, whatever the corpus.

Results for odd input: NULL texts and texts without a letter are `und` with score 0;
rows with NULL or empty language teach nothing; with no language learned every
text is `und`, with one learned every text has it with score 1; of codewords
equally near the first by name wins. Rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, text_buffer

PLANE = 1 << 16
FEATURES = 2 * PLANE  # bigrams as they are, trigrams hashed
EXHAUSTIVE = 6
SMOOTHING = 0.5
STEEPNESS = 2.0
SHARPNESS = 4.0
LEAD = 0.2
BLOCK = 1 << 18
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray     # languages x bits
    trust: np.ndarray    # languages x bits, rows sum to 1
    weights: np.ndarray  # FEATURES x bits


def _folded() -> np.ndarray:
    fold = np.full(256, 32, dtype=np.uint8)
    fold[128:] = np.arange(128, 256)
    for a, b in (("a", "z"), ("A", "Z")):
        fold[ord(a):ord(b) + 1] = np.arange(ord("a"), ord("z") + 1)
    return fold


def _spaced(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with two spaces before each and after the last, so that no n-gram has letters of two."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full(len(data) + 2 * len(offsets), 32, dtype=np.uint8)
    out[np.arange(len(data)) + 2 * rows + 2] = fold[data]
    return out, offsets + 2 * np.arange(len(offsets))


def _features(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and trigram features that begin at each byte but the last two."""
    x = block.astype(np.uint32)
    pair = (x[:-1] << np.uint32(8)) | x[1:]
    triple = ((pair[:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)
    return pair[:-1].astype(np.int64), (triple >> np.uint32(16)).astype(np.int64) + PLANE


def _blocks(spaced: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, len(spaced) - 2, BLOCK):
        yield (at, *_features(spaced[at:at + BLOCK + 2]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    fold = _folded()
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in row_slices(offsets, 1 << 20):
            for language in set(languages[lo:hi]):
                mine = counts.setdefault(language, np.zeros(FEATURES, dtype=np.int64))
                rows = np.flatnonzero(languages[lo:hi] == language) + lo
                part = np.concatenate([data[offsets[r]:offsets[r + 1]] for r in rows])
                spaced, _ = _spaced(part, np.r_[0, np.cumsum(offsets[rows + 1] - offsets[rows])], fold)
                for _, pair, triple in _blocks(spaced):
                    mine += np.bincount(pair, minlength=FEATURES) + np.bincount(triple, minlength=FEATURES)
    for language, mine in counts.items():
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["language", "feature", "n"])


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages."""
    if n <= EXHAUSTIVE:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(n)] for split in range(1, 1 << max(n - 1, 0))]
        return np.array(bits, dtype=np.int64).reshape(-1, max(n, 1)).T[:n]
    draw, best, most = np.random.RandomState(5), None, -1
    for _ in range(200):
        code = draw.choice([-1, 1], (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = int(((code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * code.shape[1]).min())
        if apart > most:
            best, most = code, apart
    return best


def fit_languages(rows: DataFrame, language: str = "lang", text: str = "text") -> Model:
    """The model of all rows with a text and a language."""
    known = rows.select(F.col(language).cast("string").alias("language"), F.col(text).alias("text")).where("language <> '' AND text IS NOT NULL")
    counted = known.mapInArrow(_count, "language string, feature int, n bigint").groupBy("language", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("language").to_pylist()))
    counts = np.zeros((len(names), FEATURES))
    owner = np.searchsorted(np.array(names, dtype=object), np.array(counted.column("language").to_pylist(), dtype=object)) if names else []
    counts[owner, counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    code = codewords(len(names))
    weights = np.zeros((FEATURES, code.shape[1]))
    trust = np.ones(code.shape) / max(1, code.shape[1])
    if code.shape[1]:
        # Bigrams and trigrams are two distributions with half of the mass each.
        share = np.concatenate([(half + SMOOTHING) / (half + SMOOTHING).sum(axis=1, keepdims=True) / 2 for half in np.split(counts, 2, axis=1)], axis=1)
        for b in range(code.shape[1]):
            weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
        mean = share @ weights
        weights /= np.abs(mean).mean(axis=0)
        mean = share @ weights
        spread = np.sqrt(np.maximum(share @ weights ** 2 - mean ** 2, 1e-12))
        trust = np.maximum(code * mean / spread, 1e-6)
        trust /= trust.sum(axis=1, keepdims=True)
    return Model(names, code, trust, weights.astype(np.float32))


def _outputs(data: np.ndarray, offsets: np.ndarray, model: Model, fold: np.ndarray) -> np.ndarray:
    """Mean classifier output of each text and bit."""
    spaced, starts = _spaced(data, offsets, fold)
    total = np.zeros((len(offsets) - 1, model.code.shape[1]))
    for at, pair, triple in _blocks(spaced):
        both = model.weights[pair] + model.weights[triple]
        first = int(np.searchsorted(starts, at, side="right")) - 1
        last = min(int(np.searchsorted(starts, at + len(pair), side="left")), len(offsets) - 1)
        cuts = np.maximum(starts[first:last] - at, 0)
        total[first:last] += np.add.reduceat(both, cuts, axis=0)
    return total / (np.diff(starts) * 2)[:, None]


def _decode(outputs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the nearest codeword, its score and whether the second is close."""
    loss = np.log1p(np.exp(-STEEPNESS * np.clip(model.code[None] * outputs[:, None, :], -50, 50)))
    distance = (loss * model.trust[None]).sum(axis=2)
    nearest = distance.argmin(axis=1)
    chance = np.exp(-SHARPNESS * (distance - distance.min(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    order = np.sort(chance, axis=1)
    second = order[:, -2] if chance.shape[1] > 1 else np.zeros(len(chance))
    return nearest, order[:, -1], order[:, -1] - second < LEAD


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, names = _folded(), np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = text_buffer(batch.column("_text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in row_slices(offsets, 1 << 20):
                known = letters[lo:hi] & bool(model.languages)
                if model.languages:
                    nearest, score, close = _decode(_outputs(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], model, fold), model)
                else:
                    nearest, score, close = np.zeros(hi - lo, dtype=int), np.zeros(hi - lo), np.zeros(hi - lo, dtype=bool)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names[np.where(known, nearest, -1)].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)],
                    [*batch.schema.names[:-2], "lang_pred", "score", "ambiguous"])
    return run


def predict_languages(rows: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns with lang_pred, score (0 to 1) and ambiguous."""
    asked = rows.select(*keep, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-2])
    return asked.mapInArrow(_predict(model), f"{fields}, lang_pred string, score double, ambiguous boolean")

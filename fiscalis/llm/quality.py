"""Text quality by a byte-level convolutional network, in numpy.

`FILTERS` learned filters of `WIDTH` bytes slide over the whole text. Each chunk of
`2 * STEP` bytes (chunks overlap by half) keeps, per filter, its largest rectified
activation; over the chunks of a text these are pooled to their largest, mean and
smallest value, so that one bad passage as well as a chunk that lacks the usual
patterns shows; a logistic unit makes one probability of them. Activations are computed once per
step and joined to chunks, and at most `ROWS` steps are in memory at once.

The network is fitted on the driver by Adam with fixed seeds, on a bounded
sample: about `FIT_ROWS` labelled rows of each label, picked by the hash of their key (all
where there are fewer). Their texts are read whole, as in scoring; each is fetched once and
its activations are computed `ROWS` steps at a time. Rows are weighted back to the share of the labels among all labelled rows.

Results for odd input: NULL and empty texts are one chunk without activations and get the
score of such; rows with a NULL label teach nothing; without labelled rows every
score is 1, with one label only it is that label. Rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import row_slices, text_buffer

FILTERS, WIDTH, STEP = 24, 6, 256
ROWS = 128
FIT_ROWS = 700
UPDATES, BATCH, RATE = 600, 32, 0.02
THRESHOLD = 0.3
PAD = 0


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray     # FILTERS
    weights: np.ndarray  # 3 * FILTERS + 1
    offset: float


def _activations(steps: np.ndarray, net: Network) -> np.ndarray:
    """Largest rectified activation of each filter in each step; steps are STEP + WIDTH - 1 bytes."""
    out = np.empty((len(steps), FILTERS), dtype=np.float32)
    for at in range(0, len(steps), ROWS):
        part = steps[at:at + ROWS]
        total = np.take(net.filters[0], part[:, :STEP], axis=0)
        for i in range(1, WIDTH):
            total += np.take(net.filters[i], part[:, i:i + STEP], axis=0)
        out[at:at + ROWS] = total.max(axis=1)
    return np.maximum(out + net.bias, 0)


def _steps(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The steps of data[lo:hi], each with the bytes that its last windows reach into."""
    n = max(1, -(-(hi - lo) // STEP))
    padded = np.full(n * STEP + WIDTH - 1, PAD, dtype=np.uint8)
    padded[:hi - lo] = data[lo:hi]
    return np.lib.stride_tricks.sliding_window_view(padded, STEP + WIDTH - 1)[::STEP]


def _pooled(steps: np.ndarray, size: int) -> np.ndarray:
    """Largest, mean and smallest of the chunks' activations, and how full the first chunk is."""
    chunks = np.maximum(steps[:-1], steps[1:]) if len(steps) > 1 else steps
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0), chunks.min(axis=0), [min(1.0, size / (2 * STEP))]])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _score(net: Network | None, fallback: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in row_slices(offsets, 1 << 20):
                scores = np.full(hi - lo, fallback)
                if net is not None:
                    rows = [_steps(data, offsets[r], offsets[r + 1]) for r in range(lo, hi)]
                    ends = np.cumsum([len(r) for r in rows])
                    found = _activations(np.concatenate(rows), net)
                    pooled = np.array([_pooled(found[b - len(r):b], offsets[lo + i + 1] - offsets[lo + i]) for i, (r, b) in enumerate(zip(rows, ends, strict=True))])
                    scores = _sigmoid(pooled @ net.weights + net.offset)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*batch.schema.names[:-1], "score"])
    return run


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32), 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient ** 2 - self.v)
        return rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)


def _convolved(x: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Largest activation of each filter in each step, before the bias, and where it stands."""
    value, place = np.empty((len(x), FILTERS), dtype=np.float32), np.empty((len(x), FILTERS), dtype=np.int64)
    for lo in range(0, len(x), ROWS):
        part = x[lo:lo + ROWS]
        total = np.take(net.filters[0], part[:, :STEP], axis=0)
        for i in range(1, WIDTH):
            total += np.take(net.filters[i], part[:, i:i + STEP], axis=0)
        place[lo:lo + ROWS] = total.argmax(axis=1)
        value[lo:lo + ROWS] = np.take_along_axis(total, place[lo:lo + ROWS][:, None, :], axis=1)[:, 0]
    return value, place


def _loss_gradient(net: Network, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the weighted mean log loss of some texts by filters, bias, weights and offset."""
    steps = [_steps(t, 0, len(t)) for t in texts]
    x, n = np.concatenate(steps), np.array([len(s) for s in steps])
    value, place = _convolved(x, net)
    # A chunk is two neighbouring steps of a text, or its only step.
    first_step, pairs = np.cumsum(n) - n, np.maximum(n - 1, 1)
    owner, first = np.repeat(np.arange(len(texts)), pairs), np.cumsum(pairs) - pairs
    left = np.arange(len(owner)) - first[owner] + first_step[owner]
    right = np.minimum(left + 1, (first_step + n - 1)[owner])
    later = value[right] > value[left]
    best, source = np.where(later, value[right], value[left]), np.where(later, right[:, None], left[:, None])
    live = best + net.bias > 0
    h = np.where(live, best + net.bias, 0)
    counts = pairs[:, None]
    top, low = np.maximum.reduceat(h, first, axis=0), np.minimum.reduceat(h, first, axis=0)
    full = np.minimum(1.0, np.array([len(t) for t in texts]) / (2 * STEP))
    pooled = np.concatenate([top, np.add.reduceat(h, first, axis=0) / counts, low, full[:, None]], axis=1)
    error = (weight * (_sigmoid(pooled @ net.weights + net.offset) - labels) / len(texts)).astype(np.float32)
    back = error[:, None] * net.weights[None]
    to_top, to_mean, to_low = (back[:, k * FILTERS:(k + 1) * FILTERS] for k in range(3))

    def share(pool):
        same = h == pool[owner]
        return same / np.add.reduceat(same, first, axis=0, dtype=np.float32)[owner]
    toward = to_top[owner] * share(top) + (to_mean / counts)[owner] + to_low[owner] * share(low)
    toward = np.where(live, toward, 0).astype(np.float32)
    gradient = np.zeros_like(net.filters)
    column = np.broadcast_to(np.arange(FILTERS), source.shape)
    at = place[source, column]
    for i in range(WIDTH):
        np.add.at(gradient[i], (x[source, at + i], column), toward)
    return gradient, toward.sum(axis=0), error @ pooled, error.sum()


def _train(texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> Network:
    draw = np.random.RandomState(17)
    net = Network((0.3 * draw.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, dtype=np.float32),
                  (0.05 * draw.standard_normal(3 * FILTERS + 1)).astype(np.float32), 0.0)
    optimisers = [_Adam(net.filters.shape), _Adam(net.bias.shape), _Adam(net.weights.shape), _Adam(())]
    order: list[int] = []
    for update in range(UPDATES):
        if not order:
            order = draw.permutation(len(texts)).tolist()
        rows, order = order[:BATCH], order[BATCH:]
        filters, bias, weights, offset = _loss_gradient(net, [texts[r] for r in rows], labels[rows], weight[rows])
        rate = RATE * (1 - update / UPDATES)
        changes = [o.step(g, rate) for o, g in zip(optimisers, (filters, bias, weights + 1e-4 * net.weights, offset), strict=True)]
        net.filters -= changes[0]
        net.bias -= changes[1]
        net.weights -= changes[2]
        net.offset -= float(changes[3])
    return net


@dataclass
class Quality:
    network: Network | None
    fallback: float


def fit_quality(docs: DataFrame, labels: DataFrame, key: str, label: str = "quality", text: str = "text") -> Quality:
    """A network from the texts of `docs` whose key has a label of 0 or 1 in `labels`."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(totals) < 2:
        return Quality(None, float(max(totals, default=1)))
    # A row is picked by its key's hash alone: about FIT_ROWS of each label, whatever their number.
    share = F.when(F.col("label") == 0, FIT_ROWS / totals[0]).otherwise(FIT_ROWS / totals[1])
    picked = known.where(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 40)) < share * float(1 << 40))
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").select("label", "text")
    found = picked.toArrow()
    texts = [np.frombuffer((t.as_py() or "").encode(), dtype=np.uint8) for t in found.column("text")]
    labels = found.column("label").to_numpy()
    if len(set(labels.tolist())) < 2:
        return Quality(None, float(max(labels.tolist(), default=1)))
    weight = np.zeros(len(labels))
    for value in (0, 1):
        weight[labels == value] = totals[value] / sum(totals.values()) * len(labels) / (labels == value).sum()
    return Quality(_train(texts, labels, weight), 1.0)


def score_quality(rows: DataFrame, model: Quality, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns with score (0 to 1) and predicted (1 where score >= THRESHOLD)."""
    asked = rows.select(*keep, F.col(text).alias("_text"))
    # A schema, not its text: fields of a kept row may have any name.
    schema = StructType([*asked.schema.fields[:-1], StructField("score", DoubleType())])
    scored = asked.mapInArrow(_score(model.network, model.fallback), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

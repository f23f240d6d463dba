"""Quality classifier: held-out accuracy, chunked activations against a plain convolution, odd rows."""

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from pyspark.sql import functions as F  # noqa: E402

from fiscalis.llm import quality as q  # noqa: E402
from fiscalis.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = LLM_QUERIES["op8_quality_classifier"].build(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert len(good) > 200 and len(bad) > 20
    assert np.mean([s >= q.THRESHOLD for s in good]) > 0.98
    assert np.mean([s < q.THRESHOLD for s in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_activations_cover_the_whole_text():
    draw = np.random.RandomState(3)
    net = q.Network(draw.standard_normal((q.WIDTH, 256, q.FILTERS)).astype(np.float32), draw.standard_normal(q.FILTERS).astype(np.float32), np.zeros(1), 0.0)
    for n in (1, 5, q.STEP, q.STEP + 1, 3 * q.STEP - 2, 40_000):
        data = draw.randint(1, 256, n).astype(np.uint8)
        padded = np.r_[data, np.zeros(q.WIDTH + 2 * q.STEP, dtype=np.uint8)]
        count = max(1, -(-n // q.STEP)) * q.STEP
        plain = np.maximum(max((sum(net.filters[i][padded[p + i]] for i in range(q.WIDTH)) for p in range(min(count, 3000))), key=lambda v: v[0])[0] + net.bias[0], 0)
        found = q._activations(q._steps(data, 0, n), net)
        if count <= 3000:
            assert found[:, 0].max() == pytest.approx(plain, rel=1e-5)
        assert len(found) == count // q.STEP


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a good text " * 60), (2, "bad!! bad!! " * 60), (3, None), (3, ""), (None, "x"), (4, "é" * 60_000)], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS key", "0 AS label", "'s' AS score", "5 AS predicted")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = q.score_quality(docs, q.fit_quality(docs, labels, "doc_id"), [F.col("doc_id")]).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and by[1].score > by[2].score
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    none = q.fit_quality(docs, labels.where("false"), "doc_id")
    assert {r.predicted for r in q.score_quality(docs, none, [F.col("doc_id")]).collect()} == {1}
    assert {r.score for r in q.score_quality(docs, q.fit_quality(docs, labels.where("quality = 0"), "doc_id"), [F.col("doc_id")]).collect()} == {0.0}
    assert q.score_quality(docs.where("false"), none, [F.col("doc_id")]).count() == 0


def plain_pooled(text, net):
    """Chunk by chunk, window by window, without any sharing."""
    steps = max(1, -(-len(text) // q.STEP))
    padded = [*text.tolist(), *[q.PAD] * (steps * q.STEP + q.WIDTH - len(text))]
    chunks = [(k * q.STEP, min((k + 2) * q.STEP, steps * q.STEP)) for k in range(max(1, steps - 1))]
    rows = []
    for lo, hi in chunks:
        rows.append([max(0.0, max(sum(float(net.filters[i][padded[p + i]][f]) for i in range(q.WIDTH)) for p in range(lo, hi)) + float(net.bias[f]))
                     for f in range(q.FILTERS)])
    columns = list(zip(*rows))
    return [*map(max, columns), *(sum(c) / len(c) for c in columns), *map(min, columns), min(1.0, len(text) / (2 * q.STEP))]


def some_network(monkeypatch, filters=3, step=16):
    monkeypatch.setattr(q, "FILTERS", filters)
    monkeypatch.setattr(q, "STEP", step)
    draw = np.random.RandomState(5)
    net = q.Network(draw.standard_normal((q.WIDTH, 256, filters)).astype(np.float32), draw.standard_normal(filters).astype(np.float32),
                    draw.standard_normal(3 * filters + 1).astype(np.float32), 0.3)
    texts = [draw.randint(1, 256, n).astype(np.uint8) for n in (0, 1, 15, 16, 17, 32, 33, 100, 1000)]
    return net, texts


def test_scores_equal_a_plain_network(spark, monkeypatch):
    net, texts = some_network(monkeypatch)
    letters = ["".join(chr(97 + c % 26) for c in t) for t in texts]
    batch = q.pa.RecordBatch.from_arrays([q.pa.array(letters)], ["_text"])
    got = np.concatenate([b.column(b.num_columns - 1).to_numpy() for b in q._score(net, 1.0)(iter([batch]))])
    for text, score in zip(letters, got):
        pooled = plain_pooled(np.frombuffer(text.encode(), dtype=np.uint8), net)
        z = sum(float(w) * p for w, p in zip(net.weights, pooled)) + net.offset
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-4, abs=1e-9)


def test_gradient_equals_the_slope_of_a_plain_loss(monkeypatch):
    net, texts = some_network(monkeypatch)
    net.filters *= 0.2
    labels, weight = np.arange(len(texts)) % 2, np.linspace(0.5, 1.5, len(texts))

    def loss(n):
        total = 0.0
        for text, y, w in zip(texts, labels, weight):
            z = float(np.dot(plain_pooled(text, n), n.weights.astype(float))) + n.offset
            total += w * (np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z)))
        return total / len(texts)
    filters, bias, weights, offset = q._loss_gradient(net, texts, labels, weight)
    h = 1e-3

    def slope(change):
        values = []
        for sign in (1, -1):
            other = q.Network(net.filters.copy(), net.bias.copy(), net.weights.copy(), net.offset)
            change(other, sign * h)
            values.append(loss(other))
        return (values[0] - values[1]) / (2 * h)

    def nudge(name, at):
        def change(n, by):
            getattr(n, name)[at] += by
        return change
    spots = np.argsort(-np.abs(filters).ravel())[:4]
    for spot in spots:
        at = np.unravel_index(spot, filters.shape)
        assert filters[at] == pytest.approx(slope(nudge("filters", at)), rel=0.05, abs=1e-4)
    for k in range(q.FILTERS):
        assert bias[k] == pytest.approx(slope(nudge("bias", k)), rel=0.05, abs=1e-4)
    for k in (0, q.FILTERS, 2 * q.FILTERS, 3 * q.FILTERS):
        assert weights[k] == pytest.approx(slope(nudge("weights", k)), rel=0.02, abs=1e-4)
    assert offset == pytest.approx(slope(lambda n, by: setattr(n, "offset", n.offset + by)), rel=0.02, abs=1e-4)

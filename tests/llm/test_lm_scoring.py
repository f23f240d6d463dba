"""Language-model scores against exact counts in Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from pyspark.sql import functions as F  # noqa: E402

from fiscalis.llm import lm_scoring as lm  # noqa: E402
from fiscalis.llm.common import distinct  # noqa: E402
from fiscalis.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return low.encode().split() + [b""]


def quantised(c):
    return float(lm.count_of(lm.level_of(np.array([c])))[0]) if c else 0.0


def exact(train, text):
    """(n_tokens, n_known, N, base, score) from whole counts."""
    one, two = Counter(), Counter()
    for t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip(["<s>", *w], w))
    n, v = sum(one.values()), len(one)
    w = tokens(text)
    base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
    score = 0.0
    for before, x in zip(["<s>", *w], w):
        seen = quantised(len(train)) if before == "<s>" else quantised(one[before])
        score += math.log10((min(quantised(two[before, x]), seen) + lm.SMOOTHING * (quantised(one[x]) + 1) / (n + v + 1)) / (seen + lm.SMOOTHING))
    return len(w), sum(one[x] > 0 for x in w), n, base, score


@pytest.mark.parametrize("head", [200_000, 10])
def test_query(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = LLM_QUERIES["op2_lm_scoring"].build(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows[::9]:
        n, known, total, base, score = exact(train, docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=2e-3)


def test_levels():
    counts = np.arange(1, 5000)
    back = lm.count_of(lm.level_of(counts))
    assert (np.diff(lm.level_of(counts)) >= 0).all() and back[0] == 1 and lm.count_of(np.array([0]))[0] == 0
    assert (np.abs(back - counts) / counts).max() < 0.5


@pytest.mark.parametrize("spare", [0, 13, 40])
def test_packed_hashes_come_back(spare):
    for part, parts, n in ((0, 256, 0), (3, 256, 1), (255, 256, 5000), (511, 512, 70)):
        width = (1 << 64) // parts
        hashes = np.unique(np.uint64(part * width) + (lm.mix64(np.arange(n, dtype=np.uint64)) // np.uint64(parts) >> np.uint64(spare) << np.uint64(spare)))
        data = lm._pack(hashes, part, parts, spare)
        assert (lm._unpack(lm.pa.py_buffer(data), part, parts, spare) == hashes).all()
        assert n < 5000 or len(data) < n * (8 * 8 - 8 - spare) / 8


def test_distinct_grams_are_sorted_not_hashed(monkeypatch):
    """numpy's hash table is slow on hashes with cleared low bits; it is used where only the values are asked for."""
    def unique(values, **asked):
        assert asked, "a hash table"
        return plain(values, **asked)
    plain = np.unique
    words = " ".join(f"w{i % 700}" for i in range(3000))
    data, offsets = np.frombuffer((words + words).encode(), dtype=np.uint8), np.array([0, len(words), len(words), 2 * len(words)])
    monkeypatch.setattr(np, "unique", unique)
    scanner = lm.WordScanner(lm.SPACE_SEPARATORS, True)
    hashes, slices = lm._lot(data, offsets, scanner, 2, 12)
    assert len(slices) == 1 and (hashes[1:] > hashes[:-1]).all()
    grams = [lm._grams(*slices[0][2], n, 12) for n in (1, 2)]
    assert set(hashes.tolist()) == {h for found, whole in grams for h in found[whole].tolist()}
    assert distinct(np.zeros(0, dtype=np.uint64)).tolist() == [] and distinct(np.array([3, 1, 3])).tolist() == [1, 3]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A b"), (1, "A b"), (2, None), (None, ""), (4, "x " * 60_000)], "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS score", "2 AS word")
    texts = docs.where("doc_id = 1").select("text")
    counts = lm.word_counts(texts)
    rows = lm.score_texts(docs, lm.fit_model(texts, counts), counts, [F.col("doc_id"), F.col("row")]).collect()
    assert sorted((r.doc_id or 0, r.row, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [
        (0, 1, 1, 1, 6), (1, 1, 3, 3, 6), (1, 1, 3, 3, 6), (2, 1, 1, 1, 6), (4, 1, 60001, 1, 6)]
    nothing = texts.where("false")
    counts = lm.word_counts(nothing)
    rows = lm.score_texts(docs, lm.fit_model(nothing, counts), counts, [F.col("doc_id")]).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert lm.score_texts(docs.where("false"), lm.fit_model(nothing, counts), counts, [F.col("doc_id")]).count() == 0


def whole_levels(model, hashes):
    """Levels from the blocks."""
    rows = model.blocks.select("part", "bitmap").collect()
    out = np.zeros(len(hashes), dtype=np.int64)
    part = lm._part_of(hashes, len(model.bits))
    for r in rows:
        bitmap, at = np.frombuffer(r.bitmap, dtype=np.uint8), np.flatnonzero(part == r.part)
        out[at] = lm._read_levels(hashes[at], bitmap, np.zeros(len(at), dtype=np.int64), np.full(len(at), 8 * len(bitmap)))
    return out


def test_every_gram_is_kept(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_GRAMS", 200)
    text = " ".join(f"w{i}" for i in range(30_000))
    texts = spark.createDataFrame([(text + " again again again",)], "text string")
    model = lm.fit_model(texts, lm.word_counts(texts))
    scanner = lm.WordScanner(lm.SPACE_SEPARATORS, True)
    hashes = lm._distinct(*lm._sequences(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]), scanner), 2, model.spare)
    assert len(hashes) == 60_003 and (whole_levels(model, hashes) >= 1).sum() >= 60_002
    assert len(model.bits) > 256
    others = lm.mix64(np.arange(20_000, dtype=np.uint64))
    assert (whole_levels(model, others) > 0).mean() < 0.06
    word = lm._grams(*lm._sequences(np.frombuffer(b"again", dtype=np.uint8), np.array([0, 5]), scanner), 1, model.spare)[0][1:2]
    assert model.least == 2 and model.levels(word)[0] >= lm.level_of(np.array([3]))[0]


@pytest.mark.parametrize("batch,head_bits", [(10_000, lm.HEAD_BITS), (7, lm.HEAD_BITS), (10_000, 40_000), (10_000, 0)])
def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch, batch, head_bits):
    """Whatever the broadcast filter answers, levels are those of the blocks, but for false positives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(1, None), (None, ""), (2, "x " * 60_000)], "doc_id long, text string"))
    texts = docs.where("doc_id % 2 = 0").select("text")
    counts = lm.word_counts(texts)
    monkeypatch.setattr(lm, "HEAD_BITS", 0)
    monkeypatch.setattr(lm, "LOT_BYTES", 1 << 16)
    asked = lm.fit_model(texts, counts)
    assert asked.least > 20
    want = sorted((tuple(r) for r in lm.score_texts(docs, asked, counts, [F.col("doc_id")]).collect()), key=str)
    monkeypatch.setattr(lm, "HEAD_BITS", head_bits)
    model = lm.fit_model(texts, counts)
    assert model.least == (2 if head_bits > 40_000 else asked.least if not head_bits else model.least) and 2 <= model.least <= asked.least
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((tuple(r) for r in lm.score_texts(docs, model, counts, [F.col("doc_id")]).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == docs.count() and [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(g[-1] == pytest.approx(w[-1], rel=2e-3) for g, w in zip(got, want))

"""Repeated passages against a search of every window; the FM-index against scanning."""

import random

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from fiscalis.llm import substring_dedup as d  # noqa: E402
from fiscalis.llm.fm_index import FMIndex, WaveletMatrix  # noqa: E402


def brute(docs, window=13):
    least = {}
    words = [(key if key is not None else float("inf"), key, (t or "").encode().split()) for key, t in docs]
    for at, _, w in words:
        for i in range(len(w) - window + 1):
            run = tuple(w[i:i + window])
            least[run] = min(least.get(run, at), at)
    out = []
    for at, key, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < at:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "hot", "shard"), [(1 << 27, 20_000, 1_000_000), (1 << 12, 3, 500)])
def test_against_search(spark, monkeypatch, bits, hot, shard):
    monkeypatch.setattr(d, "FILTER_BITS", bits)
    monkeypatch.setattr(d, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    rng = random.Random(hot)
    vocabulary = ["the", "The", "of", "é", "x", "yy", "zzz.", "😀", "a\x00b", "q\xa0r"]
    passages = [rng.choices(vocabulary, k=rng.choice([5, 12, 13, 14, 30, 70])) for _ in range(8)]
    line = "this very common line of thirteen words or so stands in many documents".split()
    docs = []
    for i in range(150):
        words = [f"{rng.choice(vocabulary)}{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 20, 60]))]
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([*passages, line, line, line])
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(160, None), (161, ""), (162, " \n"), (163, "r " * 4000), (164, "r " * 4001), (None, docs[3][1]), (9, docs[4][1]), (9, docs[4][1]), (9, docs[100][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS mark", "2 AS windows", "3 AS kept")
    got = sorted((tuple(r) for r in d.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 0


def test_empty_table(spark):
    assert d.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wavelet_rank():
    rng = np.random.RandomState(1)
    for symbols, n in ((1, 5), (2, 64), (3, 130), (100, 1000)):
        values = rng.randint(0, symbols, n)
        matrix = WaveletMatrix(values.astype(np.int64), symbols)
        symbol, at = rng.randint(0, symbols, 200), rng.randint(0, n + 1, 200)
        assert matrix.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbol, at)]


def test_backward_search_counts():
    rng = np.random.RandomState(2)
    texts = [rng.randint(1, 4, rng.randint(13, 25)).tolist() for _ in range(60)]
    ids = np.array([x for t in texts for x in [*t, 0]])
    ends = np.flatnonzero(ids == 0)
    starts = np.r_[0, ends[:-1] + 1]
    index = FMIndex(ids, 4)
    plain = ids.tolist()
    for which, at, low, high in index.intervals(starts, ends, ids, 8):
        for w, a, lo, hi in zip(which.tolist(), at.tolist(), low.tolist(), high.tolist()):
            pattern = texts[w][a:]
            assert hi - lo == sum(plain[i:i + len(pattern)] == pattern for i in range(len(plain)))


def test_python_gets_batches_of_bounded_size(spark):
    from fiscalis.llm.substring_dedup import remove_repeats
    from fiscalis.session import BATCH_CONF, BATCH_ROWS

    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    spark.conf.unset(BATCH_CONF)
    try:
        rows = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
        assert rows == {1: 0, 2: 20} and int(spark.conf.get(BATCH_CONF)) == BATCH_ROWS
    finally:
        spark.conf.unset(BATCH_CONF)

"""Near-duplicate components against all pairs in Python."""

import random

import pytest

pytest.importorskip("fiscalis.llm")

from fiscalis.llm import minhash_dedup as m  # noqa: E402
from fiscalis.llm.components import components  # noqa: E402


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n=4, percent=80):
    sets = [shingles(t, n) for _, t in docs]
    of = list(range(len(docs)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted((key, len(sets[i]), best[find(i)], best[find(i)] == key) for i, (key, _) in enumerate(docs))


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(12):
        body = rng.choices(vocabulary, k=rng.choice([3, 30, 90, 200]))
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, len(copy) // 30, len(copy) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(rng.choice([" ", "\n", "  "]).join(copy).title())
    chain = rng.choices(vocabulary, k=300)  # each like the next, the ends unlike
    for i in range(12):
        docs.append(" ".join(chain[i * 12:i * 12 + 130]))
    docs += [None, "", " \n", "One two", "one TWO", "one two three", "É é", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("cell", [1024, 4])
def test_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(m, "CELL", cell)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0 if cell == 4 else m.BROADCAST_ROWS)
    docs = corpus(random.Random(cell))
    docs += [(3, docs[3][1]), (5, docs[9][1]), (5, "rows of one id with another text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS bands", "0 AS rep", "1 AS kept")
    got = sorted(tuple(r) for r in m.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(docs)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(empty).count() == 0
    no_id = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in m.near_duplicates(no_id).collect()) == [(0, 0, True), (0, 4, False), (4, 4, True)]


def test_sketch_bound():
    import numpy as np
    rng = np.random.RandomState(3)
    for size in (5, 60, 500, 5000, 40_000):
        for similarity, low, high in ((0.8, 0, 0), (0.5, 0.99 if size >= 60 else 0, 1)):
            over = 0
            for _ in range(60):
                union = np.sort(m.mix64(rng.randint(0, 2 ** 62, size).astype(np.uint64)))
                common = int(np.ceil(size * similarity))
                mark = rng.permutation(size)
                x, y = union[np.sort(mark[:(common + size) // 2])], union[np.sort(np.r_[mark[:common], mark[(common + size) // 2:]])]
                odd = np.bitwise_count(m._odd_sketch(x).view(np.uint64) ^ m._odd_sketch(y).view(np.uint64)).sum()
                over += odd > m.most_odd(float(len(x)), float(len(y)), 0.8, np.exp, np.sqrt)
            assert low <= over / 60 <= high


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    of = {x: x for e in edges if None not in e for x in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                of[a] = of[b] = min(of[a], of[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: v for x, v in of.items() if x in got} and set(of) - set(got) <= {5} | {a for a, b in edges if a == b}


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_links_of_rows_without_id(spark, monkeypatch, rows):
    monkeypatch.setattr(m, "BROADCAST_ROWS", rows)
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[i * 12:i * 12 + 130]) for i in range(6)]  # each like the next, the ends unlike
    docs = [(None if i in (1, 2, 4) else i, t) for i, t in enumerate(chain)] + [(None, chain[1]), (9, "another text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in m.near_duplicates(df).collect())
    assert got == sorted([("0", 0, True), ("3", 0, False), ("5", 0, False), ("9", 9, True)] + [("None", 0, False)] * 4)

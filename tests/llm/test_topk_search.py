import math

import numpy as np
import pytest

from fiscalis.llm import topk_search as tk

SCHEMA = "vec_id bigint, embedding array<double>, label int, row bigint, norm string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, every=50, k=5):
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((at, i, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, q in whole:
        if i is None or i % every:
            continue
        scored = [(-max(-tk.LONG, min(tk.LONG, sum(a * b for a, b in zip(q, v)))), j is None, j or 0) for other, j, v in whole if other != at and len(v) == len(q)]
        out += [(i, rank, None if unnamed else j, -s) for rank, (s, unnamed, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in tk.top_products(table(spark, rows), **more).collect()), key=str)


def vectors(n, dims=16, seed=3, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.3, 1.5], (n, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.lognormal(0, 1.5, (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("lengths", [False, True])
def test_equals_all_products(spark, monkeypatch, lengths):
    for name, value in {"BUCKET": 64, "SEEDS": 40, "LEAST_GROUP": 100, "QUERIES_A_GROUP": 7}.items():
        monkeypatch.setattr(tk, name, value)
    rows = vectors(900, lengths=lengths)
    assert found(spark, rows, every=20) == plain(rows, every=20)


def test_both_prunings_skip_rows_and_lose_none(monkeypatch):
    rng = np.random.default_rng(5)
    seen = {"length": 0, "coordinate": 0}

    def cell(rows, bounds):
        x = np.floor(np.array(rows) * 256)
        norm = np.linalg.norm(x, axis=1)
        order = np.argsort(-norm, kind="stable")
        n, q = len(x), 20
        ask = np.r_[np.zeros(n, bool), np.ones(q, bool)]
        at = np.r_[order, order[:q]]
        packed = np.array([x[i].astype(np.int16).tobytes() for i in at], dtype=object)
        return x, tk._Cell({"ask": ask, "dims": np.full(n + q, x.shape[1]), "row": at, "id": at, "named": np.ones(n + q, bool), "norm": norm[at],
                            "bound": np.r_[np.zeros(n), bounds(x, order[:q])], "vector": packed}, 3)
    monkeypatch.setattr(tk, "BUCKET", 50)
    old = tk._Cell._products

    def counted(self, queries, rows):
        seen["pairs"] = seen.get("pairs", 0) + len(queries) * len(rows)
        return old(self, queries, rows)
    monkeypatch.setattr(tk._Cell, "_products", counted)
    for name, scale in (("length", rng.lognormal(0, 1, (600, 1))), ("coordinate", np.ones((600, 1)))):
        base = rng.normal(size=(600, 8))
        base = np.repeat(base[:60], 10, axis=0) + rng.normal(size=(600, 8)) * 0.02 if name == "coordinate" else base
        rows = base / np.linalg.norm(base, axis=1, keepdims=True) * scale
        third = lambda x, some: np.sort(x[some] @ x.T - 1e18 * np.eye(len(x))[some], axis=1)[:, -3]
        seen["pairs"] = 0
        x, c = cell(rows, third)
        c.search()
        seen[name] = seen["pairs"]
        for i, query in enumerate(c.q_row):
            scores = x[query] @ x.T
            want = sorted((-int(s), j) for j, s in enumerate(scores) if j != query)[:3]
            assert [(h[0], h[2]) for h in c.best[i]] == want
    assert seen["length"] < 20 * 600 * 0.7 and seen["coordinate"] < 20 * 600 * 0.5


def test_ties_copies_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(tk, "BUCKET", 16)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(200)] + [(i, [0.1 * (i % 3), 1.0, 2.0]) for i in range(200, 260)]
    assert found(spark, rows) == plain(rows)


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [3.0, -2.0]), (None, [3.0, 2.0]),
            (100, [0.0, 0.0]), (150, []), (200, []), (250, [1.0]), (300, [1e300, 1.0]), (-50, [-1.0, 0.001]), (7, [1e200, 1e200]), (8, [4e9, -3e9]), (350, [5e9, 1e9])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == []
    assert found(spark, [(0, [1e308])]) == []

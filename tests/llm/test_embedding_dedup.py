"""Vector links and components against all pairs in numpy."""

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from fiscalis.llm import embedding_dedup as e  # noqa: E402


def brute(rows, threshold=0.9):
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = [[] for _ in rows]
    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if fit(x) and fit(y) and len(x) == len(y):
                a, b = np.float32(x).astype(float), np.float32(y).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i, (key, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], key), key)
    return sorted((key, len(near[i]), least[label[i]], least[label[i]] == key) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(e, "CELL", cell)
    rng = np.random.RandomState(cell)
    rows = []
    for _ in range(20):
        centre = rng.standard_normal(32)
        for _ in range(rng.choice([1, 2, 30])):
            rows.append((centre + rng.choice([0, 0.1, 0.2]) * rng.standard_normal(32)) * rng.choice([1, 1e-20, 1e18]))
    rows = [r.astype(np.float32).tolist() for r in rows]
    walk = rng.standard_normal(32)
    for _ in range(15):  # a chain whose ends are far apart
        walk = walk / np.linalg.norm(walk) + 0.055 * rng.standard_normal(32)
        rows.append(walk.astype(np.float32).tolist())
    rows += [None, [], [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf"), *[1.0] * 31], [1.0, 0.0], [2.0, 0.0], rows[0], rows[0]]
    rows = [(i, r) for i, r in enumerate(rows)] + [(4, rows[4]), (9, rows[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS valid", "3 AS label")
    got = sorted(tuple(r) for r in e.similar_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())
    want = brute(rows)
    links = sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.995 * links
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert got == want


def test_empty_and_plan(spark):
    assert e.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert e.plan(10 ** 4, 0.9)[0] < e.plan(10 ** 8, 0.9)[0]
    assert 0.75 < e.same_hash(2 ** 0.5 * 0.1 ** 0.5) < 0.85

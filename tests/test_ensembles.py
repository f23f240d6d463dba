"""Tree ensembles against plain versions that look at every row and every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalis.operators import ensembles as en
from fiscalis.operators import learning as le
from fiscalis.operators.histogram_trees import BINS, Rules, fixed_scale, integers, poisson_weights

NUMERIC, FLAGS = ["a", "b", "c"], ["f"]


def table(spark, n=400, regions=("x", "y")):
    rng = np.random.default_rng(7)
    rows = []
    for region in regions:
        for i in range(n):
            a, b, c = rng.normal(), float(rng.integers(0, 5)), rng.exponential()
            f = float(rng.random() < 0.3)
            rows.append((region, len(rows), a, b, c, f, 3 * a + (b > 2) * 10 + c * f + rng.normal()))
    return spark.createDataFrame(rows, "ccaa_slug string, number bigint, a double, b double, c double, f double, y double").repartition(3)


def arrays(df, region):
    part = df.where(F.col("ccaa_slug") == region).orderBy("number").toPandas()
    return part[NUMERIC + FLAGS].to_numpy(), part["y"].to_numpy(), part["number"].to_numpy()


def plain_bins(x):
    """Bin numbers from exact quantiles: the bin of a value is its share of smaller values."""
    out, edges = np.zeros(x.shape, dtype=int), []
    for j in range(x.shape[1]):
        if j == 3:
            edge = np.array([0.5])
        else:
            values = np.sort(x[:, j])
            bins = (np.searchsorted(values, values, side="left") * BINS) // len(values)
            edge = np.array([values[bins == b].max() for b in np.unique(bins)])[:-1]
        out[:, j] = [(edge < v).sum() for v in x[:, j]]
        edges.append(edge)
    return out, edges


def plain_cut(bins, g, w, rules):
    """The best cut of some rows by trying all, or None."""
    best = None
    n, total = w.sum(), (w * g).sum()
    for j in range(bins.shape[1]):
        for b in range(BINS):
            left = bins[:, j] <= b
            nl, nr, gl = w[left].sum(), w[~left].sum(), (w * g)[left].sum()
            if min(nl, nr) < max(rules.least_rows, 1):
                continue
            gain = gl ** 2 / (nl + rules.penalty) + (total - gl) ** 2 / (nr + rules.penalty) - total ** 2 / (n + rules.penalty)
            if gain > 1e-9 * (1 + total ** 2 / n) and (best is None or gain > best[0]):
                best = (gain, j, b)
    return best


def plain_tree(bins, g, w, rules):
    """The value of each row's leaf."""
    out = np.zeros(len(g))
    groups = [(np.arange(len(g)), 0)]
    cuts = [plain_cut(bins, g, w, rules)]
    while True:
        able = [i for i, (rows, depth) in enumerate(groups) if cuts[i] and (rules.depth is None or depth < rules.depth)]
        if not able or (rules.leaves and len(groups) >= rules.leaves):
            break
        i = max(able, key=lambda k: cuts[k][0]) if rules.leaves else able[0]
        (rows, depth), (_, j, b) = groups.pop(i), cuts.pop(i)
        for part in (rows[bins[rows, j] <= b], rows[bins[rows, j] > b]):
            groups.append((part, depth + 1))
            cuts.append(plain_cut(bins[part], g[part], w[part], rules))
    for rows, _ in groups:
        out[rows] = (w[rows] * g[rows]).sum() / max(w[rows].sum() + rules.penalty, 1e-300)
    return out


def plain_ensemble(x, y, numbers, rules):
    bins, _ = plain_bins(x)
    scale = fixed_scale(len(y), float(np.abs(y).max()))
    margin = np.full(len(y), float(np.float32(y.mean())) if rules.boosted else 0.0)
    total = np.zeros(len(y))
    for t in range(rules.trees):
        if rules.boosted:
            margin = margin + rules.rate * plain_tree(bins, integers(y - margin, scale) / scale, np.ones(len(y)), rules)
        else:
            total += plain_tree(bins, integers(y, scale) / scale, poisson_weights(numbers, t, rules.seed).astype(float), rules)
    return margin if rules.boosted else total / rules.trees


RULES = {
    "boosting": Rules(trees=5, rate=0.3, depth=3),
    "second order": Rules(trees=4, rate=0.3, depth=3, penalty=1.0),
    "leaf wise": Rules(trees=3, rate=0.3, depth=None, leaves=9, least_rows=20),
    "forest": Rules(trees=3, rate=0.0, depth=4),
    "forest without limit": Rules(trees=2, rate=0.0, depth=None),
}


@pytest.mark.parametrize("name", RULES)
def test_equals_a_plain_ensemble(spark, name):
    rules, df = RULES[name], table(spark, 120)
    model = en.fit_trees(df, rules, NUMERIC, FLAGS, F.col("y"))
    got = {r.number: r.forecast for r in en.forecast_trees(df, model, NUMERIC, FLAGS).collect()}
    for region in "xy":
        x, y, numbers = arrays(df, region)
        want = plain_ensemble(x, y, numbers, rules)
        assert np.allclose([got[n] for n in numbers], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rules", [Rules(trees=10, rate=0.2, depth=3, penalty=1.0), Rules(trees=3, rate=0.2, depth=None, leaves=7, least_rows=10),
                                   Rules(trees=18, rate=0.0, depth=3)])
def test_rows_over_many_tasks_give_the_same_trees(spark, rules):
    df = table(spark, 150)
    whole = en.fit_trees(df, rules, NUMERIC, FLAGS, F.col("y"))
    spread = en.fit_trees(df.repartition(5, "number"), rules, NUMERIC, FLAGS, F.col("y"), whole_rows=0)
    key = ["ccaa_slug", "tree", "node"]
    assert whole.orderBy(*key).collect() == spread.orderBy(*key).collect()


def test_leaves_and_rows_are_bounded(spark):
    model = en.fit_trees(table(spark), RULES["leaf wise"], NUMERIC, FLAGS, F.col("y"))
    leaves = model.where("tree >= 0 AND left_node = 0").groupBy("ccaa_slug", "tree").agg(F.count("node").alias("n"), F.min("n_rows").alias("least")).collect()
    assert all(r.n <= 9 and r.least >= 20 for r in leaves) and max(r.n for r in leaves) == 9


def test_importances_find_the_column(spark):
    model = en.fit_trees(table(spark), RULES["boosting"], NUMERIC, FLAGS, F.col("y"))
    got = en.importances(model, ["A", "B", "C", "F"], 2).where("ccaa_slug = 'x'").orderBy(F.desc("importancia")).collect()
    assert {r.variable for r in got} == {"A", "B"} and all(0 < r.importancia <= 1 for r in got)


def test_empty_and_constant_tables(spark):
    empty = table(spark, 10).limit(0)
    model = en.fit_trees(empty, RULES["forest"], NUMERIC, FLAGS, F.col("y"))
    assert model.isEmpty() and en.forecast_trees(empty, model, NUMERIC, FLAGS).isEmpty()
    flat = table(spark, 20).withColumn("y", F.lit(4.0))
    for rules in (RULES["boosting"], RULES["forest"]):
        got = en.forecast_trees(flat, en.fit_trees(flat, rules, NUMERIC, FLAGS, F.col("y")), NUMERIC, FLAGS)
        assert {round(r.forecast, 9) for r in got.collect()} == {4.0}


def test_registered_ensembles_are_whole():
    assert [r.trees for r in (le.FOREST, le.SHALLOW_FOREST, le.BOOSTING, le.SECOND_ORDER)] == [300] * 4
    assert (le.FOREST.depth, le.SHALLOW_FOREST.depth, le.LEAF_WISE.leaves) == (6, 5, 63)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiscalis.operators import ranking as rk
from fiscalis.operators import stats as sa


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 600
    group = np.where(rng.random(n) < 0.7, "hot", "cold")
    value = np.round(np.where(rng.random(n) < 0.3, 5.0, rng.normal(0, 1e4, n)), 1)
    pdf = pd.DataFrame({"g": group, "value": value, "capitulo_id": rng.integers(1, 8, n)})
    return pdf, spark.createDataFrame(pdf).repartition(5).withColumn("capitulo_id", F.col("capitulo_id").cast("int"))


def test_slots_keep_order(spark):
    values = sorted([0.0, -0.0, 1e-9, 0.3, 1.0, 1.0000001, 1e5, 1e11, -1e-9, -0.3, -1e5, -1e11])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rk.slot(F.col("v"))).collect()]
    assert got == sorted(got)


def test_quantiles_are_exact(sample):
    pdf, df = sample
    probs = {"a": 0.0, "b": 0.01, "c": 0.333, "d": 0.5, "e": 0.99, "f": 1.0}
    for r in rk.group_quantiles(df, ["g"], "value", probs).collect():
        known = pdf[pdf.g == r.g].value
        assert r.n == len(known) and [r[k] for k in probs] == pytest.approx([known.quantile(p) for p in probs.values()])
    whole = rk.group_quantiles(df, [], "value", {"m": 0.5}).first()
    assert whole.m == pytest.approx(pdf.value.median())


def test_mid_ranks(sample):
    pdf, df = sample
    got = {(r.g, r.value): r["rank"] for r in rk.mid_ranks(rk.value_counts(df, ["g"], "value"), ["g"]).collect()}
    known = pdf.groupby("g").value.rank()
    assert all(got[g, v] == pytest.approx(k) for g, v, k in zip(pdf.g, pdf.value, known))


def test_numbers_are_gapless_and_ordered(sample):
    pdf, df = sample
    rows = rk.numbered(df, {"g": F.col("g"), "_s": rk.slot(F.col("value"))}, ["value", "capitulo_id"], "k").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, len(pdf) + 1))
    assert [(r.g, r.value, r.capitulo_id) for r in rows] == sorted((r.g, r.value, r.capitulo_id) for r in rows)


def test_kruskal_and_levene(sample):
    pdf, df = sample
    ranks, n = pdf.value.rank(), len(pdf)
    sizes = pdf.groupby("capitulo_id").size()
    h = 12 / (n * (n + 1)) * (ranks.groupby(pdf.capitulo_id).sum() ** 2 / sizes).sum() - 3 * (n + 1)
    t = pdf.value.value_counts()
    assert sa.kruskal(df, []).first().h == pytest.approx(h / (1 - (t ** 3 - t).sum() / (n ** 3 - n)))
    z = (pdf.value - pdf.groupby("capitulo_id").value.transform("median")).abs()
    m = z.groupby(pdf.capitulo_id).transform("mean")
    k = len(sizes)
    w = (n - k) / (k - 1) * ((m - z.mean()) ** 2).sum() / ((z - m) ** 2).sum()
    assert sa.levene(df, []).first().w == pytest.approx(w)


def test_mann_whitney(sample):
    pdf, df = sample
    r = sa.mann_whitney_table(df.withColumn("ccaa_slug", F.lit("r")), ["ccaa_slug"]).first()
    a, b = pdf[pdf.capitulo_id <= 4].value.to_numpy(), pdf[pdf.capitulo_id.isin([6, 7])].value.to_numpy()
    assert r.u == (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    assert (r.mediana_corr, r.mediana_capital) == pytest.approx((np.median(a), np.median(b))) and 0 <= r.p <= 1


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x1 = rng.uniform(1e4, 1e6, 400)
    x2 = x1 * rng.uniform(0.9, 1.2, 400)
    y = 0.2 * x1 + 0.6 * x2 + rng.normal(0, 1, 400) * x1 * 0.05
    pdf = pd.DataFrame({"ccaa_slug": "r", "y": y, "x1": x1, "x2": x2})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def fit(x, y):
    x = np.column_stack([np.ones(len(y)), *x])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e, 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_regression_tests(regression):
    pdf, df = regression
    b, e, r2 = fit([pdf.x1, pdf.x2], pdf.y)
    got = sa.ols(df).first()
    assert [got.b0, got.b1, got.b2, got.r2] == pytest.approx([*b, r2], rel=1e-6)
    assert sa.breusch_pagan(df).first().lm == pytest.approx(400 * fit([pdf.x1, pdf.x2], e ** 2)[2], rel=1e-6)
    z1, z2 = [(c - c.mean()) / c.std() for c in (pdf.x1, pdf.x2)]
    white = sa.white(df).first()
    assert (white.k, white.lm) == (5, pytest.approx(400 * fit([z1, z2, z1 ** 2, z2 ** 2, z1 * z2], e ** 2)[2], rel=1e-6))


def test_scale_location_trend(regression):
    pdf, df = regression
    b, e, _ = fit([pdf.x1, pdf.x2], pdf.y)
    scale = pd.Series(np.sqrt(np.abs(e / (e.std(ddof=1) + 1e-9))))[np.argsort((pdf.y - e).to_numpy())].reset_index(drop=True)
    trend = scale.rolling(20, min_periods=5).mean()
    got = sa.scale_location(df).orderBy("orden").collect()
    assert [r.tendencia for r in got[:4]] == [None] * 4
    assert [r.tendencia for r in got[4:]] == pytest.approx(trend[4:].tolist(), rel=1e-6)


def test_spearman_and_normality(regression):
    pdf, df = regression
    pairs = df.select("ccaa_slug", F.round("x1", -4).alias("x"), F.col("y"))
    rho = pdf.x1.round(-4).rank().corr(pdf.y.rank())
    assert sa.spearman_table(pairs).first().rho == pytest.approx(rho)
    values = df.select(F.lit("v").alias("variable"), F.col("y").alias("value"))
    z = np.sort((pdf.y - pdf.y.mean()) / pdf.y.std(ddof=0))
    from math import erf, sqrt
    cdf = np.array([0.5 * (1 + erf(v / sqrt(2))) for v in z])
    i = np.arange(1, 401)
    assert sa.ks_distance(values, ["variable"]).first().ks == pytest.approx(max((i / 400 - cdf).max(), (cdf - (i - 1) / 400).max()))
    assert sa.normality_table(values, ["variable"]).first().normal_k2 in ("Sí", "No")


def test_crowded_slots_are_cut_further(spark, monkeypatch):
    """All values in one slot: the same ranks and running sums, over many parts."""
    rng = np.random.default_rng(5)
    value = np.round(1_001_000 + rng.uniform(0, 900, 700), 2)
    pdf = pd.DataFrame({"g": np.where(rng.random(700) < 0.8, "a", "b"), "value": np.r_[value[:-50], value[:50]], "w": rng.integers(1, 9, 700).astype(float)})
    df = spark.createDataFrame(pdf).repartition(4)
    parts = df.select(rk.slot(F.col("value")).alias("s"), rk.sub_slot(F.col("value")).alias("p")).distinct().collect()
    assert len({r.s for r in parts}) == 1 and len({r.p for r in parts}) > 300
    plain = {(r.g, r.value): r["rank"] for r in rk.mid_ranks(rk.value_counts(df, ["g"], "value"), ["g"]).collect()}
    monkeypatch.setattr(rk, "SLOT_ROWS", 20)
    cut = {(r.g, r.value): r["rank"] for r in rk.mid_ranks(rk.value_counts(df, ["g"], "value"), ["g"]).collect()}
    known = pdf.groupby("g").value.rank()
    assert cut == plain and all(cut[g, v] == k for g, v, k in zip(pdf.g, pdf.value, known))
    for r in rk.group_quantiles(df, ["g"], "value", {"q": 0.37}).collect():
        assert r.q == pytest.approx(pdf[pdf.g == r.g].value.quantile(0.37), rel=1e-12)
    got = {(r.g, r.value, r.w): r._run_w for r in rk.running_sums(df, ["g"], "value", ["w"], ["w"]).collect()}
    ordered = pdf.sort_values(["g", "value", "w"])
    run = ordered.assign(run=ordered.groupby("g").w.cumsum())
    assert all(got[r.g, r.value, r.w] == pytest.approx(r.run) for r in run.drop_duplicates(["g", "value", "w"], keep=False).itertuples())


def test_sub_slots_keep_order(spark):
    rng = np.random.default_rng(6)
    values = sorted([0.0, 1e-9, -1e-9, 2e-7, -2e-7, *rng.normal(0, 1e-4, 200), *rng.normal(0, 1e5, 200), *(1e9 + rng.uniform(0, 1e5, 200))])
    got = [tuple(r) for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(rk.slot(F.col("v")), rk.sub_slot(F.col("v"))).collect()]
    assert got == sorted(got)


def test_native_normal(spark):
    from math import erfc, sqrt
    from statistics import NormalDist

    from fiscalis.functions import tails
    z = [*np.linspace(-9, 9, 721).tolist(), 2.8284271, 20.0, 36.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(tails.normal_tail_native(F.col("z"))).collect()]
    want = [0.5 * erfc(v / sqrt(2)) for v in z]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-14
    assert all(abs(a - b) <= 1e-11 * b for a, b in zip(got, want))
    p = [1e-6, 1e-3, 0.02, 0.3, 0.5, 0.500001, 0.75, 0.999, 1 - 1e-6]
    found = tails.with_normal_quantile(spark.createDataFrame([(v,) for v in p], "p double"), "p", "q").collect()
    assert [r.q for r in found] == pytest.approx([NormalDist().inv_cdf(r.p) for r in found], abs=1e-10)


def test_exact_kolmogorov():
    from fiscalis.functions.tails import kolmogorov_exact, kolmogorov_tail
    assert kolmogorov_exact(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-12)
    for d in (0.55, 0.7, 0.93):
        assert kolmogorov_exact(d, 1) == pytest.approx(1 - (2 * d - 1)) and kolmogorov_exact(d, 2) == pytest.approx(2 * (1 - d) ** 2)
    for d in (0.3, 0.4, 0.49):
        assert kolmogorov_exact(d, 2) == pytest.approx(1 - 2 * (2 * d - 0.5) ** 2)
    assert kolmogorov_exact(0.0001, 50) == 1.0 and kolmogorov_exact(1.0, 5) == 0.0 and kolmogorov_exact(0.9, 400) < 1e-100
    for n, d in ((200, 0.05), (1000, 0.04), (100_000, 0.004)):
        assert kolmogorov_exact(d, n) == pytest.approx(kolmogorov_tail(d, n), abs=0.01)


def test_shapiro_wilk(spark):
    # A well-known table of 32 cars (miles a gallon): W = 0.94756, p = 0.1229.
    miles = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3,
             19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
    rng = np.random.default_rng(9)
    rows = [("cars", float(v)) for v in miles] + [("skewed", float(v)) for v in rng.exponential(1, 300)] + [("normal", float(v)) for v in rng.normal(5, 2, 6000)]
    rows += [("flat", 1.0)] * 30 + [("few", float(v)) for v in range(11)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    got = {r.k: r for r in sa.shapiro_wilk(df, ["k"], 12).collect()}
    assert set(got) == {"cars", "skewed", "normal"}
    assert got["cars"].shapiro == pytest.approx(0.94756, abs=5e-6) and got["cars"].p_shapiro == pytest.approx(0.1229, abs=5e-5)
    assert got["skewed"].p_shapiro < 1e-10 and got["normal"].p_shapiro > 0.001 and got["normal"].n_shapiro == 5000
    table = sa.normality_table(df, ["k"], 20)
    assert {r.k: r.normal_consenso for r in table.where("k IN ('cars', 'skewed')").collect()} == {"cars": "Sí", "skewed": "No"}
    plan = sa.ks_distance(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2

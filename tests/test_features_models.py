import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalis.operators import features as fe
from fiscalis.operators import learning as le
from fiscalis.operators import modeling as mo
from fiscalis.operators.linear import fit_linear, pairwise_correlations

FACT = ("ccaa_slug string, entidad_id string, anio int, trimestre int, capitulo_id int, grupo_funcional_id string, "
        "fase string, importe_eur double")


def facts(spark, rows):
    return spark.createDataFrame([("r", None, y, None, None, None, p, a) for y, p, a in rows], FACT)


def test_ratios(spark):
    rows = facts(spark, [(2020, "PRE", 1000.0), (2020, "CRE", 1100.0), (2020, "OBR", 400.0), (2020, "OBR", 500.0), (2020, "PAG", 450.0)])
    r = fe.build_features(rows).first()
    got = [r.brecha_eur, r.brecha_pct, r.ratio_cre_pre, round(r.ejecutado_pct, 6), r.pago_pct]
    assert got == [100.0, 0.1, 1.1, 0.818182, 0.5] and r.ARN is None
    none = fe.build_features(facts(spark, [(2020, "PRE", 0.0), (2020, "OBR", 1.0)])).first()
    assert none.brecha_pct is None and none.ejecutado_pct is None


def test_history_is_positional(spark):
    rows = facts(spark, [(2016, "OBR", 40.0), (2010, "OBR", 10.0), (2012, "OBR", 20.0)])
    got = fe.build_features(rows.orderBy(F.rand(3))).orderBy("anio").collect()
    assert [r.obr_lag_1 for r in got] == [None, 10.0, 20.0]
    assert [round(r.obr_rolling4_mean, 6) for r in got] == [10.0, 15.0, 23.333333]
    assert got[0].obr_rolling4_std is None and [round(r.obr_rolling4_std, 6) for r in got[1:]] == [7.071068, 15.275252]


def test_model_table_has_no_leak(spark):
    rows = [("r", None, 2020 + i, None, 1, None, "OBR", a) for i, a in enumerate([10.0, 20.0, 40.0, 80.0])]
    got = fe.build_model_table(fe.build_features(spark.createDataFrame(rows, FACT))).orderBy("anio").collect()
    assert [r.obr_roll3_mean and round(r.obr_roll3_mean, 6) for r in got] == [None, 10.0, 15.0, 23.333333]
    assert [r.split for r in got] == ["train", "train", "train", "test"] and got[0].PRE == 0.0


def test_splits_partition_the_rows(spark):
    df = spark.createDataFrame([("a", y) for y in (1, 2, 2, 5)] + [("b", 1)], "ccaa_slug string, anio int")
    train, test = fe.split_at(df, 2)
    assert train.count() + test.count() == df.count()
    marked = fe.split_last_years(df, 2).where("ccaa_slug = 'a'")
    assert sorted((r.anio, r.is_test) for r in marked.collect()) == [(1, False), (2, True), (2, True), (5, True)]
    assert {r.ccaa_slug for r in fe.split_final_year(df).collect()} == {"a"}


def test_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 0.0]), np.array([1.5, 2.0, 3.0, 1.0])
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)] + [("one", 1.0, 2.0)], "modelo string, OBR double, prediccion double")
    rows = {r.modelo: r for r in mo.metrics(df, ["modelo"]).collect()}
    assert rows["m"].mae == pytest.approx(np.abs(y - p).mean())
    assert rows["m"].r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert rows["m"].mape == pytest.approx(np.mean([0.5, 0, 0.25])) and rows["one"].r2 is None


def test_winner_is_first_on_ties(spark):
    rows = [("r", "ridge", 1.0), ("r", "baseline_cre", 1.0), ("s", "ridge", 1.0), ("s", "baseline_cre", 2.0)]
    df = spark.createDataFrame(rows, "ccaa_slug string, modelo string, mae double").withColumns({"mape": F.lit(0.0), "r2": F.lit(0.0)})
    assert {r.ccaa_slug: (r.modelo, r.bate_baseline) for r in mo.winners(df).collect()} == {"r": ("baseline_cre", "no"), "s": ("ridge", "sí")}


def test_prediction_rows(spark):
    rows = spark.createDataFrame([("r", None, 2000, 1, 10.0, "ridge", 8.0, "v1"), ("r", None, 2000, 2, 10.0, "ridge", 0.0, "v1")],
                                 "ccaa_slug string, entidad_id string, anio int, capitulo_id int, OBR double, modelo string, prediccion double, modelo_version string")
    best = spark.createDataFrame([("r", "ridge", 1.0, 0.1)], "ccaa_slug string, modelo string, mae double, mape double")
    table = mo.with_prediction_ids(mo.prediction_table(rows, best))
    got = {r.capitulo_id: (r.desviacion_rel, r.alerta) for r in table.collect()}
    assert got == {1: (0.25, "rojo"), 2: (None, "gris")} and sorted((r.pred_id, r.modelo_version) for r in table.collect()) == [(1, "v1"), (2, "v1")]


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) * [1e5, 3] + [2e5, 1]
    flag = (rng.random(200) < 0.3).astype(float)
    y = x @ [0.5, 100.0] + 7 * flag + rng.normal(size=200)
    df = spark.createDataFrame([("r", *map(float, (*a, f, t))) for a, f, t in zip(x, flag, y)], "k string, a double, b double, f double, y double").repartition(3)
    got = fit_linear(df, "k", ["a", "b"], ["f"], "y", 1.0).first()
    z = np.column_stack([(x - x.mean(0)) / x.std(0), flag])
    c = z - z.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))
    raw = w / np.append(x.std(0), 1)
    assert np.allclose(got.weights, raw, rtol=1e-6)
    assert got.intercept == pytest.approx(y.mean() - np.append(x.mean(0), flag.mean()) @ raw, rel=1e-6)


def test_pairwise_correlations(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 3))
    m[:, 1] += m[:, 0]
    m[rng.random((300, 3)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in m]
    got = {(r.x, r.y): r.r for r in pairwise_correlations(spark.createDataFrame(rows, "a double, b double, c double").repartition(3), ["a", "b", "c"]).collect()}
    for (i, a), (j, b) in [((1, "b"), (0, "a")), ((2, "c"), (0, "a")), ((2, "c"), (1, "b"))]:
        both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
        assert got[a, b] == pytest.approx(np.corrcoef(m[both, i], m[both, j])[0, 1], abs=1e-9)


def test_mllib_preparation(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a"), (4.0, "b")], "x double, g string")
    filled = le.fill_modes(df, ["g"])
    assert filled.where("g = 'a'").count() == 3
    out = Pipeline(stages=le.preparation_stages(["x"], ["g"])).fit(filled).transform(filled)
    assert out.select("features").first()[0].size >= 3


def test_tree_models(spark):
    rows = [("r", None, 1990 + i % 8, 1 + i % 9, float(10 + i % 9), i % 8 > 5, i, *[float(i % 9)] * 8) for i in range(80)]
    schema = ("ccaa_slug string, entidad_id string, anio int, capitulo_id int, OBR double, is_test boolean, number bigint, " + ", ".join(f"{c} double" for c in le.PREPARED))
    design = spark.createDataFrame(rows, schema).withColumns({f: (F.col("capitulo_id") == i + 1).cast("double") for i, f in enumerate(le.FLAGS)})
    model = le.fit_trees(design, le.Rules(trees=60, rate=0.2, depth=3), log=True)
    got = le.tree_predictions(design, model, "gradient_boosting", log=True).collect()
    assert len(got) == 20 and all(abs(r.prediccion - r.OBR) < 0.1 for r in got)
    assert le.importances(model, 3).count() <= 3


def test_winner_on_ties_and_unknown_names(spark):
    from fiscalis.operators.modeling import winners
    scores = spark.createDataFrame([("a", "linear", 1.0), ("a", "baseline_cre", 1.0), ("b", "own", 2.0), ("b", "linear", 2.0), ("c", "own", 1.0), ("c", "ridge", 3.0)],
                                   "ccaa_slug string, modelo string, mae double").selectExpr("*", "0.1D AS mape", "0.5D AS r2")
    assert {r.ccaa_slug: (r.modelo, r.bate_baseline) for r in winners(scores).collect()} == {
        "a": ("baseline_cre", "no"), "b": ("linear", "sí"), "c": ("own", "sí")}


def test_all_candidates_take_part(spark, monkeypatch):
    from fiscalis.plans import model_queries as mq
    asked = []
    monkeypatch.setattr(le, "fit_trees", lambda rows, rules, log=False: asked.append((rules.trees, log)))
    monkeypatch.setattr(le, "tree_predictions", lambda design, model, name, log=False:
                        le.linear_predictions(design, "ridge", 1.0, log=log).withColumn("modelo", F.lit(name)))
    found = mq.trained_predictions(spark, "/root/testdata/sf0.001")
    assert asked == [(300, True)] * 2
    assert {r.modelo for r in found.select("modelo").distinct().collect()} == {
        "baseline_lag1", "baseline_cre", "ridge", "random_forest", "gradient_boosting"}

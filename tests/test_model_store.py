"""Stored models: what is read back scores as what was trained."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalis.operators import learning as le
from fiscalis.operators import model_store as ms
from fiscalis.operators import modeling as mo


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for region in ("a", "b"):
        for i in range(120):
            credit = float(rng.uniform(1e3, 1e5)) if i % 10 else None
            budget = float(rng.uniform(1e3, 1e5)) if i % 20 else None
            spent = 0.8 * (credit or budget or 5e4) + float(rng.normal(0, 2e3)) + 1e4
            out.append((region, None, 2000 + i % 6, 1 + i % 9 if i % 7 else None, spent, i % 6 > 3, budget, credit, None if not budget else (credit or 0) / budget, *[spent * 0.9] * 4))
    names = ("ccaa_slug string, entidad_id string, anio int, capitulo_id int, OBR double, is_test boolean, PRE double, CRE double, ratio_cre_pre double, "
             "obr_lag_1 double, obr_lag_2 double, obr_lag_3 double, obr_lag_4 double")
    return spark.createDataFrame(out, names).repartition(3)


def test_credit_line(spark, rows, tmp_path):
    path, medians = str(tmp_path), mo.train_medians(rows)
    fit = le.fit_credit(rows, medians)
    ms.save_model(fit, path, "linear", "v7")
    weights = {(r.ccaa_slug, r.columna): r.peso for r in fit.collect()}
    pdf = rows.toPandas()
    for region, part in pdf.groupby("ccaa_slug"):
        train = part[~part.is_test]
        x = train.CRE.fillna(train.PRE).fillna(train.OBR.median()).to_numpy()
        slope, base = np.polyfit(x, train.OBR, 1)
        assert weights[region, "credito"] == pytest.approx(slope) and weights[region, ""] == pytest.approx(base)
    missing = spark.createDataFrame([(r, weights[r, "credito_ausente"]) for r in "ab"], "ccaa_slug string, credito_ausente double")
    found = ms.score_linear(le.with_credit(rows.join(missing, "ccaa_slug")), path, "linear", ["credito"]).collect()
    assert len(found) == 240 and {(r.modelo, r.modelo_version) for r in found} == {("linear", "v7")}
    assert all(r.prediccion == pytest.approx(weights[r.ccaa_slug, ""] + weights[r.ccaa_slug, "credito"] * r.credito) for r in found)


def test_a_region_without_spread_gets_its_mean(spark):
    flat = spark.createDataFrame([("a", 5.0, 5.0, False, 1.0 * i) for i in range(4)], "ccaa_slug string, CRE double, PRE double, is_test boolean, OBR double")
    got = {r.columna: r.peso for r in le.fit_credit(flat, mo.train_medians(flat)).collect()}
    assert got == {"": 1.5, "credito": 0.0, "credito_ausente": 1.5}


def test_stored_trees_and_preparation(spark, rows, tmp_path):
    path, rules = str(tmp_path), le.Rules(trees=8, rate=0.3, depth=3, penalty=1.0)
    ms.save_preparation(le.fit_preparation(rows.where("NOT is_test")), path)
    stored = le.apply_preparation(rows, ms.read_preparation(spark, path)).withColumn("number", F.monotonically_increasing_id()).cache()
    direct = le.prepare(rows)
    key = ["ccaa_slug", "anio", "OBR"]
    assert sorted(stored.drop("number").collect(), key=str) == sorted(direct.collect(), key=str)
    model = le.fit_trees(stored, rules, log=True)
    want = {tuple(r[k] for k in key): r.prediccion for r in le.tree_predictions(stored, model, "gradient_boosting", log=True).collect()}
    ms.save_model(model, path, "gradient_boosting", "v8", log=True)
    ms.save_model(le.fit_trees(stored, le.Rules(trees=2, rate=0.0, depth=2)), path, "random_forest", "v9")
    got = ms.score_trees(stored.where("is_test"), path, "gradient_boosting", le.PREPARED, le.FLAGS).collect()
    assert len(got) == len(want) and all(r.prediccion == want[tuple(r[k] for k in key)] and r.modelo_version == "v8" for r in got)
    ms.save_model(model.where("ccaa_slug = 'a'"), path, "gradient_boosting", "v10", log=True)  # replaced as a whole
    got = ms.score_trees(stored, path, "gradient_boosting", le.PREPARED, le.FLAGS).collect()
    assert {(r.ccaa_slug, r.modelo_version) for r in got} == {("a", "v10")}
    stored.unpersist()


@pytest.mark.parametrize("alpha,log", [(0.0, False), (1.0, False), (1.0, True)])
def test_normal_equations_hold_and_can_fail(spark, rows, alpha, log):
    design = le.prepare(rows).cache()
    left = le.linear_equations(design, alpha, log).collect()
    assert len(left) == 2 * (1 + len(le.PREPARED) + len(le.FLAGS)) and max(abs(r.residuo) for r in left) < 1e-8
    train = design.where(~F.col("is_test")).withColumn("_target", le.target(log))
    fit = le.fit_linear(train, "ccaa_slug", le.PREPARED, le.FLAGS, "_target", alpha + 5)
    other = le.normal_equations(train, fit, "ccaa_slug", le.PREPARED, le.FLAGS, "_target", alpha).collect()
    assert max(abs(r.residuo) for r in other) > 1e-4
    design.unpersist()


def test_standardised(spark, rows):
    got = le.standardise(le.prepare(rows)).toPandas()
    for _, part in got[~got.is_test].groupby("ccaa_slug"):
        for c in ("PRE", "CRE", "obr_lag_1"):
            assert part[f"z_{c}"].mean() == pytest.approx(0, abs=1e-9) and part[f"z_{c}"].std(ddof=0) == pytest.approx(1)

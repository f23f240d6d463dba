"""Modelling queries (MOD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis.functions.amounts import alert_by_band, alert_by_limit
from fiscalis.operators import learning as le
from fiscalis.operators import model_store as ms
from fiscalis.operators import modeling as mo
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.feature_queries import features, model_table, stored_features
from fiscalis.plans.registry import query
from fiscalis.session import cut, scratch_path

CTES["native"] = """
SELECT *, dense_rank() OVER (PARTITION BY ccaa_slug ORDER BY anio DESC) <= 2 AS is_test
FROM clean_feat WHERE OBR > 0"""
CTES["gates"] = """
SELECT *, CASE WHEN n_train < 20 OR n_test < 5 THEN 'datos insuficientes' END AS nota FROM (
  SELECT ccaa_slug, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test
  FROM native GROUP BY ccaa_slug)"""
CTES["base_pred"] = """
SELECT n.*, coalesce(obr_lag_1, CRE, PRE, m) AS baseline_lag1, coalesce(CRE, PRE, m) AS baseline_cre
FROM native n JOIN gates g USING (ccaa_slug)
JOIN (SELECT ccaa_slug, quantile_cont(OBR, 0.5) AS m FROM native WHERE NOT is_test GROUP BY ccaa_slug) USING (ccaa_slug)
WHERE is_test AND nota IS NULL"""
CTES["credit_fit"] = """
SELECT ccaa_slug, coalesce(regr_intercept(OBR, x), avg(OBR)) AS a, coalesce(regr_slope(OBR, x), 0) AS b FROM (
  SELECT n.ccaa_slug, OBR, coalesce(CRE, PRE, m) AS x FROM native n JOIN gates g USING (ccaa_slug)
  JOIN (SELECT ccaa_slug, quantile_cont(OBR, 0.5) AS m FROM native WHERE NOT is_test GROUP BY ccaa_slug) USING (ccaa_slug)
  WHERE NOT is_test AND nota IS NULL) GROUP BY ccaa_slug"""
CTES["pred_long"] = """
SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, 'baseline_lag1' AS modelo, 1 AS k, baseline_lag1 AS prediccion, 'baseline' AS modelo_version
FROM base_pred UNION ALL
SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, 'baseline_cre', 2, baseline_cre, 'baseline' FROM base_pred UNION ALL
SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, 'linear', 3, a + b * baseline_cre, '3b-native' FROM base_pred JOIN credit_fit USING (ccaa_slug)"""
METRICS = """count(*) AS n, avg(abs(OBR - prediccion)) AS mae, sqrt(avg((OBR - prediccion) ** 2)) AS rmse,
  avg(abs(OBR - prediccion) / abs(OBR)) FILTER (abs(OBR) >= 1e-6) AS mape,
  CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(OBR) > 0
    THEN 1 - sum((OBR - prediccion) ** 2) / (var_pop(OBR) * count(*))
    WHEN sum((OBR - prediccion) ** 2) = 0 THEN 1 ELSE 0 END AS r2"""
CTES["scores"] = f"SELECT ccaa_slug, modelo, k, {METRICS} FROM pred_long GROUP BY ccaa_slug, modelo, k"
CTES["winner"] = """
SELECT * EXCLUDE (w) FROM (SELECT *, row_number() OVER (PARTITION BY ccaa_slug ORDER BY mae, k) AS w FROM scores)
WHERE w = 1"""
CTES["deviations"] = """
SELECT p.*, s.mae, s.mape, CASE WHEN abs(prediccion) > 1e-6 THEN (OBR - prediccion) / prediccion END AS dev
FROM pred_long p JOIN winner s USING (ccaa_slug, modelo)"""
CTES["pred"] = """
SELECT ccaa_slug, entidad_id, anio, capitulo_id, modelo, modelo_version,
  prediccion AS importe_predicho, OBR AS importe_real, mae, mape, dev AS desviacion_rel,
  CASE WHEN dev IS NULL THEN 'gris' WHEN abs(dev) < 0.05 THEN 'verde' WHEN abs(dev) < 0.15 THEN 'amarillo'
    ELSE 'rojo' END AS alerta
FROM deviations"""


def native(spark, sf):
    """(rows, plan): modelling rows and the plan of every region."""
    rows = mo.native_rows(stored_features(spark, sf))
    return rows, mo.region_plan(rows)


def split_rows(spark, sf):
    return mo.native_split(*native(spark, sf))


def native_predictions(rows):
    """Test rows with the forecasts of both baselines."""
    return mo.long_predictions(mo.native_baselines(rows), mo.BASELINES).withColumn("modelo_version", F.lit(mo.BASELINE_VERSION))


def stored_line(spark, rows) -> str:
    """The folder of a model store with the credit line of every region, fitted on the train rows."""
    path = scratch_path(spark, "models")
    ms.save_model(le.fit_credit(rows, mo.train_medians(rows)), path, "linear", mo.NATIVE_VERSION)
    return path


def line_forecasts(spark, rows, path):
    """Rows with the forecast of the stored credit line."""
    weights = spark.read.schema(ms.WEIGHTS).parquet(f"{path}/weights/modelo=linear")
    missing = weights.where("columna = 'credito_ausente'").select("ccaa_slug", F.col("peso").alias("credito_ausente"))
    return ms.score_linear(le.with_credit(rows.join(missing, "ccaa_slug")), path, "linear", ["credito"])


def candidate_predictions(spark, sf):
    """Forecasts of the test rows: the baselines, and a trained line read back from its store."""
    rows = cut(spark, split_rows(spark, sf), "split")
    base = native_predictions(rows)
    line = line_forecasts(spark, rows.where("is_test"), stored_line(spark, rows))
    return cut(spark, base.unionByName(line.select(*base.columns)), "candidates")


def candidate_scores(spark, sf):
    return mo.metrics(candidate_predictions(spark, sf), ["ccaa_slug", "modelo"])


def winning_rows(rows):
    """The prediction table of each region's best candidate; `rows` is stored, as it is read twice."""
    return mo.prediction_table(rows, mo.winners(mo.metrics(rows, ["ccaa_slug", "modelo"])))


def predictions(spark, sf):
    return winning_rows(candidate_predictions(spark, sf))


def pretty(df, digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


ROW = "ccaa_slug, entidad_id, anio, capitulo_id, OBR"


@query("mod03_zero_fill", check("""
SELECT ccaa_slug, entidad_id, anio, trimestre, capitulo_id, grupo_funcional_id, coalesce(PRE, 0) AS PRE,
  coalesce(CRE, 0) AS CRE, coalesce(obr_lag_1, 0) AS obr_lag_1, coalesce(obr_lag_4, 0) AS obr_lag_4 FROM feat"""))
def mod03(spark, sf):
    from fiscalis.operators.features import GRAIN
    rows = features(spark, sf).select(*GRAIN, "PRE", "CRE", "obr_lag_1", "obr_lag_4")
    return rows.fillna(0.0, ["PRE", "CRE", "obr_lag_1", "obr_lag_4"])


@query("mod08_comparison_table", check("""
SELECT ccaa_slug, n_train, n_test, coalesce(modelo, '—') AS modelo, round(mae / 1e6, 1) AS mae_meur,
  round(mape, 3) AS mape, round(r2, 3) AS r2, nota FROM gates LEFT JOIN scores USING (ccaa_slug)"""))
def mod08(spark, sf):
    return mo.comparison_table(candidate_scores(spark, sf), native(spark, sf)[1])


@query("mod11_sample_gates", check("""
SELECT ccaa_slug, n_train, n_test, nota FROM gates"""))
def mod11(spark, sf):
    return native(spark, sf)[1].drop("first_test_year")


@query("mod12_persistence", check(f"SELECT {ROW}, round(baseline_lag1, 2) AS baseline_lag1 FROM base_pred"))
def mod12(spark, sf):
    out = mo.native_baselines(split_rows(spark, sf))
    return out.select(*ROW.split(", "), F.round("baseline_lag1", 2).alias("baseline_lag1"))


@query("mod13_credit", check(f"SELECT {ROW}, round(baseline_cre, 2) AS baseline_cre FROM base_pred"))
def mod13(spark, sf):
    out = mo.native_baselines(split_rows(spark, sf))
    return out.select(*ROW.split(", "), F.round("baseline_cre", 2).alias("baseline_cre"))


CTES["common"] = """
SELECT *, split = 'test' AS is_test FROM model_table WHERE OBR > 0 AND split IN ('train', 'test')"""


@query("mod14_common_baselines", check("""
SELECT ccaa_slug, anio, capitulo_id, OBR, coalesce(obr_lag_1, CRE, PRE) AS baseline_lag1,
  coalesce(CRE, PRE) AS baseline_cre FROM common WHERE is_test"""))
def mod14(spark, sf):
    rows = mo.baseline_columns(mo.common_split(model_table(spark, sf)), None)
    return rows.select("ccaa_slug", "anio", "capitulo_id", "OBR", "baseline_lag1", "baseline_cre")


@query("mod15_metrics", check("""
SELECT ccaa_slug, modelo, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 6) AS mape,
  round(r2, 6) AS r2 FROM scores"""))
def mod15(spark, sf):
    return pretty(candidate_scores(spark, sf), {"mae": 4, "rmse": 4, "mape": 6, "r2": 6})


@query("mod16_winner", check("""
SELECT ccaa_slug, modelo, round(mae, 4) AS mae, round(mape, 6) AS mape, round(r2, 6) AS r2,
  CASE WHEN k > 2 THEN 'sí' ELSE 'no' END AS bate_baseline FROM winner"""))
def mod16(spark, sf):
    return pretty(mo.winners(candidate_scores(spark, sf)), {"mae": 4, "mape": 6, "r2": 6})


@query("mod17_baseline_against_models", check("""
SELECT ccaa_slug, round(min(mae) FILTER (modelo LIKE 'baseline%') / 1e6, 1) AS mejor_baseline,
  round(min(mae) FILTER (modelo NOT LIKE 'baseline%') / 1e6, 1) AS mejor_ml FROM scores GROUP BY ccaa_slug"""))
def mod17(spark, sf):
    return mo.baseline_against_models(candidate_scores(spark, sf))


@query("mod18_mae_matrix", check("""
SELECT ccaa_slug, round(max(mae) FILTER (modelo = 'baseline_lag1') / 1e6, 1) AS baseline_lag1,
  round(max(mae) FILTER (modelo = 'baseline_cre') / 1e6, 1) AS baseline_cre,
  round(max(mae) FILTER (modelo = 'linear') / 1e6, 1) AS linear FROM scores GROUP BY ccaa_slug"""))
def mod18(spark, sf):
    return mo.mae_matrix(candidate_scores(spark, sf), [*mo.BASELINES, "linear"])


@query("mod19_share_beaten", check("""
SELECT count(*) FILTER (modelo NOT LIKE 'baseline%') AS n_ml, count(*) AS n_ccaa,
  count(*) FILTER (modelo NOT LIKE 'baseline%') / CAST(count(*) AS DOUBLE) AS cuota FROM winner"""))
def mod19(spark, sf):
    return mo.share_beaten(mo.winners(candidate_scores(spark, sf)))


CTES["scored_year"] = """
SELECT *, (OBR - prediccion) / nullif(prediccion, 0) AS dev FROM pred_long WHERE anio = 2000"""


@query("mod21_score_year", check("""
SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, modelo, modelo_version, round(prediccion, 2) AS prediccion,
  round(dev, 6) AS desviacion_rel, CASE WHEN abs(dev) <= 0.05 THEN 'verde' WHEN abs(dev) <= 0.15 THEN 'amarillo'
  WHEN abs(dev) > 0.15 THEN 'rojo' END AS alerta FROM scored_year"""))
def mod21(spark, sf):
    """Baselines, and a line that is written to a model store and read back."""
    return pretty(mo.score_year(candidate_predictions(spark, sf), 2000), {"prediccion": 2, "desviacion_rel": 6})


@query("mod22_alert_by_band", check("""
SELECT ccaa_slug, entidad_id, anio, capitulo_id, round(brecha_pct, 6) AS desviacion, CASE WHEN abs(brecha_pct) <= 0.05
  THEN 'verde' WHEN abs(brecha_pct) <= 0.15 THEN 'amarillo' WHEN abs(brecha_pct) > 0.15 THEN 'rojo' END AS alerta
FROM feat"""))
def mod22(spark, sf):
    return features(spark, sf).select(
        "ccaa_slug", "entidad_id", "anio", "capitulo_id", F.round("brecha_pct", 6).alias("desviacion"),
        alert_by_band(F.col("brecha_pct")).alias("alerta"))


@query("mod23_alert_by_limit", check("""
SELECT ccaa_slug, entidad_id, anio, capitulo_id, round(brecha_pct, 6) AS desviacion, CASE WHEN brecha_pct IS NULL
  THEN 'gris' WHEN abs(brecha_pct) < 0.05 THEN 'verde' WHEN abs(brecha_pct) < 0.15 THEN 'amarillo' ELSE 'rojo' END
  AS alerta FROM feat"""))
def mod23(spark, sf):
    return features(spark, sf).select(
        "ccaa_slug", "entidad_id", "anio", "capitulo_id", F.round("brecha_pct", 6).alias("desviacion"),
        alert_by_limit(F.col("brecha_pct")).alias("alerta"))


PRED_ROUND = {"importe_predicho": 2, "mae": 4, "mape": 6, "desviacion_rel": 6}


@query("mod24_prediction_table", check("""
SELECT ccaa_slug, entidad_id, anio, capitulo_id, modelo, modelo_version, round(importe_predicho, 2) AS importe_predicho,
  importe_real, round(mae, 4) AS mae, round(mape, 6) AS mape, round(desviacion_rel, 6) AS desviacion_rel, alerta
FROM pred"""))
def mod24(spark, sf):
    return pretty(predictions(spark, sf), PRED_ROUND)


@query("mod25_alert_distribution", check("SELECT alerta, count(*) AS n FROM pred GROUP BY alerta"))
def mod25(spark, sf):
    return predictions(spark, sf).groupBy("alerta").agg(F.count(F.lit(1)).alias("n"))


# --- learners ------------------------------------------------------------------

def design_view(spark, sf):
    return le.prepare(cut(spark, split_rows(spark, sf), "split"))


def design(spark, sf):
    """Prepared rows, written with a number each."""
    return cut(spark, design_view(spark, sf).withColumn("number", F.monotonically_increasing_id()), "design")


CTES["medians"] = "SELECT ccaa_slug, " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in le.NUMERIC) + """
FROM native JOIN gates USING (ccaa_slug) WHERE NOT is_test AND nota IS NULL GROUP BY ccaa_slug"""
CTES["modes"] = """
SELECT ccaa_slug, capitulo_id AS moda FROM (SELECT *, row_number() OVER (PARTITION BY ccaa_slug ORDER BY n DESC, capitulo_id) AS k
  FROM (SELECT ccaa_slug, capitulo_id, count(*) AS n FROM native WHERE NOT is_test AND capitulo_id IS NOT NULL
    GROUP BY ccaa_slug, capitulo_id)) WHERE k = 1"""


@query("mod01_numeric_preparation", check("SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, " + ", ".join(
    f"round(coalesce({c} - med_{c}, 0), 4) + 0.0::DOUBLE AS x_{c}" for c in le.NUMERIC) + " FROM native JOIN medians USING (ccaa_slug)"))
def mod01(spark, sf):
    out = design_view(spark, sf).select(*ROW.split(", "), *le.PREPARED)
    return pretty(out, {c: 4 for c in le.PREPARED})


@query("mod02_chapter_flags", check("SELECT n.ccaa_slug, entidad_id, anio, capitulo_id, OBR, " + ", ".join(
    f"CASE WHEN coalesce(capitulo_id, moda) = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for i, c in enumerate(le.FLAGS))
    + " FROM native n JOIN medians USING (ccaa_slug) LEFT JOIN modes USING (ccaa_slug)"))
def mod02(spark, sf):
    return design_view(spark, sf).select(*ROW.split(", "), *le.FLAGS)


@query("mod04_linear")
def mod04(spark, sf):
    rows = cut(spark, design_view(spark, sf), "design")
    return mo.metrics(le.linear_predictions(rows, "linear", 0.0), ["ccaa_slug", "modelo"])


@query("mod05_ridge")
def mod05(spark, sf):
    rows = cut(spark, design_view(spark, sf), "design")
    return mo.metrics(le.linear_predictions(rows, "ridge", 1.0), ["ccaa_slug", "modelo"])


def tree_scores(name: str, rules, model: str) -> None:
    """Register the test metrics of a tree ensemble of every region."""
    @query(name)
    def build(spark, sf):
        rows = design(spark, sf)
        return mo.metrics(le.tree_predictions(rows, le.fit_trees(rows, rules), model), ["ccaa_slug", "modelo"])


tree_scores("mod06_random_forest", le.FOREST, "random_forest")
tree_scores("mod06_shallow_forest", le.SHALLOW_FOREST, "random_forest")
tree_scores("mod07_gradient_boosting", le.BOOSTING, "gradient_boosting")
tree_scores("mod07_second_order", le.DEEP_SECOND_ORDER, "second_order")
tree_scores("mod07_leaf_wise", le.LEAF_WISE, "leaf_wise")


@query("mod09_log_target")
def mod09(spark, sf):
    rows = cut(spark, design_view(spark, sf), "design")
    return mo.metrics(le.linear_predictions(rows, "ridge", 1.0, log=True), ["ccaa_slug", "modelo"])


def trained_predictions(spark, sf):
    """Baselines, and ridge, forest and boosting with log target per region."""
    rows = cut(spark, split_rows(spark, sf), "split")
    prepared = cut(spark, le.prepare(rows).withColumn("number", F.monotonically_increasing_id()), "design")
    found, version = native_predictions(rows), F.lit(mo.LOG_VERSION).alias("modelo_version")
    kept = [c for c in found.columns if c != "modelo_version"]
    parts = [le.linear_predictions(prepared, "ridge", 1.0, log=True)]
    for name, rules in (("random_forest", le.FOREST), ("gradient_boosting", le.SECOND_ORDER)):
        parts.append(le.tree_predictions(prepared, le.fit_trees(prepared, rules, log=True), name, log=True))
    for part in parts:
        found = found.unionByName(part.select(*kept, version))
    return cut(spark, found, "candidates")


@query("mod10_regional_training")
def mod10(spark, sf):
    """Who wins among all candidates of each region."""
    return mo.winners(mo.metrics(trained_predictions(spark, sf), ["ccaa_slug", "modelo"]))


@query("mod20_importances")
def mod20(spark, sf):
    return le.importances(le.fit_trees(design(spark, sf), le.FOREST, log=True))


@query("mod24_trained_table")
def mod24_trained(spark, sf):
    """The prediction table with all trained models as candidates."""
    return winning_rows(trained_predictions(spark, sf))


@query("mod21_stored_trees")
def mod21_trees(spark, sf):
    """One year scored by a boosted model and its preparation, both read back from the model store."""
    path, rows = scratch_path(spark, "models"), cut(spark, split_rows(spark, sf), "split")
    ms.save_preparation(le.fit_preparation(rows.where("NOT is_test")), path)
    prepared = cut(spark, le.apply_preparation(rows, ms.read_preparation(spark, path)).withColumn("number", F.monotonically_increasing_id()), "design")
    ms.save_model(le.fit_trees(prepared, le.SECOND_ORDER, log=True), path, "gradient_boosting", mo.LOG_VERSION, log=True)
    found = ms.score_trees(prepared.where("anio = 2000"), path, "gradient_boosting", le.PREPARED, le.FLAGS)
    return mo.score_year(found.select(*ROW.split(", "), "modelo", "modelo_version", "prediccion"), 2000)


@query("mod11_common_gates", check("""
SELECT ccaa_slug, n_train, n_test, CASE WHEN n_train < 15 OR n_test < 5 THEN 'datos insuficientes' END AS nota FROM (
  SELECT ccaa_slug, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test FROM common GROUP BY ccaa_slug)"""))
def mod11_common(spark, sf):
    return mo.sample_gates(mo.common_split(model_table(spark, sf)))


CTES["shifted"] = "SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, is_test, " + ", ".join(
    f"coalesce({c} - med_{c}, 0) + 0.0::DOUBLE AS x_{c}" for c in le.NUMERIC) + " FROM native JOIN medians USING (ccaa_slug)"
CTES["spreads"] = "SELECT ccaa_slug, " + ", ".join(
    f"avg(x_{c}) AS m_{c}, CASE WHEN stddev_pop(x_{c}) > 1e-9 * (1 + abs(avg(x_{c}))) THEN stddev_pop(x_{c}) ELSE 1 END AS s_{c}"
    for c in le.NUMERIC) + " FROM shifted WHERE NOT is_test GROUP BY ccaa_slug"


@query("mod01_standardised", check("SELECT ccaa_slug, entidad_id, anio, capitulo_id, OBR, " + ", ".join(
    f"round((x_{c} - m_{c}) / s_{c}, 6) + 0.0::DOUBLE AS z_{c}" for c in le.NUMERIC) + " FROM shifted JOIN spreads USING (ccaa_slug)"))
def mod01_standardised(spark, sf):
    rows = le.standardise(cut(spark, design_view(spark, sf), "design"))
    return rows.select(*ROW.split(", "), *[(F.round(f"z_{c}", 6) + F.lit(0.0)).alias(f"z_{c}") for c in le.NUMERIC])


def equations(name: str, alpha: float, log: bool = False) -> None:
    """Register the check of a linear model: every normal equation of every region holds."""
    @query(name, check("SELECT ccaa_slug, columna, CAST(0.0 AS DOUBLE) AS residuo FROM (SELECT ccaa_slug FROM medians) CROSS JOIN (VALUES "
                       + ", ".join(f"('{c}')" for c in ("", *le.PREPARED, *le.FLAGS)) + ") AS t(columna)"))
    def build(spark, sf):
        found = le.linear_equations(cut(spark, design_view(spark, sf), "design"), alpha, log)
        return found.withColumn("residuo", F.round("residuo", 6) + F.lit(0.0))


equations("mod04_normal_equations", 0.0)
equations("mod05_normal_equations", 1.0)
equations("mod09_normal_equations", 1.0, log=True)

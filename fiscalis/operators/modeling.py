"""Per-region forecasts of year-end spending, baselines, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.functions.amounts import alert_by_band, alert_by_limit, ratio
from fiscalis.operators.features import valid_target
from fiscalis.operators.quality import plausible_features
from fiscalis.operators.ranking import group_medians, numbered, slot

MODEL_ORDER = ["baseline_lag1", "baseline_cre", "linear", "ridge", "random_forest", "gradient_boosting"]
# What a forecast's model is called in the prediction table: fitted to amounts, or to their logarithm.
BASELINE_VERSION, NATIVE_VERSION, LOG_VERSION = "baseline", "3b-native", "3c-log1p"
BASELINES = MODEL_ORDER[:2]
SHORT_DATA = "datos insuficientes"


# --- rows, gates, baselines --------------------------------------------------

def with_note(sizes: DataFrame, min_train: int, min_test: int) -> DataFrame:
    short = (F.col("n_train") < min_train) | (F.col("n_test") < min_test)
    return sizes.withColumn("nota", F.when(short, SHORT_DATA))


def region_plan(rows: DataFrame, test_years: int = 2, min_train: int = 20, min_test: int = 5) -> DataFrame:
    """Per region: where its last years start, how many rows train and test
    hold, and a note where they are too few. All of it comes from the counts
    per region and year."""
    newest = Window.partitionBy("ccaa_slug").orderBy(F.col("anio").desc())
    years = rows.groupBy("ccaa_slug", "anio").agg(F.count(F.lit(1)).alias("_n"))
    last = F.col("_k") <= test_years
    sizes = years.withColumn("_k", F.row_number().over(newest)).groupBy("ccaa_slug").agg(
        F.min(F.when(last, F.col("anio"))).alias("first_test_year"),
        F.coalesce(F.sum(F.when(~last, F.col("_n"))), F.lit(0)).alias("n_train"),
        F.sum(F.when(last, F.col("_n"))).alias("n_test"))
    return with_note(sizes, min_train, min_test)


def native_rows(features: DataFrame) -> DataFrame:
    """Plausible rows with a valid target."""
    return valid_target(plausible_features(features))


def native_split(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the regions with enough data, the last years marked as test."""
    kept = plan.where(F.col("nota").isNull()).select("ccaa_slug", "first_test_year")
    return rows.join(kept, "ccaa_slug").withColumn("is_test", F.col("anio") >= F.col("first_test_year")).drop("first_test_year")


def common_split(model_table: DataFrame) -> DataFrame:
    """Rows of the model table in train or test."""
    rows = valid_target(model_table).where(F.col("split").isin("train", "test"))
    return rows.withColumn("is_test", F.col("split") == "test")


def sample_gates(rows: DataFrame, min_train: int = 15, min_test: int = 5) -> DataFrame:
    """Sample sizes per region of rows that are split already."""
    sizes = rows.groupBy("ccaa_slug").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"))
    return with_note(sizes, min_train, min_test)


def baseline_columns(rows: DataFrame, medians: DataFrame | None) -> DataFrame:
    """Test rows with the persistence and the credit forecast. The train median
    is the last resort; without `medians` there is none."""
    test = rows.where(F.col("is_test"))
    last: list[Column] = []
    if medians is not None:
        test = test.join(medians.select("ccaa_slug", F.col("median").alias("_median")), "ccaa_slug", "left")
        last = [F.col("_median")]
    credit = [F.col("CRE"), F.col("PRE"), *last]
    out = test.withColumns({
        "baseline_lag1": F.coalesce(F.col("obr_lag_1"), *credit),
        "baseline_cre": F.coalesce(*credit),
    })
    return out.drop("_median")


def train_medians(rows: DataFrame) -> DataFrame:
    return group_medians(rows.where(~F.col("is_test")), ["ccaa_slug"], "OBR")


def native_baselines(rows: DataFrame) -> DataFrame:
    return baseline_columns(rows, train_medians(rows))


def long_predictions(wide: DataFrame, models: list[str]) -> DataFrame:
    """One row per test row and model."""
    keys = ["ccaa_slug", "entidad_id", "anio", "capitulo_id", "OBR"]
    present = [k for k in keys if k in wide.columns]
    return wide.select(*present, *models).unpivot(present, models, "modelo", "prediccion")


# --- metrics -------------------------------------------------------------------

def metrics(predictions: DataFrame, keys: list[str], real: str = "OBR", predicted: str = "prediccion") -> DataFrame:
    """MAE, RMSE, MAPE and R² per key group, in one aggregation."""
    y, p = F.col(real), F.col(predicted)
    error = y - p
    out = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.when(F.abs(y) >= 1e-6, F.abs(error) / F.abs(y))).alias("mape"),
        F.sum(error * error).alias("_res"), (F.var_pop(y) * F.count(y)).alias("_tot"))
    r2 = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(F.col("_tot") > 0, 1 - F.col("_res") / F.nullif(F.col("_tot"), F.lit(0.0)))
        .when(F.col("_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.withColumn("r2", r2).drop("_res", "_tot")


def model_number(name: Column) -> Column:
    """Place in the order of models; a name that is not in it comes last."""
    place = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), name)
    return F.when(place > 0, place).otherwise(len(MODEL_ORDER) + 1)


def winners(scores: DataFrame) -> DataFrame:
    """The model with the least MAE per region, the earlier one on ties."""
    best = scores.where(F.col("mae").isNotNull()).groupBy("ccaa_slug").agg(
        F.min(F.struct("mae", model_number(F.col("modelo")).alias("_k"), "modelo", "mape", "r2")).alias("w"))
    return best.select(
        "ccaa_slug", F.col("w.modelo").alias("modelo"), F.col("w.mae").alias("mae"), F.col("w.mape").alias("mape"),
        F.col("w.r2").alias("r2"),
        F.when(F.col("w.modelo").isin(BASELINES), "no").otherwise("sí").alias("bate_baseline"))


def baseline_against_models(scores: DataFrame) -> DataFrame:
    base = F.col("modelo").startswith("baseline")
    return scores.groupBy("ccaa_slug").agg(
        F.round(F.min(F.when(base, F.col("mae"))) / 1e6, 1).alias("mejor_baseline"),
        F.round(F.min(F.when(~base, F.col("mae"))) / 1e6, 1).alias("mejor_ml")).orderBy("mejor_baseline", "ccaa_slug")


def mae_matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    return scores.groupBy("ccaa_slug").agg(*[
        F.round(F.max(F.when(F.col("modelo") == m, F.col("mae"))) / 1e6, 1).alias(m) for m in models])


def share_beaten(best: DataFrame) -> DataFrame:
    return best.agg(
        F.count_if(F.col("bate_baseline") == "sí").alias("n_ml"), F.count(F.lit(1)).alias("n_ccaa"),
        (F.count_if(F.col("bate_baseline") == "sí") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("cuota"))


def comparison_table(scores: DataFrame, gates: DataFrame) -> DataFrame:
    """Region × model table with sample sizes; regions without enough data keep
    one row with the note."""
    shown = scores.select(
        "ccaa_slug", "modelo", F.round(F.col("mae") / 1e6, 1).alias("mae_meur"), F.round("mape", 3).alias("mape"),
        F.round("r2", 3).alias("r2"))
    return gates.join(shown, "ccaa_slug", "left").select(
        "ccaa_slug", "n_train", "n_test", F.coalesce("modelo", F.lit("—")).alias("modelo"), "mae_meur", "mape",
        "r2", "nota")


# --- predictions -----------------------------------------------------------------

def score_year(predictions: DataFrame, year: int) -> DataFrame:
    """Forecasts of one year with their relative deviation and alert."""
    deviation = ratio(F.col("OBR") - F.col("prediccion"), F.col("prediccion"))
    return predictions.where(F.col("anio") == year).withColumn("desviacion_rel", deviation).withColumn(
        "alerta", alert_by_band(F.col("desviacion_rel")))


def prediction_table(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """The winner's forecasts, with the version of its model, deviation, alert and the region's metrics."""
    pred, real = F.col("prediccion"), F.col("OBR")
    deviation = F.when(F.abs(pred) > 1e-6, (real - pred) / F.nullif(pred, F.lit(0.0)))
    rows = predictions.join(best.select("ccaa_slug", "modelo", "mae", "mape"), ["ccaa_slug", "modelo"])
    return rows.select(
        "ccaa_slug", "entidad_id", F.col("anio").cast("int").alias("anio"),
        F.col("capitulo_id").cast("smallint").alias("capitulo_id"), "modelo", "modelo_version",
        pred.alias("importe_predicho"), real.alias("importe_real"), "mae", "mape",
        deviation.alias("desviacion_rel"), alert_by_limit(deviation).alias("alerta"))


def with_prediction_ids(table: DataFrame) -> DataFrame:
    """pred_id 1..n by region, year and amounts."""
    return numbered(
        table, {"ccaa_slug": F.col("ccaa_slug"), "anio": F.col("anio"), "_amount": slot(F.col("importe_real"))},
        ["importe_real", "importe_predicho", F.col("entidad_id").asc_nulls_last(),
         F.col("capitulo_id").asc_nulls_last()], "pred_id").drop("_amount")

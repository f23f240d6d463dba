"""Feature-store queries (FEA)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.operators import features as fe
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.registry import query
from fiscalis.session import cut
from fiscalis.sources import sample_tables as st

KEYS = "ccaa_slug, entidad_id, anio, trimestre, capitulo_id, grupo_funcional_id"


def features(spark, sf) -> DataFrame:
    return fe.build_features(st.facts(spark, sf))


def stored_features(spark, sf) -> DataFrame:
    """The feature table written to the shared folder, for queries that pass
    over it more than once: the facts are read once, and what follows starts
    from the far smaller table."""
    return cut(spark, features(spark, sf), "features")


def rounded(df: DataFrame, digits: dict[str, int], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, d).alias(c) for c, d in digits.items()])


def _sql_round(digits: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())


def feature_view(name: str, digits: dict[str, int]) -> None:
    """Register a projection of the feature table."""
    @query(name, check(f"SELECT {KEYS}, {_sql_round(digits)} FROM feat"))
    def build(spark, sf):
        return rounded(features(spark, sf), digits, fe.GRAIN)


@query("fea01_grain_sums", check(
    f"SELECT {KEYS}, fase, CAST(sum(importe_eur) AS DOUBLE) AS importe_eur FROM fact GROUP BY ALL"))
def fea01(spark, sf):
    return fe.sums_by_grain(st.facts(spark, sf))


@query("fea02_phase_pivot", check(f"SELECT {KEYS}, PRE, CRE, ARN, DIS, OBR, PAG FROM wide"))
def fea02(spark, sf):
    return fe.phase_columns(st.facts(spark, sf))


feature_view("fea03_gap", {"brecha_eur": 2, "brecha_pct": 6})
feature_view("fea04_credit_ratio", {"ratio_cre_pre": 6})
feature_view("fea05_execution_rate", {"ejecutado_pct": 6})
feature_view("fea06_payment_rate", {"pago_pct": 6})
feature_view("fea07_obr_lags", {f"obr_lag_{k}": 2 for k in (1, 2, 3, 4)})
feature_view("fea08_rolling_mean", {"obr_rolling4_mean": 4})
feature_view("fea09_rolling_std", {"obr_rolling4_std": 4})


@query("fea10_history_without_obr", check("""
SELECT ccaa_slug, count(*) AS n, count(OBR) AS n_obr, count(obr_lag_1) AS n_lag1,
  count(obr_rolling4_mean) AS n_mean, count(obr_rolling4_std) AS n_std
FROM feat GROUP BY ccaa_slug HAVING count(OBR) = 0"""))
def fea10(spark, sf):
    return (
        features(spark, sf).groupBy("ccaa_slug")
        .agg(F.count(F.lit(1)).alias("n"), F.count("OBR").alias("n_obr"), F.count("obr_lag_1").alias("n_lag1"),
             F.count("obr_rolling4_mean").alias("n_mean"), F.count("obr_rolling4_std").alias("n_std"))
        .where(F.col("n_obr") == 0)
    )


FULL = {
    **{c: 2 for c in ("PRE", "CRE", "ARN", "DIS", "OBR", "PAG", "brecha_eur")},
    **{c: 6 for c in ("brecha_pct", "ratio_cre_pre", "ejecutado_pct", "pago_pct")},
    **{f"obr_lag_{k}": 2 for k in (1, 2, 3, 4)},
    "obr_rolling4_mean": 4, "obr_rolling4_std": 4, "q_sin": 6, "q_cos": 6,
}
feature_view("fea11_feature_table", FULL)

# The sample years end in 2001: train until 1998, test 1999-2000, hold out the
# unfinished last year.
TRAIN_UNTIL, TEST_YEARS = 1998, (1999, 2000)

CTES["model_base"] = """
SELECT ccaa_slug, capitulo_id, anio,
  CAST(coalesce(sum(CAST(OBR AS DECIMAL(18,2))), 0) AS DOUBLE) AS OBR,
  CAST(coalesce(sum(CAST(PRE AS DECIMAL(18,2))), 0) AS DOUBLE) AS PRE,
  CAST(coalesce(sum(CAST(CRE AS DECIMAL(18,2))), 0) AS DOUBLE) AS CRE,
  CAST(coalesce(sum(CAST(PAG AS DECIMAL(18,2))), 0) AS DOUBLE) AS PAG
FROM clean_feat WHERE capitulo_id IS NOT NULL GROUP BY ALL"""
CTES["model_table"] = """
SELECT *, CRE / nullif(PRE, 0) AS ratio_cre_pre, (PRE - OBR) / nullif(PRE, 0) AS brecha_pct,
  OBR / nullif(CRE, 0) AS ejecutado_pct,
  lag(OBR, 1) OVER w AS obr_lag_1, lag(OBR, 2) OVER w AS obr_lag_2, lag(OBR, 3) OVER w AS obr_lag_3,
  avg(OBR) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS obr_roll3_mean,
  CASE WHEN anio <= 1998 THEN 'train' WHEN anio IN (1999, 2000) THEN 'test' ELSE 'holdout' END AS split
FROM model_base WINDOW w AS (PARTITION BY ccaa_slug, capitulo_id ORDER BY anio)"""


def clean_features(spark, sf) -> DataFrame:
    from fiscalis.operators.quality import plausible_features
    return plausible_features(features(spark, sf))


def model_table(spark, sf) -> DataFrame:
    return fe.build_model_table(clean_features(spark, sf), TRAIN_UNTIL, TEST_YEARS)


@query("fea12_model_grain", check("""
SELECT ccaa_slug, capitulo_id, anio, OBR, PRE, CRE, PAG, round(ratio_cre_pre, 6) AS ratio_cre_pre,
  round(brecha_pct, 6) AS brecha_pct, round(ejecutado_pct, 6) AS ejecutado_pct FROM model_table"""))
def fea12(spark, sf):
    return rounded(fe.model_grain(clean_features(spark, sf)),
                   {"ratio_cre_pre": 6, "brecha_pct": 6, "ejecutado_pct": 6},
                   ["ccaa_slug", "capitulo_id", "anio", "OBR", "PRE", "CRE", "PAG"])


@query("fea13_model_lags", check(
    "SELECT ccaa_slug, capitulo_id, anio, obr_lag_1, obr_lag_2, obr_lag_3 FROM model_table"))
def fea13(spark, sf):
    return model_table(spark, sf).select("ccaa_slug", "capitulo_id", "anio", "obr_lag_1", "obr_lag_2", "obr_lag_3")


@query("fea14_leak_free_mean", check(
    "SELECT ccaa_slug, capitulo_id, anio, round(obr_roll3_mean, 4) AS obr_roll3_mean FROM model_table"))
def fea14(spark, sf):
    return rounded(model_table(spark, sf), {"obr_roll3_mean": 4}, ["ccaa_slug", "capitulo_id", "anio"])


@query("fea15_split_label", check("SELECT ccaa_slug, capitulo_id, anio, split FROM model_table"))
def fea15(spark, sf):
    return model_table(spark, sf).select("ccaa_slug", "capitulo_id", "anio", "split")


@query("fea16_rows_by_split", check("""
SELECT ccaa_slug, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'holdout') AS holdout
FROM model_table WHERE OBR > 0 GROUP BY ccaa_slug"""))
def fea16(spark, sf):
    return fe.rows_by_split(model_table(spark, sf))


@query("fea17_threshold_split", check("""
SELECT ccaa_slug, CASE WHEN anio <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n,
  CAST(sum(CAST(PRE AS DECIMAL(18,2))) AS DOUBLE) AS pre FROM feat WHERE anio IS NOT NULL GROUP BY ALL"""))
def fea17(spark, sf):
    train, test = fe.split_at(features(spark, sf), TRAIN_UNTIL)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("ccaa_slug", "part").agg(
        F.count(F.lit(1)).alias("n"), fe.money_sum(F.col("PRE")).alias("pre"))


@query("fea18_last_years_split", check(f"""
SELECT {KEYS}, y <= 2 AS is_test
FROM (SELECT *, dense_rank() OVER (PARTITION BY ccaa_slug ORDER BY anio DESC) AS y FROM feat)"""))
def fea18(spark, sf):
    return fe.split_last_years(features(spark, sf), 2).select(*fe.GRAIN, "is_test")


@query("fea19_final_year_split", check(f"""
SELECT {KEYS}, anio = last_year AS is_test FROM feat JOIN (
  SELECT ccaa_slug, max(anio) AS last_year FROM feat GROUP BY ccaa_slug HAVING count(DISTINCT anio) >= 3)
USING (ccaa_slug)"""))
def fea19(spark, sf):
    return fe.split_final_year(features(spark, sf)).select(*fe.GRAIN, "is_test")


@query("fea20_valid_target", check(f"SELECT {KEYS}, OBR FROM feat WHERE OBR IS NOT NULL AND OBR > 0"))
def fea20(spark, sf):
    return fe.valid_target(features(spark, sf)).select(*fe.GRAIN, "OBR")

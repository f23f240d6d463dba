"""From long facts to the feature table and the model table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.amounts import money_sum, ratio, season, zero

GRAIN = ["ccaa_slug", "entidad_id", "anio", "trimestre", "capitulo_id", "grupo_funcional_id"]
SERIES = ["ccaa_slug", "entidad_id", "capitulo_id", "grupo_funcional_id"]
AMOUNTS = ["PRE", "OBR", "CRE", "PAG"]


def sums_by_grain(fact: DataFrame) -> DataFrame:
    """Sum per grain and phase; NULL keys are groups of their own."""
    return fact.groupBy(*GRAIN, "fase").agg(money_sum(F.col("importe_eur")).alias("importe_eur"))


def phase_columns(fact: DataFrame) -> DataFrame:
    """One row per grain with a column per phase, in a single aggregation. A
    phase a region never publishes is an all-NULL column."""
    return fact.groupBy(*GRAIN).agg(*[
        money_sum(F.when(F.col("fase") == phase, F.col("importe_eur"))).alias(phase)
        for phase in ref.PHASES
    ])


def with_ratios(wide: DataFrame) -> DataFrame:
    pre, cre, obr, pag = (F.col(c) for c in ("PRE", "CRE", "OBR", "PAG"))
    return wide.withColumns({
        "brecha_eur": pre - obr,
        "brecha_pct": ratio(pre - obr, pre),
        "ratio_cre_pre": ratio(cre, pre),
        "ejecutado_pct": ratio(obr, cre),
        "pago_pct": ratio(pag, obr),
    })


def with_history(wide: DataFrame) -> DataFrame:
    """Positional lags and trailing-4 statistics of OBR.

    A series holds one row per year and quarter, so no partition outgrows a few
    hundred rows; all seven columns share one shuffle and one sort.
    """
    series = Window.partitionBy(*SERIES).orderBy(
        F.col("anio").asc_nulls_last(), F.col("trimestre").asc_nulls_last())
    trailing = series.rowsBetween(-3, 0)
    obr = F.col("OBR")
    return wide.withColumns({
        **{f"obr_lag_{k}": F.lag(obr, k).over(series) for k in (1, 2, 3, 4)},
        "obr_rolling4_mean": F.avg(obr).over(trailing),
        "obr_rolling4_std": F.stddev_samp(obr).over(trailing),
    })


def with_season(wide: DataFrame) -> DataFrame:
    quarter = F.col("trimestre")
    return wide.withColumns({"q_sin": season(quarter, F.sin), "q_cos": season(quarter, F.cos)})


def build_features(fact: DataFrame) -> DataFrame:
    """The feature table of all regions in one plan: one shuffle to aggregate,
    one on the (much smaller) aggregated rows for the windows."""
    return with_season(with_history(with_ratios(phase_columns(fact))))


# --- model grain -----------------------------------------------------------

def model_grain(features: DataFrame) -> DataFrame:
    """Sums by region, chapter and year; unclassified rows left out, a missing
    sum counts as 0."""
    sums = (
        features.where(F.col("capitulo_id").isNotNull())
        .groupBy("ccaa_slug", "capitulo_id", "anio")
        .agg(*[zero(money_sum(F.col(c))).alias(c) for c in AMOUNTS])
    )
    return sums.withColumns({
        "ratio_cre_pre": ratio(F.col("CRE"), F.col("PRE")),
        "brecha_pct": ratio(F.col("PRE") - F.col("OBR"), F.col("PRE")),
        "ejecutado_pct": ratio(F.col("OBR"), F.col("CRE")),
    })


def with_model_history(model: DataFrame) -> DataFrame:
    """Lags 1-3 and the mean of the three years before the row's own."""
    series = Window.partitionBy("ccaa_slug", "capitulo_id").orderBy("anio")
    return model.withColumns({
        **{f"obr_lag_{k}": F.lag("OBR", k).over(series) for k in (1, 2, 3)},
        "obr_roll3_mean": F.avg("OBR").over(series.rowsBetween(-3, -1)),
    })


def split_label(year: Column, train_until: int = 2022, test_years: tuple[int, ...] = (2023, 2024)) -> Column:
    return F.when(year <= train_until, "train").when(year.isin(*test_years), "test").otherwise("holdout")


def build_model_table(features: DataFrame, train_until: int = 2022,
                      test_years: tuple[int, ...] = (2023, 2024)) -> DataFrame:
    return with_model_history(model_grain(features)).withColumn(
        "split", split_label(F.col("anio"), train_until, test_years))


def valid_target(df: DataFrame) -> DataFrame:
    return df.where(F.col("OBR") > 0)


def rows_by_split(model: DataFrame) -> DataFrame:
    return (
        valid_target(model).groupBy("ccaa_slug")
        .agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test", "holdout")])
    )


# --- splits ----------------------------------------------------------------

def split_at(df: DataFrame, train_until: int = 2023) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("anio") <= train_until), df.where(F.col("anio") > train_until)


def last_years(df: DataFrame, n: int) -> DataFrame:
    """(ccaa_slug, first_test_year): where the last n distinct years start.

    The distinct years of a region are few, whatever its number of rows.
    """
    newest = Window.partitionBy("ccaa_slug").orderBy(F.col("anio").desc())
    return (
        df.select("ccaa_slug", "anio").distinct()
        .withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
        .groupBy("ccaa_slug").agg(F.min("anio").alias("first_test_year"))
    )


def split_last_years(df: DataFrame, n: int = 2) -> DataFrame:
    """Mark the rows of a region's last n distinct years as test rows."""
    return (
        df.join(last_years(df, n), "ccaa_slug")
        .withColumn("is_test", F.col("anio") >= F.col("first_test_year"))
        .drop("first_test_year")
    )


def split_final_year(df: DataFrame, min_years: int = 3) -> DataFrame:
    """Mark the final year of a region as test; regions with fewer than
    `min_years` distinct years are left out."""
    span = (
        df.where(F.col("anio").isNotNull()).groupBy("ccaa_slug")
        .agg(F.max("anio").alias("_last"), F.count_distinct("anio").alias("_years"))
        .where(F.col("_years") >= min_years)
    )
    return df.join(span, "ccaa_slug").withColumn("is_test", F.col("anio") == F.col("_last")).drop("_last", "_years")

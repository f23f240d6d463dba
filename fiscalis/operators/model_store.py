"""Trained models in a folder of tables: written once, read back to score any rows.

    models/modelo=<name>       (ccaa_slug, modelo_version, log): which regions a model knows
    weights/modelo=<name>      (ccaa_slug, columna, peso): linear models, '' being the intercept
    trees/modelo=<name>        the nodes of tree models (`ensembles`)
    preparation                what the columns of prepared rows were shifted by and filled with

A model is saved by overwriting its own part of each table, so a folder holds any number of models and
each is replaced as a whole. Rows of regions that a model doesn't know are not scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis.operators import ensembles

WEIGHTS = "ccaa_slug string, columna string, peso double"
KNOWN = "ccaa_slug string, modelo_version string, log boolean"


def _part(path: str, table: str, name: str) -> str:
    return f"{path.rstrip('/')}/{table}/modelo={name}"


def save_model(table: DataFrame, path: str, name: str, version: str, log: bool = False) -> None:
    """Write a model: tree nodes, or weights (ccaa_slug, columna, peso)."""
    kind = "trees" if "left_node" in table.columns else "weights"
    table.write.mode("overwrite").parquet(_part(path, kind, name))
    known = table.sparkSession.read.schema(table.schema).parquet(_part(path, kind, name)).select("ccaa_slug").distinct()
    known.select("ccaa_slug", F.lit(version).alias("modelo_version"), F.lit(log).alias("log")).write.mode("overwrite").parquet(_part(path, "models", name))


def save_preparation(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/preparation")


def read_preparation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ccaa_slug string, _medians map<string,double>, _mode int").parquet(f"{path.rstrip('/')}/preparation")


def linear_weights(fit: DataFrame, columns: list[str]) -> DataFrame:
    """The fit of a linear learner (ccaa_slug, intercept, weights) as stored weights."""
    names = F.array(F.lit(""), *[F.lit(c) for c in columns])
    return fit.select("ccaa_slug", F.inline(F.arrays_zip(names.alias("columna"), F.concat(F.array("intercept"), "weights").alias("peso"))))


def score_linear(rows: DataFrame, path: str, name: str, columns: list[str]) -> DataFrame:
    """Rows with modelo, modelo_version and prediccion of a stored linear model."""
    spark = rows.sparkSession
    weights = spark.read.schema(WEIGHTS).parquet(_part(path, "weights", name))
    held = weights.groupBy("ccaa_slug").agg(F.map_from_entries(F.collect_list(F.struct("columna", "peso"))).alias("_w"))
    value = F.col("_w")[""]
    for c in columns:
        value = value + F.coalesce(F.try_element_at("_w", F.lit(c)), F.lit(0.0)) * F.col(c)
    return _scored(rows.join(held, "ccaa_slug").withColumn("_value", value).drop("_w"), path, name)


def score_trees(rows: DataFrame, path: str, name: str, numeric: list[str], flags: list[str]) -> DataFrame:
    """Prepared rows (with their number) with modelo, modelo_version and prediccion of a stored tree model."""
    model = rows.sparkSession.read.schema(ensembles.MODEL).parquet(_part(path, "trees", name))
    found = ensembles.forecast_trees(rows, model, numeric, flags)
    return _scored(rows.join(found.withColumnRenamed("forecast", "_value"), "number"), path, name)


def _scored(rows: DataFrame, path: str, name: str) -> DataFrame:
    known = rows.sparkSession.read.schema(KNOWN).parquet(_part(path, "models", name))
    value = F.when(F.col("log"), F.expm1("_value")).otherwise(F.col("_value"))
    return rows.join(known, "ccaa_slug").withColumns({"modelo": F.lit(name), "prediccion": value}).drop("_value", "log")

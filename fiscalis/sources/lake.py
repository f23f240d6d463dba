"""Reads from the curated and feature layers, and regional monthly sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fiscalis.functions.amounts import money_sum
from fiscalis.functions.text import chapter_digit, month_number


def read_partitioned(spark: SparkSession, root: str, where: Column | str | None = None,
                     schema: StructType | None = None) -> DataFrame:
    """A partitioned table; conditions on partition columns prune directories,
    the others reach the Parquet reader. Without `schema` the footers of all
    files are opened to merge theirs."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    rows = reader.parquet(root)
    return rows.where(where) if where is not None else rows


def read_regions(spark: SparkSession, root: str, region: str | None = None) -> DataFrame:
    """Feature files of one region or all; region and year come from the path."""
    path = f"{root}/ccaa_slug={region}" if region else root
    rows = spark.read.option("basePath", root).parquet(path)
    place = F.col("_metadata.file_path")
    if "anio" not in rows.columns:
        rows = rows.withColumn("anio", F.regexp_extract(place, r"anio=(\d+)", 1).try_cast("int"))
    if "ccaa_slug" not in rows.columns:
        rows = rows.withColumn("ccaa_slug", F.regexp_extract(place, r"ccaa_slug=([^/]+)", 1))
    return rows


def read_glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a root that match a glob, partition columns included."""
    return spark.read.option("basePath", root).parquet(f"{root}/{pattern}")


def read_facts(fact: DataFrame, region: str | None = None, year: int | None = None,
               limit: int | None = None) -> DataFrame:
    """Facts with the optional serving filters and row cap."""
    if region:
        fact = fact.where(F.col("ccaa_slug") == region)
    if year:
        fact = fact.where(F.col("anio") == year)
    return fact.limit(limit) if limit is not None else fact


def read_table(table: DataFrame, region: str | None = None, column: str = "ccaa_slug") -> DataFrame:
    return table.where(F.col(column) == region) if region else table


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Text columns become numeric where no value is lost. All columns are
    judged in one pass that returns one row."""
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not texts:
        return df

    def cast(c: str) -> Column:
        return F.when(F.col(c).rlike(number), F.trim(F.col(c)).try_cast("double"))

    verdict = df.agg(*[(F.count(cast(c)) >= F.count(c)).alias(c) for c in texts]).first()
    return df.select(*[cast(c).alias(c) if c in texts and verdict[c] else F.col(c) for c in df.columns])


def curated_summary(fact: DataFrame) -> DataFrame:
    """Rows and year range per region; reads partition columns only."""
    return fact.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("filas"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"))


def summary_from_footers(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The same of a table partitioned by region and year, from the row counts in the footers of its files.

    Spark's second Parquet reader takes counts by partition from footers; no row and no column is read.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    first = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(name for name in first.split(",") if name != "parquet"))
    try:
        fact = spark.read.schema(schema).parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", first)
    counts = fact.groupBy("ccaa_slug", "anio").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("ccaa_slug").agg(F.sum("n").alias("filas"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"))


def cumulative_by_year(rows: DataFrame, phases: dict[str, str], entity: str) -> DataFrame:
    """Year × chapter amounts of a source that publishes running totals per
    month (exercici, mes, cap_tol_codi, entitat): the last month of each year."""
    chapter = F.col("cap_tol_codi").try_cast("int")
    monthly = rows.where((F.col("entitat") == entity) & chapter.between(1, 9)).groupBy(
        F.col("exercici").try_cast("int").alias("exercici"), month_number(F.col("mes")).alias("_mes"),
        chapter.alias("capitol codi"),
    ).agg(*[money_sum(F.col(c)).alias(name) for c, name in phases.items()])
    # At most 12 × 9 aggregated rows per year.
    last = F.max("_mes").over(Window.partitionBy("exercici"))
    return monthly.where(F.col("exercici").isNotNull()).withColumn("_last", last).where(
        F.col("_mes") == F.col("_last")).drop("_mes", "_last")


def cumulative_by_file(rows: DataFrame, phases: dict[str, str]) -> DataFrame:
    """Chapter amounts per yearly file (anio, ac_mes, cd_cap): last month only,
    summed over entities."""
    monthly = rows.where(chapter_digit(F.col("cd_cap")).isNotNull()).groupBy(
        "anio", F.col("ac_mes").try_cast("int").alias("_mes"), chapter_digit(F.col("cd_cap")).alias("capitulo"),
    ).agg(*[money_sum(F.col(c)).alias(name) for c, name in phases.items()])
    months = rows.groupBy(F.col("anio").alias("_anio")).agg(F.max(F.col("ac_mes").try_cast("int")).alias("_last"))
    return monthly.join(months, (F.col("anio") == F.col("_anio")) & (F.col("_mes") == F.col("_last"))).drop(
        "_anio", "_mes", "_last")

"""Row contracts, duplicate blocks, plausibility and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref

AMOUNT_COLUMNS = ["PRE", "OBR", "CRE", "PAG"]


# --- row contract ----------------------------------------------------------

def contract_rules() -> dict[str, Column]:
    """Rule name -> condition that holds for a good row (never NULL)."""
    c = F.col
    return {
        "ccaa_slug_present": c("ccaa_slug").isNotNull(),
        "anio_present": c("anio").isNotNull(),
        "anio_range": F.coalesce(c("anio").between(ref.YEAR_MIN, ref.YEAR_MAX), F.lit(True)),
        "trimestre_known": F.coalesce(c("trimestre").isin(1, 2, 3, 4), F.lit(True)),
        "capitulo_range": F.coalesce(c("capitulo_id").between(0, 9), F.lit(True)),
        "fase_known": F.coalesce(c("fase").isin(*ref.PHASES), F.lit(False)),
        "importe_present": c("importe_eur").isNotNull(),
        "importe_floor": F.coalesce(c("importe_eur") >= ref.AMOUNT_FLOOR, F.lit(True)),
        "dataset_present": c("dataset_uri").isNotNull(),
    }


def broken_rules(rows: DataFrame) -> DataFrame:
    """Add `broken`: the names of all rules a row violates."""
    flags = [F.when(~ok, F.lit(name)) for name, ok in contract_rules().items()]
    return rows.withColumn("broken", F.filter(F.array(*flags), lambda r: r.isNotNull()))


def violations(rows: DataFrame) -> DataFrame:
    return (
        broken_rules(rows).select(F.explode("broken").alias("rule"))
        .groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    )


def accept_whole_files(rows: DataFrame, file_key: str = "distribution_id") -> DataFrame:
    """Rows of the files in which every row keeps the contract.

    Only the keys of rejected files are gathered; the rows themselves meet them
    in an anti-join, which adaptive execution can split on a hot file.
    """
    good = reduce(lambda a, b: a & b, contract_rules().values())
    rejected = rows.where(~good).select(file_key).distinct()
    return rows.join(rejected, file_key, "left_anti")


# --- duplicate blocks ------------------------------------------------------

BLOCK = ["ccaa_slug", "anio", "dataset_uri"]
BLOCK_ROW = ["entidad_id", "capitulo_id", "grupo_funcional_id", "fase", "importe_eur"]


def block_fingerprints(fact: DataFrame) -> DataFrame:
    """One row per (region, year, dataset) with a fingerprint of its multiset of
    rows: their number and two independent 64-bit hash sums. All three combine
    map-side, so a hot block costs no more than any other."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BLOCK_ROW]
    one = F.xxhash64(*shown)
    two = F.xxhash64(F.lit("second"), *reversed(shown))
    return fact.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(one.cast("decimal(20,0)")).alias("h1"),
        F.sum(two.cast("decimal(20,0)")).alias("h2"),
    )


def duplicate_blocks(fact: DataFrame) -> DataFrame:
    """Blocks equal to another block of the same region and year, all but the
    first by dataset."""
    same = ["ccaa_slug", "anio", "n", "h1", "h2"]
    prints = block_fingerprints(fact).alias("b")
    groups = block_fingerprints(fact).groupBy(*same).agg(
        F.min("dataset_uri").alias("kept"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1).alias("g")
    equal = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"g.{c}")) for c in same])
    return prints.join(groups, equal).where(~F.col("b.dataset_uri").eqNullSafe(F.col("g.kept"))).select(
        *[F.col(f"b.{c}").alias(c) for c in BLOCK])


def drop_duplicate_blocks(fact: DataFrame) -> DataFrame:
    extra = duplicate_blocks(fact).select(*[F.col(c).alias(f"_{c}") for c in BLOCK])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BLOCK]
    return fact.join(extra, reduce(lambda a, b: a & b, same), "left_anti")


# --- schema contracts ------------------------------------------------------

def schema_gap(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names."""
    return ([c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected])


def fact_contract(fact: DataFrame) -> DataFrame:
    """Rows per region next to the schema verdict of the table they come from."""
    missing, extra = schema_gap(fact, ref.FACT_COLUMNS)
    return fact.groupBy("ccaa_slug").agg(F.count(F.lit(1)).alias("n")).select(
        "ccaa_slug", "n",
        F.lit(",".join(missing)).alias("missing"), F.lit(",".join(extra)).alias("extra"),
        F.lit(not missing and not extra).alias("ok"),
    )


def feature_contract(features: DataFrame) -> DataFrame:
    """Size of each region's features and the required ones it lacks: a column
    that is missing, or empty for the whole region."""
    absent = [c for c in ref.REQUIRED_FEATURES if c not in features.columns]
    have = [c for c in ref.REQUIRED_FEATURES if c in features.columns]
    sizes = features.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("n"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"),
        *[F.bool_or(F.col(c).isNotNull()).alias(f"_{c}") for c in have],
    )
    combos = (
        features.select("ccaa_slug", "entidad_id", "capitulo_id", "anio").distinct()
        .groupBy("ccaa_slug").agg(F.count(F.lit(1)).alias("combos"))
    )
    lacking = F.concat(
        F.array(*[F.lit(c) for c in absent]).cast("array<string>"),
        F.filter(F.array(*[F.when(~F.col(f"_{c}"), F.lit(c)) for c in have]), lambda x: x.isNotNull()),
    )
    return sizes.join(combos, "ccaa_slug").select(
        "ccaa_slug", "n", "combos", "anio_min", "anio_max",
        F.array_join(lacking, ",").alias("missing"), (F.size(lacking) == 0).alias("ok"),
    )


def usability(checked: DataFrame) -> DataFrame:
    """Grade a region by its share of valid rows; needs `valid` and `total`."""
    share = F.col("valid") / F.greatest(F.col("total"), F.lit(1)) * 100
    grade = (
        F.when(F.col("total") == 0, "sin datos").when(share >= 80, "explotable")
        .when(share >= 50, "parcial").otherwise("errores")
    )
    return checked.withColumns({"pct": share, "grado": grade})


# --- plausibility ----------------------------------------------------------

def plausible_facts(fact: DataFrame, limit: float = ref.MAX_AMOUNT) -> DataFrame:
    """Inclusive bounds; a missing amount is not plausible."""
    return fact.where(F.col("importe_eur").between(-limit, limit))


def too_large(limit: float = ref.MAX_AMOUNT) -> Column:
    """True when any phase amount is beyond the limit; NULL amounts pass."""
    return reduce(lambda a, b: a | b, [
        F.coalesce(F.abs(F.col(c)) > limit, F.lit(False)) for c in AMOUNT_COLUMNS])


def plausible_features(features: DataFrame, limit: float = ref.MAX_AMOUNT) -> DataFrame:
    return features.where(~too_large(limit))


def strictly_below(features: DataFrame, column: str = "PRE", limit: float = ref.MAX_AMOUNT) -> DataFrame:
    """Strict bound; a missing amount is dropped."""
    return features.where(F.abs(F.col(column)) < limit)


def sanitising_report(features: DataFrame, limit: float = ref.MAX_AMOUNT) -> DataFrame:
    return features.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("n_filas"), F.count_if(too_large(limit)).alias("n_corruptas"),
    ).withColumn("pct_corruptas", F.round(F.col("n_corruptas") / F.col("n_filas") * 100, 3))


def load_diagnosis(fact: DataFrame, by: str, limit: float = 1e10) -> DataFrame:
    """Counts and sums above, and count and mean below the limit, per load."""
    amount = F.col("importe_eur")
    return fact.groupBy(by).agg(
        F.count_if(amount > limit).alias("n_altas"),
        F.sum(F.when(amount > limit, amount)).cast("double").alias("suma_altas"),
        F.count_if(amount < limit).alias("n_normales"),
        F.avg(F.when(amount < limit, amount.cast("double"))).alias("media_normales"),
    )

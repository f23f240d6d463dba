"""Raw tables with any header dialect to the canonical long fact.

What depends on the headers is planned once from the column names; files that
share a header are one DataFrame, so a plan covers a whole group of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.amounts import parse_amount
from fiscalis.functions.text import clean_header, parse_chapter, parse_year, phase_from_text, year_in_text
from fiscalis.session import cut

# Columns that say where a row comes from; never renamed.
ORIGIN = ["ccaa_slug", "dataset_uri", "distribution_id"]

_BY_LENGTH = [(clean_header(alias), name) for alias, name in
              sorted(ref.COLUMN_ALIASES.items(), key=lambda kv: -len(kv[0]))]


def canonical_name(header: str) -> str:
    """Canonical column of a header: the longest alias it contains."""
    if header in ORIGIN:
        return header
    cleaned = clean_header(header)
    return next((name for alias, name in _BY_LENGTH if alias in cleaned), cleaned)


def with_canonical_names(df: DataFrame) -> DataFrame:
    """Rename all headers; of several that mean the same the first stays."""
    names = [canonical_name(c) for c in df.columns]
    first = [i for i, name in enumerate(names) if name not in names[:i]]
    renamed = df.toDF(*[f"_{i}" for i in range(len(names))])
    return renamed.select(*[F.col(f"_{i}").alias(names[i]) for i in first])


def sdmx_measure(df: DataFrame) -> DataFrame:
    """Only absolute amounts of a statistical table, not shares or per-head values."""
    if "medidas" not in df.columns:
        return df
    return df.where(F.upper(F.col("medidas")) == ref.SDMX_MEASURE).drop("medidas")


def sdmx_chapters(df: DataFrame) -> DataFrame:
    """Only the expenditure chapters of a hierarchical table, which add up to
    its total; a file that splits them again by programme repeats them and
    gives no rows."""
    if "presupuesto_partida" not in df.columns:
        return df
    if {"presupuesto_programa_gasto", "presupuesto_programa"} & set(df.columns):
        return df.limit(0)
    code = F.upper(F.trim(F.col("presupuesto_partida").cast("string")))
    return df.where(code.rlike("^G_[1-9]$")).withColumn("capitulo_id", F.substring(code, 3, 1)).drop(
        "presupuesto_partida")


def unpivot_phases(df: DataFrame) -> DataFrame:
    """One row per `importe_*` column; its suffix is the phase."""
    amounts = [c for c in df.columns if c.startswith("importe_")]
    keys = [c for c in df.columns if c not in amounts and c != "fase"]
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c[len("importe_"):].upper()) for c in amounts])
    long = texts.unpivot(keys, [c[len("importe_"):].upper() for c in amounts], "fase", "importe")
    return long.withColumn("importe_eur", parse_amount(F.col("importe"))).drop("importe")


def known_phases(df: DataFrame) -> DataFrame:
    """Phase codes stay; other labels are mapped."""
    phase = F.col("fase")
    return df.withColumn("fase", F.when(phase.isin(*ref.PHASES), phase).otherwise(phase_from_text(phase)))


def labelled_phases(df: DataFrame, file_key: str | None) -> DataFrame:
    """Phase out of a label column. In a file where no label is a phase, the
    column describes something else and the amounts are the initial budget."""
    mapped = df.withColumn("fase", phase_from_text(F.col("fase")))
    if file_key is None or file_key not in df.columns:
        any_phase = mapped.agg(F.count("fase")).scalar() > 0
        phase = F.when(any_phase, F.col("fase")).otherwise("PRE")
        return mapped.withColumn("fase", phase)
    # Written first, so that the join knows its size: the rows are not dealt by file, of which one may hold most of them.
    speaking = cut(df.sparkSession, mapped.where(F.col("fase").isNotNull()).select(F.col(file_key).alias("_file")).distinct(), "speaking-files")
    joined = mapped.join(speaking, F.col(file_key).eqNullSafe(F.col("_file")), "left")
    phase = F.when(F.col("_file").isNull(), "PRE").otherwise(F.col("fase"))
    return joined.withColumn("fase", phase).drop("_file")


def with_phases(df: DataFrame, file_key: str | None = "distribution_id") -> DataFrame:
    """Bring any layout to one amount and one phase per row."""
    have = set(df.columns)
    if {"importe_eur", "fase"} <= have and "importe" not in have:
        return known_phases(df)
    if any(c.startswith("importe_") for c in have):
        return unpivot_phases(df)
    if "importe" not in have:
        return df
    if "fase" in have:
        df = labelled_phases(df, file_key)
    else:
        df = df.withColumn("fase", F.lit("PRE"))
    return df.withColumn("importe_eur", parse_amount(F.col("importe")))


def with_year(df: DataFrame) -> DataFrame:
    if "anio" not in df.columns and "__sheet__" in df.columns:
        df = df.withColumn("anio", year_in_text(F.col("__sheet__")))
    return df.withColumn("anio", parse_year(F.col("anio"))) if "anio" in df.columns else df


def canonical_rows(df: DataFrame) -> DataFrame:
    """The nine canonical columns (and the file they come from), complete rows only."""
    kinds = {"anio": "int", "trimestre": "int", "capitulo_id": "int", "importe_eur": "double"}

    def column(name: str) -> Column:
        kind = kinds.get(name, "string")
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        col = F.col(name)
        if kind == "int" and dict(df.dtypes)[name] == "string":
            return col.try_cast("double").try_cast("int").alias(name)
        return col.cast(kind).alias(name)

    names = [*ref.FACT_COLUMNS, *(["distribution_id"] if "distribution_id" in df.columns else [])]
    # A filter on parsed columns would be pushed down and parse each of them again; on generated ones it stays where it is.
    needed = ["anio", "fase", "importe_eur"]
    others = [column(name) for name in names if name not in needed]
    rows = df.select(*others, F.inline(F.array(F.struct(*map(column, needed)))))
    return rows.dropna(subset=needed).select(*names)


def normalize(df: DataFrame, file_key: str | None = "distribution_id") -> DataFrame:
    """Canonical facts of all files that share one header. `ccaa_slug` and
    `dataset_uri` come as columns."""
    df = sdmx_chapters(sdmx_measure(with_canonical_names(df)))
    df = with_year(df)
    if "capitulo_id" in df.columns:
        df = df.withColumn("capitulo_id", parse_chapter(F.col("capitulo_id")))
    return canonical_rows(with_phases(df, file_key))


def consolidate(parts: list[DataFrame]) -> DataFrame:
    """All groups of files as one table, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

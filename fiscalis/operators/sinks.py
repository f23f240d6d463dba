"""Writes, upserts, referential checks and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis import reference_data as ref


# --- files and tables ------------------------------------------------------

def write_table(df: DataFrame, path: str) -> bool:
    """Write Parquet unless there is nothing to write."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_by_year(df: DataFrame, path: str, columns: tuple[str, ...] = ("ccaa_slug", "anio")) -> None:
    """Replace the whole table, one directory per region and year. The rows are
    rebalanced by directory: a hot one is split over many tasks and files, small
    ones share a task."""
    (df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(*columns).parquet(path))


def replace_regions(df: DataFrame, path: str) -> None:
    """Replace all rows of the regions in `df`; other regions stay.

    Years a region no longer has must go as well, so the table is laid out by
    region first and the regions present are overwritten as partitions.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ccaa_slug").parquet(path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Full refresh of a catalogue table, below `path` where one is given."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def load_if_empty(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Append only when the destination has no rows yet."""
    try:
        empty = spark.read.schema(df.schema).parquet(path).isEmpty()
    except AnalysisException:  # nothing there yet
        empty = True
    if empty:
        df.write.mode("append").parquet(path)
    return empty


def with_load_time(df: DataFrame, name: str = "generated_at") -> DataFrame:
    """When the rows were produced, in UTC."""
    return df.withColumn(name, F.current_timestamp())


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


# --- rows ------------------------------------------------------------------

def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows and the new ones whose key is free; the first of equal new
    keys wins. A key with a NULL never collides."""
    rest = [c for c in new.columns if c not in keys]
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = new.where(keyed).groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    unique = first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in new.columns])
    free = unique.join(old.select(*keys), keys, "left_anti").select(*new.columns)
    return old.unionByName(free).unionByName(new.where(~keyed))


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the last of equal new keys wins."""
    rest = [c for c in new.columns if c != key and c not in order]
    last = new.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    rows = last.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in new.columns])
    return old.join(rows.select(key), key, "left_anti").select(*new.columns).unionByName(rows)


def fill_dimension(dimension: DataFrame, fact: DataFrame, column: str, key: str, constants: dict) -> DataFrame:
    """The dimension and a placeholder row for every fact id it lacks."""
    ids = fact.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(key)).distinct()
    missing = ids.join(dimension.select(key), key, "left_anti").withColumns({c: F.lit(v) for c, v in constants.items()})
    return dimension.unionByName(missing.select(*dimension.columns))


def null_orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent row become NULL."""
    known = parent.select(F.col(key).alias("_known")).distinct()
    joined = child.join(known, F.col(column) == F.col("_known"), "left")
    return joined.withColumn(column, F.col("_known")).drop("_known").select(*child.columns)


def orphan_counts(spark: SparkSession, tables: dict[str, DataFrame], foreign_keys=ref.FOREIGN_KEYS) -> DataFrame:
    """Rows without parent per foreign key.

    Each child table is read once: combinations of its keys are counted, only
    these are stacked, and only distinct values meet the parent keys.
    """
    counted = []
    for child in sorted({fk[1] for fk in foreign_keys}):
        fks = [(name, column) for name, table, column, _, _ in foreign_keys if table == child]
        wide = tables[child].select(*[F.col(c).cast("string").alias(name) for name, c in fks])
        names = [name for name, _ in fks]
        long = wide.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).unpivot(["_n"], names, "fk", "valor").where(F.col("valor").isNotNull())
        counted.append(long.groupBy("fk", "valor").agg(F.sum("_n").alias("n")))
    parents = [
        tables[parent].select(F.lit(name).alias("fk"), F.col(key).cast("string").alias("valor")).distinct()
        for name, _, _, parent, key in foreign_keys]
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    orphans = union(counted).join(union(parents), ["fk", "valor"], "left_anti").groupBy("fk").agg(
        F.sum("n").alias("n"))
    names = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{fk[0]}')" for fk in foreign_keys) + " AS t(fk)")
    return names.join(orphans, "fk", "left").select(
        "fk", F.coalesce("n", F.lit(0)).cast("bigint").alias("huerfanos"),
        F.when(F.coalesce("n", F.lit(0)) > 0, "NOT VALID").otherwise("VALID").alias("estado"))


def destination_gaps(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row per table with the required columns it lacks and its extra ones."""
    from fiscalis.operators.quality import schema_gap

    rows = []
    for name, (df, expected) in tables.items():
        missing, extra = schema_gap(df, expected)
        rows.append(f"('{name}', '{','.join(missing)}', '{','.join(extra)}', {str(not missing).lower()})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(tabla, faltan, sobran, ok)")

"""Which files are authoritative: one format, one name, the latest snapshot.

Every "keep the best row" step is a minimum per key, so that a key with very
many copies combines map-side and never gathers in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def local_distributions(distributions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Distributions that have a file, with the region of their dataset."""
    regions = datasets.select(F.col("uri").alias("dataset_uri"), "ccaa_slug")
    return distributions.where(F.col("local_path").isNotNull()).join(regions, "dataset_uri")


def resource_key(path: Column) -> Column:
    """Logical name of a file: after the last `__`, known extension cut."""
    name = F.substring_index(F.substring_index(path, "/", -1), "__", -1)
    known = "|".join(e[1:] for e in ref.RESOURCE_EXTENSIONS)
    return F.lower(F.regexp_replace(name, rf"(?i)\.({known})$", ""))


def income_only(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("ingreso") & ~low.contains("gasto")


def excluded_for_region(region: Column, uri: Column) -> Column:
    """True for datasets on the region's own exclusion list (fixed rules)."""
    return reduce(lambda a, b: a | b, [
        (region == slug) & uri.contains(part)
        for slug, parts in ref.EXCLUDED_DATASETS.items() for part in parts])


def drop_income(distributions: DataFrame) -> DataFrame:
    return distributions.where(
        ~(income_only(F.col("dataset_uri")) | income_only(resource_key(F.col("local_path")))))


def drop_excluded(distributions: DataFrame) -> DataFrame:
    return distributions.where(~excluded_for_region(F.col("ccaa_slug"), F.col("dataset_uri")))


def format_rank(code: Column) -> Column:
    out = None
    for name, rank in ref.FORMAT_RANK.items():
        hit = F.upper(code) == name
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return F.coalesce(out, F.lit(ref.UNRANKED_FORMAT))


def _best(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key group under `order`."""
    rest = [c for c in rows.columns if c not in keys]
    ranks = {f"_o{i}": c for i, c in enumerate(order)}
    best = rows.withColumns(ranks).groupBy(*keys).agg(F.min(F.struct(*ranks, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def one_format(distributions: DataFrame) -> DataFrame:
    """One row per (dataset, resource): preferred format, then smallest id."""
    rows = distributions.withColumn("resource", resource_key(F.col("local_path")))
    return _best(rows, ["dataset_uri", "resource"], [format_rank(F.col("formato")), F.col("distribution_id")])


def drop_uuid_copies(rows: DataFrame) -> DataFrame:
    """Drop UUID-named resources of datasets that also hold a named one."""
    uuid = F.col("resource").rlike(UUID)
    named = rows.where(~uuid).select(F.col("dataset_uri").alias("_named")).distinct()
    return rows.join(named, uuid & (F.col("dataset_uri") == F.col("_named")), "left_anti")


def with_period(rows: DataFrame) -> DataFrame:
    """Series, year and month out of a resource name, NULL when not periodic.

    Three spellings, tried in this order: `...-YYYY-monthname`, `YYYY_MM`,
    `MM_YYYY`. In the numeric ones the series is the name with the period
    replaced by a marker.
    """
    name = F.col("resource")
    month = r"(0?[1-9]|1[0-2])"
    word = r"^(.*)-(\d{4})-([a-záéíóúñ]+)$"
    year_month = rf"(?:^|[_-])(20\d{{2}})[_-]{month}(?=[_-]|$)"
    month_year = rf"(?:^|[_-]){month}[_-](20\d{{2}})(?=[_-]|$)"

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(name, pattern, i)

    months = F.create_map(*[F.lit(x) for pair in ref.MONTHS.items() for x in pair])
    word_month = F.try_element_at(months, group(word, 3))

    def marked(pattern: str, mark: str) -> Column:
        """The name with its first period replaced (only the first counts)."""
        head = F.regexp_instr(name, F.lit(pattern))
        size = F.length(F.regexp_substr(name, F.lit(pattern)))
        return F.concat(F.substring(name, F.lit(1), head - 1), F.lit(mark),
                        F.substring(name, head + size, F.length(name)))

    is_word = word_month.isNotNull()
    is_ym, is_my = name.rlike(year_month), name.rlike(month_year)
    return rows.withColumns({
        "serie": F.when(is_word, group(word, 1)).when(is_ym, marked(year_month, "|ym|"))
        .when(is_my, marked(month_year, "|my|")),
        "anio": F.when(is_word, group(word, 2).try_cast("int"))
        .when(is_ym, group(year_month, 1).try_cast("int")).when(is_my, group(month_year, 2).try_cast("int")),
        "mes": F.when(is_word, word_month)
        .when(is_ym, group(year_month, 2).try_cast("int")).when(is_my, group(month_year, 1).try_cast("int")),
    })


def latest_snapshots(rows: DataFrame) -> DataFrame:
    """The latest month per (series, year); rows without a period stay. The key
    leaves the dataset out; regions are separate.

    A row without a period is a series of its own, which keeps this one pass.
    """
    own = F.coalesce(F.concat(F.lit("s:"), "serie"), F.concat(F.lit("f:"), "distribution_id"))
    latest = _best(rows.withColumn("_series", own), ["ccaa_slug", "_series", "anio"],
                   [-F.col("mes"), F.col("distribution_id")])
    return latest.drop("_series")


def select_distributions(distributions: DataFrame) -> DataFrame:
    """All selection steps in their order."""
    kept = drop_excluded(drop_income(distributions))
    return latest_snapshots(with_period(drop_uuid_copies(one_format(kept))))


def with_year_override(rows: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Give rows of files without a time column the year known for their file.

    `columns` are the file's own headers; overrides hold one row per file.
    """
    from fiscalis.functions.text import clean_header

    headers = {str(c).strip().lower() for c in columns} | {clean_header(c) for c in columns}
    if "anio" in headers or headers & set(ref.YEAR_HEADERS):
        return rows
    years = overrides.where(F.col("year").isNotNull()).select(
        F.col("distribution_id").cast("string").alias("_id"), F.col("year").cast("int").alias("anio"))
    return rows.join(years, rows["distribution_id"].cast("string") == F.col("_id"), "left").drop("_id")

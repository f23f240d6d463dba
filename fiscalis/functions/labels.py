"""Labels of regions and chapters, and the small fixed dimensions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis import reference_data as ref


def lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def region_label(slug: Column, labels: dict[str, str] = ref.REGION_LABELS) -> Column:
    return F.coalesce(lookup(labels, slug), slug)


def chapter_label(chapter: Column) -> Column:
    number = chapter.cast("int")
    return F.coalesce(lookup(ref.CHAPTER_LABELS, number),
                      F.concat(F.lit("Cap."), number.cast("string")), F.lit("?"))


def dashboard_chapter(chapter: Column) -> Column:
    number = chapter.cast("int")
    return F.coalesce(lookup(ref.DASHBOARD_CHAPTERS, number), number.cast("string"), F.lit("—"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def region_dimension(spark: SparkSession) -> DataFrame:
    """dim_ccaa with the publishers of each region."""
    rows = ", ".join(
        f"({i}, {_text(slug)}, {_text(name)}, {_text(code)}, {_text(cover)}, "
        f"CAST(array({', '.join(map(_text, pubs))}) AS array<string>))"
        for i, (slug, name, code, cover, pubs) in enumerate(ref.REGIONS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(pos, slug, nombre, uri_nti, cobertura, publishers)")


def chapter_dimension(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, {_text(name)}, {_text(kind)})" for n, name, kind in ref.CHAPTERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(capitulo_id, nombre, tipo)")

"""Statistical cubes (PX) to long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.amounts import parse_amount
from fiscalis.functions.text import chapter_in_label, once, phase_from_indicator, phase_from_title


# Characters where a code page differs from ISO-8859-1.
LATIN_9 = ("\u00a4\u00a6\u00a8\u00b4\u00b8\u00bc\u00bd\u00be", "€ŠšŽžŒœŸ")
WINDOWS_1252 = ("".join(map(chr, [0x80, *range(0x82, 0x8d), 0x8e, *range(0x91, 0x9d), 0x9e, 0x9f])), "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")


def read_cubes(spark: SparkSession, paths) -> DataFrame:
    """(file, text) of the files that are text cubes, in their own code page:
    UTF-8, Windows-1252, ISO-8859-1, or ISO-8859-15 where none of these is named."""
    files = spark.read.format("binaryFile").load(paths)
    latin = F.decode("content", "ISO-8859-1")
    head = F.substring_index(latin, "DATA=", 1)
    page = F.lower(F.regexp_extract(head, r'(?i)CODEPAGE\s*=\s*"([^"]+)"', 1))
    raw = F.col("content").cast("string")
    text = (F.when(page.isin("utf-8", "utf8") & F.is_valid_utf8(raw), F.make_valid_utf8(raw))
            .when(page.isin("windows-1252", "cp1252", "1252"), F.translate(latin, *WINDOWS_1252))
            .when(page.isin("iso-8859-1", "latin1", "latin-1"), latin).otherwise(F.translate(latin, *LATIN_9)))
    start = F.regexp_replace(F.substring_index(head, "=", 1), r"^\s+", "")
    return files.where(start.startswith("AXIS") | start.startswith("CHARSET")).select(
        F.col("path").alias("file"), text.alias("text"))


def _after(text: Column, key: Column) -> Column:
    """The value of a keyword: what stands between `key=` and the semicolon."""
    start = F.position(key, text)
    rest = F.substring(text, start + F.length(key), F.length(text))
    return F.when(start > 0, F.substring_index(rest, ";", 1))


def _words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit('"([^"]*)"'), F.lit(1))


def long_cells(cubes: DataFrame) -> DataFrame:
    """(file, title, coords, data): one row per cell; `coords` maps the lower-case
    name of a dimension to the cell's value.

    Dimensions are ordered stub before heading and the last varies fastest, so
    a cell's position in mixed radix gives its coordinates.
    """
    text = F.concat(F.lit("\n"), F.regexp_replace("text", "\r", ""))

    def key(name: str) -> Column:
        return F.coalesce(_after(text, F.lit(f"\n{name}=")), F.lit(""))

    dims = F.concat(_words(key("STUB")), _words(key("HEADING")))
    heads = cubes.select(
        "file", text.alias("_t"), dims.alias("_dims"),
        F.concat_ws(" ", F.concat(_words(key("TITLE")), _words(key("CONTENTS")))).alias("title"),
        F.split(F.trim(F.regexp_replace(key("DATA"), r"\s+", " ")), " ").alias("_data"))
    values = F.transform("_dims", lambda d: _words(_after(
        F.col("_t"), F.concat(F.lit('\nVALUES("'), d, F.lit('")=')))))
    sized = heads.withColumn("_values", values).withColumn("_sizes", F.transform("_values", lambda v: F.size(v)))
    strides = F.transform("_sizes", lambda _, i: F.aggregate(
        F.slice(F.col("_sizes"), i + 2, F.size("_sizes")), F.lit(1), lambda a, s: a * s))
    cells = sized.withColumn("_strides", strides).select(
        "file", "title", "_dims", "_values", "_sizes", "_strides", F.posexplode("_data").alias("pos", "data"))
    coords = F.transform("_values", lambda v, i: F.get(v, (
        F.floor(F.col("pos") / F.get("_strides", i)) % F.get("_sizes", i)).cast("int")))
    names = F.transform("_dims", lambda d: F.lower(F.trim(d)))
    return cells.select("file", "title", F.map_from_arrays(names, coords).alias("coords"),
                        F.trim(F.col("data"), F.lit('"')).alias("data"))


def _role(coords: Column, names: list[str]) -> Column:
    """Value of the first dimension with one of the names."""
    return F.coalesce(*[F.try_element_at(coords, F.lit(n)) for n in names])


def shape_cells(cells: DataFrame) -> DataFrame:
    """Year, chapter, phase and amount of each cell. Other dimensions are
    dropped without aggregation; cells without amount, year or a known
    indicator are dropped."""
    coords = F.col("coords")
    has_indicator = F.arrays_overlap(F.map_keys(coords), F.array(*[F.lit(n) for n in ref.CUBE_INDICATOR]))
    roles = cells.select(
        "file", "title", "data", has_indicator.alias("_has"), _role(coords, ref.CUBE_INDICATOR).alias("_indicator"),
        F.trim(_role(coords, ref.CUBE_YEAR)).alias("_year"), _role(coords, ref.CUBE_CHAPTER).alias("_chapter"))
    cell = F.struct(
        once(F.col("_year"), lambda y: F.when(y.rlike(r"^\d+(\.0*)?$"), y.try_cast("double"))).try_cast("int").alias("anio"),
        chapter_in_label(F.col("_chapter")).alias("capitulo_id"),
        F.when(F.col("_has"), phase_from_indicator(F.col("_indicator"))).otherwise(
            phase_from_title(F.col("title"))).alias("fase"),
        parse_amount(F.col("data")).alias("importe_eur"))
    # A generator, unlike a filter on the results, computes them once.
    complete = F.filter(F.array(cell), lambda c: c["anio"].isNotNull() & c["fase"].isNotNull() & c["importe_eur"].isNotNull())
    return roles.select("file", F.inline(complete))

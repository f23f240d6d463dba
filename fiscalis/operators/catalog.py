"""Catalogue pages to classified, scored datasets and named files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.labels import lookup
from fiscalis.functions.text import first_match, last_segment


# --- fields of an API item -------------------------------------------------

def spanish_text(values: Column) -> Column:
    """The Spanish value of a language-tagged list, else its first value."""
    spanish = F.filter(values, lambda v: v["_lang"] == "es")
    return F.when(F.size(spanish) > 0, F.get(spanish, F.lit(0))["_value"]).otherwise(
        F.get(values, F.lit(0))["_value"])


def publisher_id(url: Column, identifier: Column | None = None) -> Column:
    """Last segment of a publisher URL, or the identifier of a publisher object."""
    return last_segment(url) if identifier is None else F.coalesce(last_segment(url), identifier)


def date_text(plain: Column, value: Column) -> Column:
    """A date given as an object with a value, or as a plain text."""
    return F.coalesce(value, plain)


def dataset_rows(items: DataFrame) -> DataFrame:
    """Catalogue rows of exploded API items (column `item` plus where it came
    from). Missing `_about` or title fall back to the identifier."""
    i = F.col("item")
    return items.select(
        "query_no", "page", "pos",
        F.coalesce(F.nullif(i["_about"], F.lit("")), i["identifier"]).alias("uri"),
        i["identifier"].alias("id"),
        F.coalesce(F.nullif(spanish_text(i["title"]), F.lit("")), F.nullif(i["identifier"], F.lit("")),
                   F.lit("")).alias("titulo"),
        spanish_text(i["description"]).alias("descripcion"),
        publisher_id(i["publisher"]).alias("publisher_id"),
        i["spatial"].alias("spatial"),
        i["issued"].alias("issued"),
        i["modified"].alias("modified"),
    )


# --- scoring and classification --------------------------------------------

def relevance(title: Column, description: Column) -> Column:
    """Sum of the weights of the keywords found in title and description."""
    text = F.concat(F.lower(F.coalesce(title, F.lit(""))),
                    F.coalesce(F.concat(F.lit(" "), F.lower(F.nullif(description, F.lit("")))), F.lit("")))
    return reduce(lambda a, b: a + b, [
        F.when(text.contains(word), weight).otherwise(0) for word, weight in ref.RELEVANCE.items()])


def region_of(publisher: Column, spatials: Column) -> Column:
    """Region of a dataset: known publisher, province inside a local-body code,
    provincial councils, spatial text, else the national node. The rules are
    fixed lists, so this is an expression and needs no join."""
    known = {p: slug for slug, _, _, _, publishers in ref.REGIONS for p in publishers}
    spatial_rules = [(code, slug) for slug, _, code, _, _ in ref.REGIONS]
    hits = F.filter(
        F.transform(spatials, lambda s: first_match(s, spatial_rules, lambda c, k: c.contains(k))),
        lambda slug: slug.isNotNull())
    return F.coalesce(
        lookup(known, publisher),
        F.when(publisher.startswith("L01") & (F.length(publisher) >= 5),
               lookup(ref.PROVINCES, F.substring(publisher, 4, 2))),
        F.when(publisher.startswith("L02"), F.lit("pais-vasco")),
        F.get(hits, F.lit(0)),
        F.lit("nacional"),
    )


def relevant_datasets(rows: DataFrame, min_score: int = ref.MIN_SCORE,
                      columns: list[str] | None = None) -> DataFrame:
    """First row per uri in crawl order, scored, at or above the minimum.

    The first row is a minimum, so copies of one uri combine map-side instead
    of meeting in one window partition. Texts are scored before the shuffle and
    travel only when `columns` asks for them.
    """
    crawl = ["query_no", "page", "pos"]
    kept = columns if columns is not None else [c for c in rows.columns if c not in ("uri", *crawl)]
    first = (
        rows.where(F.col("uri").isNotNull() & (F.col("uri") != ""))
        .withColumn("score_relevancia", relevance(F.col("titulo"), F.col("descripcion")))
        .groupBy("uri").agg(F.min(F.struct(*crawl, "score_relevancia", *kept)).alias("r"))
        .select("uri", *[F.col(f"r.{c}").alias(c) for c in [*kept, "score_relevancia"]])
    )
    return first.where(F.col("score_relevancia") >= min_score)


# --- distributions ---------------------------------------------------------

def format_code(media: Column) -> Column:
    text = F.lower(F.trim(media))
    return F.when(media.isNull() | (media == ""), F.lit("UNKNOWN")).otherwise(
        F.coalesce(lookup(ref.MEDIA_FORMATS, text), F.upper(F.substring_index(text, "/", -1))))


def format_text(value: Column, label: Column) -> Column:
    """What names the format where the catalogue gives an object: its value, else its label."""
    return F.coalesce(F.nullif(value, F.lit("")), F.nullif(label, F.lit("")))


def fetchable(distributions: DataFrame) -> DataFrame:
    """Distributions of a supported format with a url to fetch."""
    url = F.coalesce(F.nullif(F.col("access_url"), F.lit("")), F.nullif(F.col("download_url"), F.lit("")))
    return (
        distributions.withColumn("access_url", url)
        .where(F.col("formato").isin(*ref.SUPPORTED_FORMATS) & F.col("access_url").isNotNull())
    )


def safe_file_name(url: Column, dataset_id: Column) -> Column:
    """Sanitised dataset id, url hash and path tail."""
    owner = F.coalesce(F.nullif(dataset_id, F.lit("")), F.lit("unknown"))
    path = F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    tail = F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("data"))
    return F.concat_ws("__", F.regexp_replace(F.substring(owner, 1, 40), r'[\\/:*?"<>|]', "_"),
                       F.substring(F.md5(url), 1, 8), tail)


def short_id(uri: Column, dataset_id: Column) -> Column:
    return F.coalesce(F.nullif(last_segment(uri), F.lit("")), dataset_id)


def to_fetch(datasets: DataFrame, region: str | None = None, min_score: int = ref.MIN_SCORE,
             limit: int | None = None) -> DataFrame:
    """Datasets to fetch, best score first; `limit` makes it a top-k."""
    chosen = datasets.where(F.col("score_relevancia") >= min_score)
    if region is not None:
        chosen = chosen.where(F.col("ccaa_slug") == region)
    chosen = chosen.orderBy(F.col("score_relevancia").desc(), "uri")
    return chosen.limit(limit) if limit is not None else chosen


def score_histogram(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("score_relevancia").agg(F.count(F.lit(1)).alias("n"))


def formats_summary(distributions: DataFrame) -> DataFrame:
    return distributions.groupBy("formato").agg(
        F.count(F.lit(1)).alias("n"), F.sum("byte_size").cast("bigint").alias("bytes"))


def downloads_by_format(distributions: DataFrame) -> DataFrame:
    return distributions.groupBy("formato").agg(
        F.count(F.lit(1)).alias("n_distribuciones"),
        F.count("downloaded_at").alias("descargadas"),
    ).orderBy(F.col("n_distribuciones").desc(), "formato")

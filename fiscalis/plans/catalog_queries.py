"""Catalogue (CAT) and file-selection (SEL) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.operators import catalog as ca
from fiscalis.operators import selection as se
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.registry import query
from fiscalis.sources import sample_tables as st


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def choose(column: str, table: dict, default: str = "NULL") -> str:
    """A CASE over fixed values."""
    arms = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


NAME = """CASE {k} % 8 WHEN 0 THEN 'l01080193-base-' WHEN 1 THEN 'plan-estrategico-' WHEN 2 THEN 'ingresos-'
  WHEN 3 THEN 'presupuesto-inicial-gastos-' ELSE 'ejecucion-gastos-' END || CAST({k} AS VARCHAR)"""

CTES["items"] = f"""
SELECT CAST(doc_id % 5 AS INTEGER) AS query_no, CAST(doc_id // 50 AS INTEGER) AS page,
  CAST(doc_id % 50 AS INTEGER) AS pos, {text(st.DATASET_BASE)} || {NAME.format(k='(doc_id // 2)')} AS uri,
  'doc-' || doc_id AS id,
  CASE doc_id % 5 WHEN 0 THEN 'Liquidacion y ejecucion del presupuesto de gastos'
    WHEN 1 THEN 'Obligaciones reconocidas por capítulo' WHEN 2 THEN 'Credito definitivo, fases presupuestarias'
    WHEN 3 THEN 'Gastos' ELSE 'Memoria anual' END AS titulo,
  text AS descripcion,
  CASE doc_id % 6 WHEN 0 THEN 'http://datos.example/recurso/organismo/E05250001/'
    WHEN 1 THEN 'L01' || lpad(CAST(1 + (doc_id // 6) % 53 AS VARCHAR), 2, '0') || '0066'
    WHEN 2 THEN 'L02000020' WHEN 3 THEN 'http://datos.example/recurso/organismo/A13002908'
    WHEN 5 THEN 'X0001' END AS publisher,
  CASE doc_id % 4 WHEN 0 THEN 'http://datos.example/recurso/Autonomia/Pais-Vasco'
    WHEN 1 THEN 'http://datos.example/recurso/Autonomia/Comunidad-Madrid'
    WHEN 3 THEN 'http://datos.example/recurso/Provincia/Otra' END AS spatial, source
FROM documents"""

SEGMENT = "string_split(rtrim({c}, '/'), '/')[-1]"
KNOWN = {p: slug for slug, _, _, _, publishers in ref.REGIONS for p in publishers}
SPATIAL = "CASE " + " ".join(
    f"WHEN contains(spatial, {text(code)}) THEN {text(slug)}" for slug, _, code, _, _ in ref.REGIONS) + " END"
SCORE = " + ".join(
    f"CASE WHEN contains(lower(titulo || ' ' || descripcion), {text(k)}) THEN {w} ELSE 0 END"
    for k, w in ref.RELEVANCE.items())

CTES["classified"] = f"""
SELECT *, coalesce({choose('publisher_id', KNOWN)},
  CASE WHEN starts_with(publisher_id, 'L01') THEN {choose('substr(publisher_id, 4, 2)', ref.PROVINCES)} END,
  CASE WHEN starts_with(publisher_id, 'L02') THEN 'pais-vasco' END, {SPATIAL}, 'nacional') AS ccaa_slug
FROM (SELECT *, {SEGMENT.format(c='publisher')} AS publisher_id FROM items)"""
CTES["catalogue"] = f"""
SELECT uri, id, titulo, descripcion, publisher_id, spatial, ccaa_slug, source, {SCORE} AS score_relevancia
FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY query_no, page, pos) AS k FROM classified) WHERE k = 1"""

WORDS = "[" + ", ".join(text(m) for m in st.MONTH_WORDS) + "]"
CTES["file_names"] = f"""
SELECT DISTINCT l_suppkey AS k, CASE l_linenumber
  WHEN 1 THEN 'serie' || (l_suppkey % 5) || '-' || y || '-' || ({WORDS})[m]
  WHEN 2 THEN 'ejecucion_' || y || '_' || lpad(CAST(m AS VARCHAR), 2, '0') || '_gasto'
  WHEN 3 THEN 'eliminaciones_' || m || '_' || y
  WHEN 4 THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4)
    || '-' || substr(d, 21, 12)
  WHEN 5 THEN 'ejecucion_ingresos_' || y WHEN 6 THEN 'partidas-gasto-' || y
  ELSE 'Ejecucion.Gastos-' || y END AS resource,
  (['CSV', 'XLSX', 'JSON', 'XML', 'PDF'])[l_orderkey % 5 + 1] AS formato
FROM (SELECT *, year(o_orderdate) + 10 AS y, month(o_orderdate) AS m,
    md5(l_suppkey || '-' || (year(o_orderdate) + 10)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CTES["dist"] = f"""
SELECT md5(uri || '|' || resource || '|' || formato) AS distribution_id, uri AS dataset_uri, formato,
  'http://datos.example/file/' || resource AS access_url, CAST(length(resource) * 1000 + k AS BIGINT) AS byte_size,
  CASE WHEN fetched THEN 'raw/id' || k || '__' || substr(md5(resource || formato), 1, 8) || '__' || resource
    || '.' || lower(formato) END AS local_path,
  CASE WHEN fetched THEN '2024-01-01T00:00:00' END AS downloaded_at
FROM (SELECT *, {text(st.DATASET_BASE)} || {NAME.format(k='k')} AS uri,
  (k + length(formato)) % 4 <> 0 AS fetched FROM file_names)"""
CTES["local_dist"] = """
SELECT d.*, c.ccaa_slug,
  lower(regexp_replace(string_split(string_split(local_path, '/')[-1], '__')[-1],
    '\\.(csv|tsv|xlsx|xls|json|xml|px|rdf)$', '', 'i')) AS resource
FROM dist d JOIN catalogue c ON c.uri = d.dataset_uri WHERE local_path IS NOT NULL"""
INCOME = "(contains(lower({c}), 'ingreso') AND NOT contains(lower({c}), 'gasto'))"
CTES["spend_dist"] = (
    f"SELECT * FROM local_dist WHERE NOT {INCOME.format(c='dataset_uri')} AND NOT {INCOME.format(c='resource')}")
RULES = ", ".join(f"({text(r)}, {text(p)})" for r, parts in ref.EXCLUDED_DATASETS.items() for p in parts)
CTES["allowed_dist"] = f"""
SELECT * FROM spend_dist d WHERE NOT EXISTS (SELECT 1 FROM (VALUES {RULES}) AS r(region, part)
  WHERE r.region = d.ccaa_slug AND contains(d.dataset_uri, r.part))"""
CTES["one_format"] = f"""
SELECT * EXCLUDE (f) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_uri, resource
  ORDER BY {choose('formato', ref.FORMAT_RANK, '9')}, distribution_id) AS f FROM allowed_dist) WHERE f = 1"""
CTES["named_dist"] = f"""
SELECT * EXCLUDE (is_uuid, has_named) FROM (SELECT *, bool_or(NOT is_uuid) OVER (PARTITION BY dataset_uri) AS has_named
  FROM (SELECT *, regexp_matches(resource, {text(se.UUID)}) AS is_uuid FROM one_format))
WHERE NOT (is_uuid AND has_named)"""
MONTH_CASE = choose("regexp_extract(resource, '^(.*)-(\\d{4})-([a-záéíóúñ]+)$', 3)", ref.MONTHS)
YM = "(?:^|[_-])(20\\d{2})[_-](0?[1-9]|1[0-2])(?:[_-]|$)"
MY = "(?:^|[_-])(0?[1-9]|1[0-2])[_-](20\\d{2})(?:[_-]|$)"
YM_CUT = "(^|[_-])20\\d{2}[_-](?:0?[1-9]|1[0-2])([_-]|$)"
MY_CUT = "(^|[_-])(?:0?[1-9]|1[0-2])[_-]20\\d{2}([_-]|$)"
CTES["period_dist"] = f"""
SELECT * EXCLUDE (w, ym, my),
  CASE WHEN w IS NOT NULL THEN regexp_extract(resource, '^(.*)-(\\d{{4}})-', 1)
    WHEN ym THEN regexp_replace(resource, '{YM_CUT}', '|ym|\\2')
    WHEN my THEN regexp_replace(resource, '{MY_CUT}', '|my|\\2') END AS serie,
  CAST(CASE WHEN w IS NOT NULL THEN regexp_extract(resource, '^(.*)-(\\d{{4}})-', 2)
    WHEN ym THEN regexp_extract(resource, '{YM}', 1) WHEN my THEN regexp_extract(resource, '{MY}', 2) END
    AS INTEGER) AS anio,
  CAST(CASE WHEN w IS NOT NULL THEN CAST(w AS VARCHAR) WHEN ym THEN regexp_extract(resource, '{YM}', 2)
    WHEN my THEN regexp_extract(resource, '{MY}', 1) END AS INTEGER) AS mes
FROM (SELECT *, {MONTH_CASE} AS w, regexp_matches(resource, '{YM}') AS ym, regexp_matches(resource, '{MY}') AS my
  FROM named_dist)"""
CTES["chosen_dist"] = """
SELECT * FROM period_dist WHERE serie IS NULL UNION ALL BY NAME
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ccaa_slug, serie, anio
  ORDER BY mes DESC, distribution_id) AS k FROM period_dist WHERE serie IS NOT NULL) WHERE k = 1"""


# --- catalogue -------------------------------------------------------------

def nested_items(spark, sf):
    """The crawled rows as the API nests them."""
    def tagged(col):
        return F.array(F.struct(F.lit("en").alias("_lang"), F.lit("-").alias("_value")),
                       F.struct(F.lit("es").alias("_lang"), col.alias("_value")))

    rows = st.catalog_items(spark, sf)
    about = F.when(F.col("pos") % 3 != 0, F.col("uri")).otherwise(F.lit(""))
    return rows.select("query_no", "page", "pos", F.struct(
        about.alias("_about"), F.col("id").alias("identifier"), tagged(F.col("titulo")).alias("title"),
        tagged(F.col("descripcion")).alias("description"), F.col("publisher"),
        F.col("spatial"), F.lit("2024-01-01").alias("issued"), F.col("source").alias("modified")).alias("item"))


@query("cat01_item_rows", check("""
SELECT query_no, page, pos, CASE WHEN pos % 3 <> 0 THEN uri ELSE id END AS uri, id, titulo, md5(descripcion) AS descripcion,
  string_split(rtrim(publisher, '/'), '/')[-1] AS publisher_id, spatial, '2024-01-01' AS issued, source AS modified
FROM items"""))
def cat01(spark, sf):
    return ca.dataset_rows(nested_items(spark, sf)).withColumn("descripcion", F.md5("descripcion"))


@query("cat02_language_pick", check("""
SELECT id, CASE pos % 3 WHEN 0 THEN md5(descripcion) WHEN 1 THEN source END AS texto FROM items"""))
def cat02(spark, sf):
    def entry(lang, col):
        return F.struct(F.lit(lang).alias("_lang"), col.alias("_value"))

    kind = F.col("pos") % 3
    tags = (
        F.when(kind == 0, F.array(entry("en", F.col("source")), entry("es", F.col("descripcion"))))
        .when(kind == 1, F.array(entry("gl", F.col("source")), entry("en", F.col("descripcion")))))
    picked = ca.spanish_text(tags)
    return st.catalog_items(spark, sf).select(
        "id", F.when(kind == 0, F.md5(picked)).otherwise(picked).alias("texto"))


@query("cat03_publisher_id", check(f"SELECT id, {SEGMENT.format(c='publisher')} AS publisher_id FROM items"))
def cat03(spark, sf):
    return st.catalog_items(spark, sf).select("id", ca.publisher_id(F.col("publisher")).alias("publisher_id"))


@query("cat04_date_text", check("SELECT id, CASE WHEN pos % 2 = 0 THEN source ELSE titulo END AS fecha FROM items"))
def cat04(spark, sf):
    nested = F.when(F.col("pos") % 2 == 0, F.struct(F.col("source").alias("_value")))
    return st.catalog_items(spark, sf).withColumn("d", nested).select(
        "id", ca.date_text(F.col("titulo"), F.col("d._value")).alias("fecha"))


@query("cat05_relevance_score", check(f"SELECT id, {SCORE} AS score FROM items"))
def cat05(spark, sf):
    return st.catalog_items(spark, sf).select(
        "id", ca.relevance(F.col("titulo"), F.col("descripcion")).alias("score"))


@query("cat06_relevant_first", check(
    "SELECT uri, id, ccaa_slug, score_relevancia FROM catalogue WHERE score_relevancia >= 4"))
def cat06(spark, sf):
    datasets = st.catalog(spark, sf, ["id", "ccaa_slug"])
    return datasets.where(F.col("score_relevancia") >= ref.MIN_SCORE).select(
        "uri", "id", "ccaa_slug", "score_relevancia")


@query("cat07_region_of_dataset", check("SELECT id, ccaa_slug FROM classified"))
def cat07(spark, sf):
    spatials = F.when(F.col("spatial").isNotNull(), F.array("spatial"))
    return st.catalog_items(spark, sf).select(
        "id", ca.region_of(ca.publisher_id(F.col("publisher")), spatials).alias("ccaa_slug"))


MEDIA = ["text/csv", "application/vnd.ms-excel", "application/json", "text/xml", "application/x-pc-axis",
         "application/pdf", " Text/CSV ", "xlsx", ""]


def media(spark, sf):
    kinds = F.array(*[F.lit(m) for m in MEDIA], F.lit(None))
    return st.table(spark, sf, "pages").select(
        "page_id", "url", F.element_at(kinds, (F.col("page_id") % 10 + 1).cast("int")).alias("media"))


CTES["media"] = f"""
SELECT page_id, url, ([{', '.join(text(m) for m in MEDIA)}, NULL])[page_id % 10 + 1] AS media FROM pages"""
CODE = (f"CASE WHEN coalesce(media, '') = '' THEN 'UNKNOWN' ELSE coalesce("
        f"{choose('lower(trim(media))', ref.MEDIA_FORMATS)}, upper(string_split(lower(trim(media)), '/')[-1])) END")


@query("cat08_format_code", check(f"SELECT page_id, {CODE} AS formato FROM media"))
def cat08(spark, sf):
    return media(spark, sf).select("page_id", ca.format_code(F.col("media")).alias("formato"))


@query("cat08_format_objects", check(f"""
SELECT page_id, formato FROM (SELECT page_id, {CODE} AS formato FROM (SELECT page_id,
  CASE WHEN page_id % 4 = 0 THEN CASE WHEN media <> '' THEN media ELSE 'application/json' END
       WHEN page_id % 4 = 1 THEN 'Hoja XLSX' WHEN page_id % 4 = 2 THEN NULL ELSE media END AS media FROM media) AS media)"""))
def cat08_objects(spark, sf):
    """Formats given as an object with value and label, or as nothing at all."""
    i, plain = F.col("page_id"), F.col("media")
    value = F.when(i % 4 == 0, plain).when(i % 4 == 1, F.lit("")).when(i % 4 == 3, plain)
    label = F.when(i % 4 == 0, "application/json").when(i % 4 == 1, "Hoja XLSX").when(i % 4 == 2, "")
    items = media(spark, sf).select("page_id", F.struct(value.alias("value"), label.alias("label")).alias("format"))
    return items.select("page_id", ca.format_code(ca.format_text(F.col("format.value"), F.col("format.label"))).alias("formato"))


@query("cat09_fetchable", check(f"""
SELECT page_id, formato, access_url FROM (SELECT page_id, {CODE} AS formato,
  CASE WHEN page_id % 3 <> 0 THEN url WHEN page_id % 2 = 0 THEN upper(url) END AS access_url FROM media)
WHERE access_url IS NOT NULL AND formato IN ({', '.join(text(f) for f in ref.SUPPORTED_FORMATS)})"""))
def cat09(spark, sf):
    i = F.col("page_id")
    rows = media(spark, sf).select(
        "page_id", ca.format_code(F.col("media")).alias("formato"),
        F.when(i % 3 != 0, F.col("url")).alias("access_url"),
        F.when(i % 2 == 0, F.upper("url")).alias("download_url"))
    return ca.fetchable(rows).select("page_id", "formato", "access_url")


@query("cat10_safe_file_name", check("""
SELECT page_id, regexp_replace(substr('id:' || url, 1, 40), '[\\\\/:*?"<>|]', '_', 'g') || '__'
  || substr(md5(url), 1, 8) || '__'
  || coalesce(nullif(string_split(rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), '/')[-1], ''), 'data')
  AS nombre FROM pages"""))
def cat10(spark, sf):
    return st.table(spark, sf, "pages").select("page_id", ca.safe_file_name(
        F.col("url"), F.concat(F.lit("id:"), F.col("url"))).alias("nombre"))


@query("cat11_short_id", check("""
SELECT page_id, coalesce(nullif(string_split(rtrim(url, '/'), '/')[-1], ''), CAST(page_id AS VARCHAR)) AS short_id
FROM pages"""))
def cat11(spark, sf):
    return st.table(spark, sf, "pages").select(
        "page_id", ca.short_id(F.col("url"), F.col("page_id").cast("string")).alias("short_id"))


@query("cat12_datasets_to_fetch", check("""
SELECT uri, score_relevancia FROM catalogue WHERE ccaa_slug = 'pais-vasco' AND score_relevancia >= 4
ORDER BY score_relevancia DESC, uri LIMIT 20"""))
def cat12(spark, sf):
    return ca.to_fetch(st.catalog(spark, sf, ["ccaa_slug"]), "pais-vasco", limit=20).select("uri", "score_relevancia")


@query("cat13_score_histogram", check(
    "SELECT score_relevancia, count(*) AS n FROM catalogue GROUP BY 1"))
def cat13(spark, sf):
    return ca.score_histogram(st.catalog(spark, sf, []))


@query("cat13_top_scores", check("""
SELECT uri, titulo, score_relevancia FROM catalogue ORDER BY score_relevancia DESC, uri LIMIT 10"""))
def cat13_top(spark, sf):
    return ca.to_fetch(st.catalog(spark, sf, ["titulo"]), min_score=0, limit=10).select("uri", "titulo", "score_relevancia")


@query("cat14_formats", check(
    "SELECT formato, count(*) AS n, CAST(sum(byte_size) AS BIGINT) AS bytes FROM dist GROUP BY formato"))
def cat14(spark, sf):
    return ca.formats_summary(st.distributions(spark, sf))


# --- selection -------------------------------------------------------------

FILE = "distribution_id, dataset_uri, formato, ccaa_slug, resource"
FILE_COLS = ["distribution_id", "dataset_uri", "formato", "ccaa_slug", "resource"]


def with_resource(df):
    return df.withColumn("resource", se.resource_key(F.col("local_path")))


def staged(spark, sf):
    return se.one_format(se.drop_excluded(se.drop_income(st.local_files(spark, sf))))


@query("sel01_local_files", check("SELECT distribution_id, dataset_uri, formato, ccaa_slug FROM local_dist"))
def sel01(spark, sf):
    return st.local_files(spark, sf).select("distribution_id", "dataset_uri", "formato", "ccaa_slug")


@query("sel02_resource_key", check("""
SELECT distribution_id, lower(regexp_replace(string_split(string_split(local_path, '/')[-1], '__')[-1],
  '\\.(csv|tsv|xlsx|xls|json|xml|px|rdf)$', '', 'i')) AS resource FROM dist WHERE local_path IS NOT NULL"""))
def sel02(spark, sf):
    files = st.distributions(spark, sf).where(F.col("local_path").isNotNull())
    return with_resource(files).select("distribution_id", "resource")


@query("sel03_income_dropped", check(f"SELECT {FILE} FROM spend_dist"))
def sel03(spark, sf):
    return with_resource(se.drop_income(st.local_files(spark, sf))).select(*FILE_COLS)


@query("sel04_region_exclusions", check(f"SELECT {FILE} FROM allowed_dist"))
def sel04(spark, sf):
    return with_resource(se.drop_excluded(se.drop_income(st.local_files(spark, sf)))).select(*FILE_COLS)


@query("sel05_one_format", check(f"SELECT {FILE} FROM one_format"))
def sel05(spark, sf):
    return staged(spark, sf).select(*FILE_COLS)


@query("sel06_uuid_copies", check(f"SELECT {FILE} FROM named_dist"))
def sel06(spark, sf):
    return se.drop_uuid_copies(staged(spark, sf)).select(*FILE_COLS)


@query("sel07_period", check(f"SELECT {FILE}, serie, anio, mes FROM period_dist"))
def sel07(spark, sf):
    return se.with_period(se.drop_uuid_copies(staged(spark, sf))).select(*FILE_COLS, "serie", "anio", "mes")


@query("sel08_latest_snapshot", check(f"SELECT {FILE}, serie, anio, mes FROM chosen_dist"))
def sel08(spark, sf):
    return se.select_distributions(st.local_files(spark, sf)).select(*FILE_COLS, "serie", "anio", "mes")


@query("sel09_year_override", check("""
SELECT d.distribution_id, d.formato, CAST(2000 + length(dataset_uri) % 20 AS INTEGER) AS anio FROM dist d
WHERE length(dataset_uri) % 3 = 0
UNION ALL SELECT distribution_id, formato, NULL FROM dist WHERE length(dataset_uri) % 3 <> 0"""))
def sel09(spark, sf):
    files = st.distributions(spark, sf)
    size = F.length("dataset_uri")
    years = files.select("distribution_id", F.when(size % 3 == 0, 2000 + size % 20).alias("year"))
    rows = files.select("distribution_id", "formato")
    return se.with_year_override(rows, years, rows.columns)

"""Source (SRC) and sink (SNK) queries.

Queries about files first have Spark write the sample tables in the wanted
format to the shared folder and then read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.amounts import money_sum
from fiscalis.functions.labels import chapter_dimension, region_dimension
from fiscalis.operators import normalize as nz
from fiscalis.operators import sinks as sk
from fiscalis.plans.catalog_queries import nested_items, text
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.feature_queries import KEYS, features
from fiscalis.plans.model_queries import predictions, pretty
from fiscalis.plans.raw_queries import SUMMARY_SQL, TOTALS, budget_sheet, pick, sql_pick, summary
from fiscalis.plans.registry import query
from fiscalis.session import cut, scratch_path
from fiscalis.sources import cube as cu
from fiscalis.sources import delimited as dl
from fiscalis.sources import files as fi
from fiscalis.sources import lake as lk
from fiscalis.sources import nested as ne
from fiscalis.sources import sample_tables as st

def n_rows():
    return F.count(F.lit(1)).alias("n")


# --- delimited text ------------------------------------------------------------

def written_sheet(spark, sf) -> str:
    """The budget sheet as semicolon text files in UTF-8."""
    path = scratch_path(spark, "sheet")
    budget_sheet(spark, sf).fillna("s/d").write.option("header", "true").option("sep", ";").csv(path)
    return path


@query("src01_delimited_scan", check(f"SELECT {SUMMARY_SQL}, {TOTALS} FROM fact GROUP BY ALL"))
def src01(spark, sf):
    path = written_sheet(spark, sf)
    header = budget_sheet(spark, sf).columns
    rows = dl.read_delimited(spark, f"{path}/*.csv", [h.strip() for h in header], ";")
    return summary(nz.normalize(rows.drop("_file")))


@query("src02_encoding", check("""
SELECT encoding, sum(n) AS n, bool_and(igual) AS igual FROM (SELECT lang, count(*) AS n, true AS igual,
  CASE WHEN lang IN (SELECT lang FROM documents GROUP BY lang HAVING bool_or(regexp_matches(text, '[^\\x00-\\x7F]')))
  THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding FROM documents GROUP BY lang) GROUP BY encoding""").replace(
    "sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n"))
def src02(spark, sf):
    path = scratch_path(spark, "texts")
    one_line = F.regexp_replace("text", r"\s+", " ")
    docs = st.table(spark, sf, "documents").select("lang", "doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), one_line).alias("value"))
    docs.select("lang", "value").hint("rebalance", "lang").write.partitionBy("lang").text(path)
    # The texts of a language are one file in parts: they share the encoding.
    lines = fi.folder_lines(spark, path)
    both = lines.join(cut(spark, dl.encodings(lines), "encodings"), "file").select(
        "encoding", dl.decoded(F.col("line"), F.col("encoding")).alias("value"))
    back = both.select("encoding", F.substring_index("value", "\t", 1).cast("bigint").alias("doc_id"), F.md5("value").alias("h"))
    same = back.join(docs.select("doc_id", F.md5("value").alias("h0")), "doc_id")
    return same.groupBy("encoding").agg(n_rows(), F.bool_and(F.col("h") == F.col("h0")).alias("igual"))


CTES["doc_lines"] = "SELECT 'doc-' || doc_id AS file, unnest(string_split(text, chr(10))) AS line FROM documents"


def doc_lines(spark, sf):
    return st.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.explode(F.split("text", "\n")).alias("line"))


@query("src03_delimiter", check("""
SELECT file, CASE WHEN s > c THEN ';' WHEN t > c THEN chr(9) ELSE ',' END AS delimiter, quoted_breaks FROM (
  SELECT file, bool_or((length(line) - length(replace(line, '"', ''))) % 2 = 1) AS quoted_breaks, sum(length(line) - length(replace(line, ';', ''))) AS s, sum(length(line) - length(replace(line, ',', ''))) AS c,
    sum(length(line) - length(replace(line, chr(9), ''))) AS t FROM doc_lines GROUP BY file)"""))
def src03(spark, sf):
    return dl.delimiters(doc_lines(spark, sf))


def price_lines(spark, sf):
    """Semicolon lines, one file per supplier; a third European, a third Anglo,
    a third without any separator."""
    price, k = F.col("l_extendedprice"), F.col("l_suppkey") % 3
    anglo = F.format_number(price, 2)
    shown = F.when(k == 0, F.translate(anglo, ",.", ".,")).when(k == 1, F.concat(F.lit('"'), anglo, F.lit('"'))).otherwise(
        F.floor(price).cast("string"))
    return st.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), F.lit(";").alias("delimiter"),
        F.concat_ws(";", F.col("l_partkey").cast("string"), shown, F.lit("1.234"), F.col("l_returnflag")).alias("line"))


CTES["price_tokens"] = """
SELECT 'f' || l_suppkey AS file, CASE l_suppkey % 3 WHEN 0 THEN translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
  WHEN 1 THEN format('{:,.2f}', l_extendedprice) END AS token FROM lineitem WHERE l_suppkey % 3 < 2
UNION ALL SELECT 'f' || l_suppkey, '1.234' FROM lineitem"""


@query("src04_number_tokens", check("SELECT file, token, count(*) AS n FROM price_tokens GROUP BY ALL"))
def src04(spark, sf):
    return dl.number_tokens(price_lines(spark, sf)).groupBy("file", "token").agg(n_rows())


@query("src05_number_format", check("""
SELECT file, eu, anglo, CASE WHEN anglo > eu THEN '.' WHEN eu > anglo THEN ',' END AS decimal,
  CASE WHEN eu > anglo THEN '.' END AS thousands FROM (
  SELECT file, count(*) FILTER (regexp_matches(token, '^[\\d.]*,\\d{2}$')) AS eu,
    count(*) FILTER (regexp_matches(token, '^[\\d,]*\\.\\d{2}$')) AS anglo FROM price_tokens GROUP BY file)"""))
def src05(spark, sf):
    return dl.number_formats(dl.number_tokens(price_lines(spark, sf)))


MEMBERS = ["Gastos_{}.csv", "ingresos_{}.csv", "Partidas_{}.XLSX", "leeme_{}.txt", "otros_{}.xls", "ejecucion_{}.xlsx"]


def archive_members(spark, sf):
    """Archives of one supplier: which kinds of member they hold depends on it."""
    year, k, p = F.year("l_shipdate").cast("string"), F.col("l_suppkey"), F.col("l_partkey")
    holds = ((k % 3 == 0) | (p % 6 >= 2)) & ((k % 4 > 0) | (p % 6 > 0))
    name = F.when(holds, pick(MEMBERS, p)).otherwise("leeme_{}.txt")
    return st.table(spark, sf, "lineitem").select(
        F.concat(F.lit("zip"), k.cast("string")).alias("archive"), F.replace(name, F.lit("{}"), year).alias("member")).distinct()


@query("src06_archive_members", check(f"""
SELECT archive, member, member AS _zip_source FROM (SELECT *, min(r) OVER (PARTITION BY archive) AS best FROM (
  SELECT DISTINCT 'zip' || l_suppkey AS archive, replace({sql_pick(MEMBERS, 'l_partkey')}, '{{}}', CAST(year(l_shipdate) AS VARCHAR)) AS member,
    CASE WHEN (l_suppkey % 3 = 0 OR l_partkey % 6 >= 2) AND (l_suppkey % 4 > 0 OR l_partkey % 6 > 0) THEN
      CASE l_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 2 WHEN 4 THEN 3 END END AS r
  FROM lineitem) WHERE r IS NOT NULL)
WHERE r = best"""))
def src06(spark, sf):
    return fi.archive_members(archive_members(spark, sf))


@query("src07_json_records", check("""
SELECT "o_orderkey", "o_totalprice" AS "total.importe", strftime(o_orderdate, '%Y-%m-%d') AS "total.fecha" FROM orders"""))
def src07(spark, sf):
    """Documents of up to a hundred orders, listed under `data`."""
    path = scratch_path(spark, "json")
    record = F.struct("o_orderkey", F.struct(
        F.col("o_totalprice").alias("importe"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha")).alias("total"))
    docs = st.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("k")).agg(
        F.collect_list(record).alias("data"))
    docs.select(F.lit("1").alias("version"), "data").write.json(path)
    docs_schema = spark.read.schema("version string, data array<struct<o_orderkey: bigint, total: struct<importe: double, fecha: string>>>").json(path).schema
    path_to = ne.record_path(docs_schema)
    rows = spark.read.schema(docs_schema).json(path).select(F.explode(path_to[0]).alias("r")).select("r.*")
    return ne.flatten(rows)


@query("src08_flatten", check("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k", event_type AS "tipo.nombre" FROM events"""))
def src08(spark, sf):
    nested = st.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"), F.struct(F.col("event_type").alias("nombre")).alias("tipo"))
    return ne.flatten(nested)


@query("src09_tag_counts", check("""
SELECT page_id AS id, tag, count(*) AS n FROM (SELECT page_id, string_split(unnest(regexp_extract_all(
  regexp_replace(html, '<!--[\\s\\S]*?-->', '', 'g'), '<([A-Za-z_][\\w.:-]*)', 1)), ':')[-1] AS tag FROM pages) GROUP BY ALL"""))
def src09(spark, sf):
    return ne.tag_counts(pages(spark, sf)).select("id", "tag", "n")


def pages(spark, sf):
    return st.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))


@query("src09_row_tags", check("""
SELECT id, tag FROM (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS k FROM (
  SELECT page_id AS id, generate_subscripts(t, 1) AS place, string_split(unnest(t), ':')[-1] AS tag FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--[\\s\\S]*?-->', '', 'g'), '<([A-Za-z_][\\w.:-]*)', 1) AS t FROM pages))
  GROUP BY id, tag HAVING count(*) >= 2 AND min(place) > 1) WHERE k = 1"""))
def src09_tags(spark, sf):
    return ne.row_tags(ne.tag_counts(pages(spark, sf)))


@query("src09_xml_rows", check("""
SELECT o_orderkey, o_custkey AS "@cliente", round(o_totalprice, 2) AS importe FROM orders"""))
def src09_xml(spark, sf):
    path = scratch_path(spark, "xml")
    rows = st.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("@cliente"), "o_orderkey", F.round("o_totalprice", 2).alias("importe"))
    rows.write.format("xml").option("rootTag", "pedidos").option("rowTag", "pedido").option("attributePrefix", "@").save(path)
    return ne.read_xml(spark, path, "pedido").select("o_orderkey", "@cliente", "importe")


def cells(spark, sf):
    """A cell table: five cells a row, some empty, some numeric."""
    k = F.col("l_partkey")
    cell = [F.struct(F.when((k + i) % 3 > 0, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("valor"),
                     ((k + i * i) % 4 > 0).alias("es_texto")) for i in range(5)]
    return st.table(spark, sf, "lineitem").select(
        F.concat(F.lit("libro"), F.col("l_suppkey").cast("string")).alias("file"),
        F.concat(F.lit("hoja"), F.col("l_linenumber").cast("string")).alias("sheet"),
        (2 + F.col("l_orderkey") % 12).cast("int").alias("fila"), F.array(*cell).alias("celdas"))


FILLED = " + ".join(f"CASE WHEN (l_partkey + {i}) % 3 > 0 THEN 1 ELSE 0 END" for i in range(5))
WORDY = " + ".join(f"CASE WHEN (l_partkey + {i}) % 3 > 0 AND (l_partkey + {i * i}) % 4 > 0 THEN 1 ELSE 0 END" for i in range(5))


@query("src10_header_rows", check(f"""
SELECT file, sheet, coalesce(min(fila) FILTER (filled >= 3 AND words >= filled * 0.6 AND fila < 10), 0) AS header FROM (
  SELECT 'libro' || l_suppkey AS file, 'hoja' || l_linenumber AS sheet, CAST(2 + l_orderkey % 12 AS INTEGER) AS fila,
    {FILLED} AS filled, {WORDY} AS words FROM lineitem) GROUP BY ALL"""))
def src10(spark, sf):
    return fi.header_rows(cells(spark, sf))


YEARS = list(range(1995, 2002))


def cubes(spark, sf):
    """One cube per region: chapter × indicator × year, written from the facts."""
    keys = [f"{c}{p}{y}" for c in range(1, 10) for p in ("PRE", "OBR") for y in YEARS]
    cell = F.concat(F.col("capitulo_id").cast("string"), "fase", F.col("anio").cast("string"))
    amounts = st.facts(spark, sf).where(F.col("capitulo_id").isNotNull() & F.col("fase").isin("PRE", "OBR")).groupBy(
        "ccaa_slug", cell.alias("cell")).agg(money_sum(F.col("importe_eur")).alias("importe"))
    # At most one row per cell key reaches a region's list.
    totals = amounts.groupBy("ccaa_slug").agg(F.map_from_entries(F.collect_list(
        F.struct("cell", F.format_string("%.2f", "importe")))).alias("m"))
    shown = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit('".."')))
    chapters = ",".join(f'"Cap. {c} Gastos"' for c in range(1, 10))
    head = ('CHARSET="ANSI";\nAXIS-VERSION="2000";\nCODEPAGE="utf-8";\nTITLE="Gastos por capítulo";\nSTUB="Capítulo","Indicadores";\n'
            'HEADING="Período";\nVALUES("Capítulo")=' + chapters + ';\n'
            'VALUES("Indicadores")="Presupuesto inicial","Obligaciones reconocidas";\nVALUES("Período")='
            + ",".join(f'"{y}"' for y in YEARS) + ";\nDATA=\n")
    return totals.select("ccaa_slug", F.concat(F.lit(head), F.concat_ws(" ", shown), F.lit(";")).alias("value"))


CUBE_CELLS = """SELECT ccaa_slug, anio, capitulo_id, fase, CAST(sum(importe_eur) AS DOUBLE) AS importe_eur FROM fact
WHERE capitulo_id IS NOT NULL AND fase IN ('PRE', 'OBR') GROUP BY ALL"""


@query("src11_cube_files", check(CUBE_CELLS))
def src11(spark, sf):
    path = scratch_path(spark, "cubes")
    cubes(spark, sf).repartition("ccaa_slug").write.partitionBy("ccaa_slug").option("lineSep", "\n").text(path)
    found = cu.shape_cells(cu.long_cells(cu.read_cubes(spark, f"{path}/ccaa_slug=*/*.txt")))
    return found.select(F.regexp_extract("file", r"ccaa_slug=([^/]+)", 1).alias("ccaa_slug"), "anio", "capitulo_id", "fase", "importe_eur")


@query("src12_cube_shape", check("""
SELECT ccaa_slug AS file, anio, capitulo_id, CASE fase WHEN 'PAG' THEN 'PAG' WHEN 'CRE' THEN 'CRE' ELSE 'OBR' END AS fase,
  count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM fact WHERE fase <> 'PRE' GROUP BY ALL"""))
def src12(spark, sf):
    label = (
        F.when(F.col("fase") == "PAG", "Pagos realizados").when(F.col("fase") == "CRE", "Crédito Definitivo")
        .when(F.col("fase") == "OBR", "Obligaciones reconocidas").otherwise("Número de entidades"))
    coords = F.create_map(
        F.lit("ejercicio"), F.col("anio").cast("string"), F.lit("capitulo"),
        F.concat(F.lit("Capítulo "), F.col("capitulo_id").cast("string")), F.lit("indicador"), label, F.lit("isla"), F.col("entidad_id"))
    rows = st.facts(spark, sf).select(
        F.col("ccaa_slug").alias("file"), F.lit("Liquidación").alias("title"), coords.alias("coords"),
        F.col("importe_eur").cast("string").alias("data"))
    return cu.shape_cells(rows).groupBy("file", "anio", "capitulo_id", "fase").agg(n_rows(), money_sum(F.col("importe_eur")).alias("importe"))


@query("src13_reader_routes", check("""
SELECT formato, extension, contenido, CASE
  WHEN formato = 'CSV' AND contenido IN ('{', '<') AND extension = 'px' THEN 'cube'
  WHEN formato = 'CSV' THEN 'delimited'
  WHEN formato = 'JSON' AND contenido <> '{' AND extension = 'csv' THEN 'delimited'
  WHEN formato = 'JSON' AND contenido <> '{' AND extension = 'px' THEN 'cube'
  WHEN formato = 'JSON' THEN 'json'
  WHEN formato = 'XML' AND contenido <> '<' AND extension = 'csv' THEN 'delimited'
  WHEN formato = 'XML' AND contenido <> '<' AND extension = 'px' THEN 'cube'
  WHEN formato = 'XML' THEN 'xml' WHEN extension = 'csv' THEN 'delimited' WHEN extension = 'px' THEN 'cube' END AS reader, n
FROM (SELECT (['CSV', 'JSON', 'XML', 'PDF'])[l_partkey % 4 + 1] AS formato, (['csv', 'px', 'dat'])[l_suppkey % 3 + 1] AS extension,
  (['a', '{', '<'])[l_linenumber % 3 + 1] AS contenido, count(*) AS n FROM lineitem GROUP BY ALL)"""))
def src13(spark, sf):
    rows = st.table(spark, sf, "lineitem").groupBy(
        pick(["CSV", "JSON", "XML", "PDF"], F.col("l_partkey")).alias("formato"),
        pick(["csv", "px", "dat"], F.col("l_suppkey")).alias("extension"),
        pick(["a", "{", "<"], F.col("l_linenumber")).alias("contenido")).agg(n_rows())
    path = F.concat(F.lit("raw/f."), F.upper("extension"))
    first = F.concat(F.lit("  "), F.col("contenido"), F.lit("..."))
    return rows.withColumn("reader", fi.reader_for(F.lower("formato"), path, first))


@query("src13_routed_files", check("""
SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS importe
FROM lineitem GROUP BY l_returnflag"""))
def src13_files(spark, sf):
    """Each return flag in a format of its own, read through the routes."""
    rows = st.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("string").alias("importe"))
    path = scratch_path(spark, "routes")
    rows.where(F.col("l_returnflag") == "A").write.option("header", "true").option("sep", ";").csv(f"{path}/CSV")
    rows.where(F.col("l_returnflag") == "N").write.json(f"{path}/JSON")
    rows.where(~F.col("l_returnflag").isin("A", "N")).write.format("xml").option("rootTag", "r").option("rowTag", "fila").save(f"{path}/XML")
    lines = fi.file_lines(spark, [f"{path}/CSV", f"{path}/JSON", f"{path}/XML"])
    code = F.regexp_extract("file", "/(CSV|JSON|XML)/", 1)
    files = fi.first_lines(lines).select(F.col("file").alias("path"), fi.reader_for(code, F.col("file"), F.col("first")).alias("reader"))
    readers = {
        "delimited": lambda s, paths: dl.union_groups(dl.read_folder(s, paths)).drop("_file"),
        "json": lambda s, paths: s.read.schema("l_returnflag string, importe string").json(paths),
        "xml": lambda s, paths: s.read.format("xml").option("rowTag", "fila").schema("l_returnflag string, importe string").load(paths),
    }
    found = fi.read_routed(spark, files, readers)
    return found.groupBy("l_returnflag").agg(n_rows(), money_sum(F.col("importe")).alias("importe"))


# --- the lake --------------------------------------------------------------------

def fact_lake(spark, sf) -> str:
    path = scratch_path(spark, "facts")
    sk.write_by_year(st.facts(spark, sf), path)
    return path


@query("src14_partitioned_scan", check("""
SELECT ccaa_slug, anio, fase, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM fact
WHERE ccaa_slug IN ('nation_1', 'nation_2') AND anio >= 1998 AND fase <> 'PAG' GROUP BY ALL"""))
def src14(spark, sf):
    wanted = F.col("ccaa_slug").isin("nation_1", "nation_2") & (F.col("anio") >= 1998) & (F.col("fase") != "PAG")
    return lk.read_partitioned(spark, fact_lake(spark, sf), wanted, st.facts(spark, sf).schema).groupBy("ccaa_slug", "anio", "fase").agg(
        n_rows(), money_sum(F.col("importe_eur")).alias("importe"))


@query("src15_feature_store", check(f"SELECT {KEYS}, PRE, obr_lag_1 FROM feat WHERE ccaa_slug = 'nation_4'"))
def src15(spark, sf):
    path = scratch_path(spark, "store")
    sk.write_by_year(features(spark, sf), path)
    return lk.read_regions(spark, path, "nation_4").select(*KEYS.split(", "), "PRE", "obr_lag_1")


@query("src16_glob_scan", check("""
SELECT ccaa_slug, count(*) AS filas, min(anio) AS anio_min, max(anio) AS anio_max FROM fact
WHERE ccaa_slug LIKE 'nation_1%' GROUP BY ccaa_slug"""))
def src16(spark, sf):
    return lk.curated_summary(lk.read_glob(spark, fact_lake(spark, sf), "ccaa_slug=nation_1*/anio=*"))


@query("src17_fact_read", check("SELECT * FROM fact WHERE ccaa_slug = 'nation_3' AND anio = 1999"))
def src17(spark, sf):
    return lk.read_facts(st.facts(spark, sf), "nation_3", 1999)


@query("src18_table_reads", check("""
SELECT 'prediccion' AS tabla, count(*) AS n FROM pred WHERE ccaa_slug = 'nation_8' UNION ALL
SELECT 'features', count(*) FROM feat WHERE ccaa_slug = 'nation_8' UNION ALL
SELECT 'dim', count(*) FROM nation WHERE lower(n_name) = 'nation_8'"""))
def src18(spark, sf):
    dim = st.table(spark, sf, "nation").select(F.lower("n_name").alias("slug"))
    parts = {"prediccion": lk.read_table(predictions(spark, sf), "nation_8"),
             "features": lk.read_table(features(spark, sf), "nation_8"), "dim": lk.read_table(dim, "nation_8", "slug")}
    counts = [df.agg(n_rows()).select(F.lit(name).alias("tabla"), "n") for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("src19_numeric_coercion", check("""
SELECT c_custkey AS id, c_name, c_acctbal AS saldo, CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS mixto,
  CAST(c_nationkey AS DOUBLE) AS pais FROM customer"""))
def src19(spark, sf):
    key = F.col("c_custkey")
    mixed = F.when(key % 9 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    texts = st.table(spark, sf, "customer").select(
        key.alias("id"), "c_name", F.col("c_acctbal").cast("string").alias("saldo"), mixed.alias("mixto"),
        F.col("c_nationkey").cast("string").alias("pais"))
    return lk.coerce_numeric(texts)


@query("src20_curated_summary", check("""
SELECT ccaa_slug, count(*) AS filas, min(anio) AS anio_min, max(anio) AS anio_max FROM fact GROUP BY ccaa_slug"""))
def src20(spark, sf):
    return lk.summary_from_footers(spark, fact_lake(spark, sf), st.facts(spark, sf).schema)


@query("src21_file_manifest")
def src21(spark, sf):
    return fi.manifest(spark, sf)


DIM = ", ".join(f"({text(s)}, {text(n)}, {text(u)}, {text(c)}, {len(p)})" for s, n, u, c, p in ref.REGIONS)


@query("src22_region_table", check(f"""
SELECT slug, nombre, uri_nti, cobertura, publicadores, coalesce(n, 0) AS proveedores
FROM (VALUES {DIM}) AS t(slug, nombre, uri_nti, cobertura, publicadores)
LEFT JOIN (SELECT {sql_pick([r[0] for r in ref.REGIONS], 's_nationkey')} AS slug, count(*) AS n FROM supplier GROUP BY 1) USING (slug)"""))
def src22(spark, sf):
    owners = st.table(spark, sf, "supplier").groupBy(
        pick([r[0] for r in ref.REGIONS], F.col("s_nationkey")).alias("slug")).agg(n_rows())
    return region_dimension(spark).join(owners, "slug", "left").select(
        "slug", "nombre", "uri_nti", "cobertura", F.size("publishers").alias("publicadores"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("proveedores"))


def monthly(spark, sf):
    lines = st.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_tax")
    orders = st.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("src23_cumulative_by_year", check("""
SELECT exercici, "capitol codi", CAST(sum(p) AS DOUBLE) AS "credits inicials", CAST(sum(c) AS DOUBLE) AS "pressupost definitiu"
FROM (SELECT *, max(m) OVER (PARTITION BY exercici) AS last FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS exercici, CAST(l_partkey % 12 AS INTEGER) AS "capitol codi", month(o_orderdate) AS m,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_tax AS DECIMAL(18,2)) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '%URGENT%') WHERE "capitol codi" BETWEEN 1 AND 9)
WHERE m = last GROUP BY ALL"""))
def src23(spark, sf):
    rows = monthly(spark, sf).select(
        F.year("o_orderdate").cast("string").alias("exercici"), F.date_format("o_orderdate", "MM - MMMM").alias("mes"),
        (F.col("l_partkey") % 12).cast("string").alias("cap_tol_codi"), F.substring_index("o_orderpriority", "-", -1).alias("entitat"),
        F.col("l_extendedprice").alias("ini"), F.col("l_tax").alias("def"))
    return lk.cumulative_by_year(rows, {"ini": "credits inicials", "def": "pressupost definitiu"}, "URGENT")


@query("src24_cumulative_by_file", check("""
SELECT anio, capitulo, CAST(sum(p) AS DOUBLE) AS "credito inicial" FROM (SELECT *, max(m) OVER (PARTITION BY anio) AS last FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS anio, CAST(l_partkey % 10 AS INTEGER) AS capitulo, month(o_orderdate) AS m,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
WHERE m = last AND capitulo BETWEEN 1 AND 9 GROUP BY ALL"""))
def src24(spark, sf):
    rows = monthly(spark, sf).select(
        F.year("o_orderdate").cast("int").alias("anio"), F.month("o_orderdate").cast("string").alias("ac_mes"),
        F.concat(F.lit("G"), (F.col("l_partkey") % 10).cast("string")).alias("cd_cap"), F.col("l_extendedprice").alias("ini"))
    return lk.cumulative_by_file(rows, {"ini": "credito inicial"})


@query("src25_api_pages", check("""
SELECT id, titulo, md5(descripcion) AS descripcion FROM items"""))
def src25(spark, sf):
    """Catalogue rows written as API pages (fifty items a file) and read back."""
    path = scratch_path(spark, "api")
    items = nested_items(spark, sf)
    pages = items.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("i")).select(
        F.struct(F.transform("i", lambda x: x["item"]).alias("items")).alias("result"))
    pages.write.option("maxRecordsPerFile", 1).json(path)
    found = fi.api_items(spark, path, pages.schema)
    from fiscalis.operators.catalog import spanish_text
    return found.select(F.col("item.identifier").alias("id"), spanish_text(F.col("item.title")).alias("titulo"),
                        F.md5(spanish_text(F.col("item.description"))).alias("descripcion"))


# --- sinks ---------------------------------------------------------------------------

FACT_SUM = """SELECT ccaa_slug, anio, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM fact GROUP BY ALL"""


def fact_sum(df):
    return df.groupBy("ccaa_slug", "anio").agg(n_rows(), money_sum(F.col("importe_eur")).alias("importe"))


@query("snk01_write_table", check(FACT_SUM))
def snk01(spark, sf):
    path, fact = scratch_path(spark, "table"), st.facts(spark, sf)
    sk.write_table(fact, path)
    return fact_sum(spark.read.schema(fact.schema).parquet(path))


@query("snk02_write_by_year", check(FACT_SUM))
def snk02(spark, sf):
    return fact_sum(spark.read.parquet(fact_lake(spark, sf)))


@query("snk03_replace_regions", check(f"""
SELECT ccaa_slug, anio, count(*) AS n, CAST(sum(CASE WHEN ccaa_slug < 'nation_2' THEN importe_eur ELSE importe_eur * 2 END) AS DOUBLE) AS importe
FROM fact GROUP BY ALL"""))
def snk03(spark, sf):
    path, fact = scratch_path(spark, "regions"), st.facts(spark, sf)
    sk.replace_regions(fact, path)
    later = fact.where(F.col("ccaa_slug") >= "nation_2").withColumn("importe_eur", (F.col("importe_eur") * 2).cast("decimal(18,2)"))
    sk.replace_regions(later, path)
    return fact_sum(spark.read.schema(fact.schema).parquet(path))


def keyed_orders(spark, sf):
    """Orders by a key that repeats and is sometimes missing."""
    k = F.col("o_orderkey")
    return st.table(spark, sf, "orders").select(
        F.when(k % 11 > 0, k % 5000).alias("clave"), F.col("o_custkey").alias("sub"), k.alias("orden"), F.col("o_totalprice").alias("importe"))


CTES["keyed"] = """
SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 5000 END AS clave, o_custkey AS sub, o_orderkey AS orden,
  o_totalprice AS importe FROM orders"""


@query("snk04_insert_or_ignore", check("""
SELECT * FROM keyed WHERE orden % 3 = 0 UNION ALL SELECT * FROM keyed WHERE orden % 3 > 0 AND clave IS NULL
UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY clave, sub ORDER BY orden) AS k FROM keyed n
  WHERE orden % 3 > 0 AND clave IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.orden % 3 = 0 AND o.clave = n.clave AND o.sub = n.sub)) WHERE k = 1"""))
def snk04(spark, sf):
    rows = keyed_orders(spark, sf)
    return sk.insert_or_ignore(rows.where(F.col("orden") % 3 == 0), rows.where(F.col("orden") % 3 > 0), ["clave", "sub"], ["orden"])


@query("snk05_upsert", check("""
SELECT sub, orden, importe FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY orden % 2 DESC, orden DESC) AS k FROM (
  SELECT sub, max(orden) AS orden, arg_max(importe, orden) AS importe FROM keyed GROUP BY sub, orden % 2)) WHERE k = 1"""))
def snk05(spark, sf):
    rows = keyed_orders(spark, sf).select("sub", "orden", "importe")
    old = rows.where(F.col("orden") % 2 == 0).groupBy("sub").agg(F.max(F.struct("orden", "importe")).alias("r")).select("sub", "r.*")
    return sk.upsert(old, rows.where(F.col("orden") % 2 == 1), "sub", ["orden"])


@query("snk06_fill_dimension", check("""
SELECT CAST(n AS VARCHAR) AS entidad_id, 'Entidad ' || n AS nombre, 'ayuntamiento' AS tipo FROM (SELECT DISTINCT c_nationkey % 6 AS n FROM customer)
UNION ALL SELECT DISTINCT entidad_id, '(sin catalogar)', 'desconocido' FROM fact
WHERE entidad_id IS NOT NULL AND entidad_id NOT IN (SELECT CAST(c_nationkey % 6 AS VARCHAR) FROM customer)"""))
def snk06(spark, sf):
    ids = st.table(spark, sf, "customer").select((F.col("c_nationkey") % 6).cast("string").alias("entidad_id")).distinct()
    dim = ids.select("entidad_id", F.concat(F.lit("Entidad "), F.col("entidad_id")).alias("nombre"), F.lit("ayuntamiento").alias("tipo"))
    return sk.fill_dimension(dim, st.facts(spark, sf), "entidad_id", "entidad_id", {"nombre": "(sin catalogar)", "tipo": "desconocido"})


@query("snk07_null_orphans", check("""
SELECT uri, CASE WHEN publisher_id IN (""" + ", ".join(f"'{p}'" for *_, codes in ref.REGIONS for p in codes) + """)
  THEN publisher_id END AS publisher_id FROM catalogue"""))
def snk07(spark, sf):
    known = region_dimension(spark).select(F.explode("publishers").alias("publisher_id"))
    rows = st.catalog(spark, sf, ["publisher_id"]).select("uri", "publisher_id")
    return sk.null_orphans(rows, "publisher_id", known, "publisher_id")


def serving_tables(spark, sf):
    regions = region_dimension(spark)
    publishers = regions.select(F.explode("publishers").alias("publisher_id"), F.col("slug").alias("ccaa_slug"))
    entities = st.table(spark, sf, "customer").select(
        (F.col("c_custkey") % 7).cast("string").alias("entidad_id"), F.concat(F.lit("r"), (F.col("c_custkey") % 7).cast("string")).alias("ccaa_slug")).distinct()
    groups = st.table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("grupo_funcional_id")).where(
        F.col("grupo_funcional_id") <= "3").distinct()
    return {
        "dim_ccaa": regions.select("slug"), "dim_publisher": publishers, "dim_entidad": entities,
        "dim_capitulo_economico": chapter_dimension(spark), "dim_capitulo_funcional": groups,
        "catalog_dataset": cut(spark, st.catalog(spark, sf, ["publisher_id", "ccaa_slug"]), "catalog"), "catalog_distribution": st.distributions(spark, sf),
        "fact_prediccion": predictions(spark, sf), "fact_ejecucion": st.facts(spark, sf),
    }


ORPHANS = {
    "fk_publisher_ccaa": ("SELECT 'x' AS v WHERE false", "SELECT '1'"),
    "fk_entidad_ccaa": ("SELECT DISTINCT 'r' || (c_custkey % 7) AS v FROM customer", "SELECT slug FROM dim_region"),
    "fk_dataset_publisher": ("SELECT publisher_id AS v FROM catalogue", "SELECT * FROM (VALUES "
                             + ", ".join(f"({text(p)})" for r in ref.REGIONS for p in r[4]) + ")"),
    "fk_dataset_ccaa": ("SELECT ccaa_slug AS v FROM catalogue", "SELECT slug FROM dim_region"),
    "fk_distribution_dataset": ("SELECT dataset_uri AS v FROM dist", "SELECT uri FROM catalogue"),
    "fk_pred_ccaa": ("SELECT ccaa_slug AS v FROM pred", "SELECT slug FROM dim_region"),
    "fk_pred_entidad": ("SELECT entidad_id AS v FROM pred", "SELECT CAST(c_custkey % 7 AS VARCHAR) FROM customer"),
    "fk_pred_capitulo": ("SELECT capitulo_id AS v FROM pred", "SELECT range FROM range(1, 10)"),
    "fk_fact_ccaa": ("SELECT ccaa_slug AS v FROM fact", "SELECT slug FROM dim_region"),
    "fk_fact_entidad": ("SELECT entidad_id AS v FROM fact", "SELECT CAST(c_custkey % 7 AS VARCHAR) FROM customer"),
    "fk_fact_capitulo": ("SELECT capitulo_id AS v FROM fact", "SELECT range FROM range(1, 10)"),
    "fk_fact_gfunc": ("SELECT grupo_funcional_id AS v FROM fact", "SELECT * FROM (VALUES ('1'), ('2'), ('3'))"),
    "fk_fact_dataset": ("SELECT dataset_uri AS v FROM fact", "SELECT uri FROM catalogue"),
}


@query("snk08_orphan_counts", check("SELECT *, CASE WHEN huerfanos > 0 THEN 'NOT VALID' ELSE 'VALID' END AS estado FROM (" + " UNION ALL ".join(
    f"SELECT {text(fk)} AS fk, count(*) AS huerfanos FROM ({child}) c WHERE v IS NOT NULL AND v NOT IN ({parent})"
    for fk, (child, parent) in ORPHANS.items()) + ")"))
def snk08(spark, sf):
    return sk.orphan_counts(spark, serving_tables(spark, sf))


@query("snk09_replace_table", check(FACT_SUM))
def snk09(spark, sf):
    path, fact = scratch_path(spark, "refresh"), st.facts(spark, sf)
    name = "refreshed_" + path.rsplit("-", 1)[-1]
    sk.replace_table(fact.where(F.col("anio") < 1998).withColumn("old", F.lit(1)), name, path)
    sk.replace_table(fact, name, path)
    stored = spark.read.schema(spark.table(name).schema).parquet(path)
    spark.sql(f"DROP TABLE {name}")  # its files stay: it is an external table
    return fact_sum(stored)


@query("snk10_load_if_empty", check(FACT_SUM))
def snk10(spark, sf):
    path, fact = scratch_path(spark, "once"), st.facts(spark, sf)
    sk.load_if_empty(spark, fact, path)
    sk.load_if_empty(spark, fact, path)
    return fact_sum(spark.read.schema(fact.schema).parquet(path))


@query("snk11_prediction_ids", check("""
SELECT row_number() OVER (ORDER BY ccaa_slug, anio, importe_real, round(importe_predicho, 2), entidad_id NULLS LAST, capitulo_id NULLS LAST) AS pred_id,
  ccaa_slug, anio, importe_real, entidad_id, CAST(capitulo_id AS SMALLINT) AS capitulo_id FROM pred"""))
def snk11(spark, sf):
    from fiscalis.operators.modeling import with_prediction_ids

    table = pretty(cut(spark, predictions(spark, sf), "predictions"), {"importe_predicho": 2})
    return with_prediction_ids(table).select("pred_id", "ccaa_slug", "anio", "importe_real", "entidad_id", "capitulo_id")


@query("snk12_destination_gaps", check("""
SELECT 'fact' AS tabla, '' AS faltan, '' AS sobran, true AS ok, count(*) AS filas FROM fact UNION ALL
SELECT 'sin_fase', 'fase', '', false, count(*) FROM fact UNION ALL SELECT 'con_extra', '', 'extra', true, count(*) FROM fact"""))
def snk12(spark, sf):
    fact = st.facts(spark, sf)
    shapes = {"fact": fact, "sin_fase": fact.drop("fase"), "con_extra": fact.withColumn("extra", F.lit(1))}
    gaps = sk.destination_gaps(spark, {name: (df, ref.FACT_COLUMNS) for name, df in shapes.items()})
    return gaps.withColumn("filas", fact.agg(n_rows()).scalar())


@query("snk13_metrics_export", check("""
SELECT ccaa_slug, modelo, CAST(n AS INTEGER) AS n, round(mae, 4) AS mae FROM scores"""))
def snk13(spark, sf):
    from fiscalis.plans.model_queries import candidate_scores

    path = scratch_path(spark, "metrics")
    sk.export_csv(pretty(candidate_scores(spark, sf), {"mae": 4}).select("ccaa_slug", "modelo", "n", "mae"), path)
    return spark.read.schema("ccaa_slug string, modelo string, n int, mae double").option("header", "true").csv(path)

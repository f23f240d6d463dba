"""Budget tables derived from the star-schema sample tables.

Each function reads whole Parquet tables and shapes them as one of the engine's
canonical inputs, so that every operator can be run and checked on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis.functions.amounts import MONEY
from fiscalis.session import cut

REGION_COUNT = 25
CORE = [f"nation_{i}" for i in range(REGION_COUNT) if i % 6 != 5]
BUDGET_ONLY = [f"nation_{i}" for i in range(REGION_COUNT) if i % 6 == 5]


# Declared schemas: no footer is opened to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order date and the buyer's nation. The order side
    is completed first, so the line items are shuffled once. Both sides grow
    with the data, so they are merged: neither may be broadcast."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    header = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "o_orderpriority", "c_custkey", "n_nationkey", "n_name")
    )
    return table(spark, sf_dir, "lineitem").hint("merge").join(header, F.col("l_orderkey") == F.col("o_orderkey"))


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line with the canonical keys and a column per phase."""
    n, price = F.col("n_nationkey"), F.col("l_extendedprice").cast("decimal(12,2)")
    rate = {c: F.col(c).cast("decimal(4,2)") for c in ("l_tax", "l_discount")}
    spent = (F.col("l_linestatus") == "F") & (n % 6 != 5)
    obr = price * (1 - rate["l_discount"])
    return ordered_lines(spark, sf_dir).select(
        F.lower("n_name").alias("ccaa_slug"),
        F.when(n % 3 != 0, (F.col("c_custkey") % 10).cast("string")).alias("entidad_id"),
        F.year("o_orderdate").cast("int").alias("anio"),
        F.when(n % 2 == 0, F.quarter("o_orderdate").cast("int")).alias("trimestre"),
        F.when(n % 5 != 4, (1 + F.col("l_partkey") % 9).cast("int")).alias("capitulo_id"),
        F.when(n % 4 == 0, F.substring("o_orderpriority", 1, 1)).alias("grupo_funcional_id"),
        F.concat(F.lit("ds/"), (F.col("l_suppkey") % 5).cast("string")).alias("dataset_uri"),
        price.cast(MONEY).alias("PRE"),
        F.when(n % 7 != 6, (price * (1 + rate["l_tax"])).cast(MONEY)).alias("CRE"),
        F.when(spent, obr.cast(MONEY)).alias("OBR"),
        F.when(spent & (F.col("l_returnflag") == "R"), obr.cast(MONEY)).alias("PAG"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long fact table: all phases from a single scan and join."""
    keys = ["ccaa_slug", "entidad_id", "anio", "trimestre", "capitulo_id", "grupo_funcional_id", "dataset_uri"]
    long = wide_lines(spark, sf_dir).unpivot(keys, ["PRE", "CRE", "OBR", "PAG"], "fase", "importe_eur")
    return long.where(F.col("importe_eur").isNotNull())


# --- catalogue -------------------------------------------------------------

DATASET_BASE = "http://datos.example/catalog/dataset/"
MONTH_WORDS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
               "septiembre", "octubre", "noviembre", "diciembre"]


def _dataset_name(k):
    kind = k % 8
    return F.concat(
        F.when(kind == 0, "l01080193-base-").when(kind == 1, "plan-estrategico-").when(kind == 2, "ingresos-")
        .when(kind == 3, "presupuesto-inicial-gastos-").otherwise("ejecucion-gastos-"),
        k.cast("string"))


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows as crawled: two per dataset, whole documents as text."""
    i = F.col("doc_id")
    title = (
        F.when(i % 5 == 0, "Liquidacion y ejecucion del presupuesto de gastos")
        .when(i % 5 == 1, "Obligaciones reconocidas por capítulo")
        .when(i % 5 == 2, "Credito definitivo, fases presupuestarias")
        .when(i % 5 == 3, "Gastos").otherwise("Memoria anual"))
    publisher = (
        F.when(i % 6 == 0, "http://datos.example/recurso/organismo/E05250001/")
        .when(i % 6 == 1, F.concat(F.lit("L01"), F.lpad((1 + F.floor(i / 6) % 53).cast("string"), 2, "0"),
                                   F.lit("0066")))
        .when(i % 6 == 2, "L02000020")
        .when(i % 6 == 3, "http://datos.example/recurso/organismo/A13002908")
        .when(i % 6 == 5, "X0001"))
    spatial = (
        F.when(i % 4 == 0, "http://datos.example/recurso/Autonomia/Pais-Vasco")
        .when(i % 4 == 1, "http://datos.example/recurso/Autonomia/Comunidad-Madrid")
        .when(i % 4 == 3, "http://datos.example/recurso/Provincia/Otra"))
    return table(spark, sf_dir, "documents").select(
        (i % 5).cast("int").alias("query_no"), F.floor(i / 50).cast("int").alias("page"),
        (i % 50).cast("int").alias("pos"),
        F.concat(F.lit(DATASET_BASE), _dataset_name(F.floor(i / 2))).alias("uri"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("id"),
        title.alias("titulo"), F.col("text").alias("descripcion"),
        publisher.alias("publisher"), spatial.alias("spatial"), F.col("source"),
    )


def catalog(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The classified catalogue (every score kept)."""
    from fiscalis.operators import catalog as ca

    rows = catalog_items(spark, sf_dir).withColumn("publisher_id", ca.publisher_id(F.col("publisher")))
    spatials = F.when(F.col("spatial").isNotNull(), F.array("spatial"))
    rows = rows.withColumn("ccaa_slug", ca.region_of(F.col("publisher_id"), spatials))
    return ca.relevant_datasets(rows, min_score=0, columns=columns)


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published files: one per dataset, resource and format. As in practice
    the list is a stored table."""
    k, year = F.col("l_suppkey"), (F.year("o_orderdate") + 10).cast("string")
    month, line = F.month("o_orderdate"), F.col("l_linenumber")
    word = F.element_at(F.array(*[F.lit(m) for m in MONTH_WORDS]), month)
    digest = F.md5(F.concat(k.cast("string"), F.lit("-"), year))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    resource = (
        F.when(line == 1, F.concat(F.lit("serie"), (k % 5).cast("string"), F.lit("-"), year, F.lit("-"), word))
        .when(line == 2, F.concat(F.lit("ejecucion_"), year, F.lit("_"), F.lpad(month.cast("string"), 2, "0"),
                                  F.lit("_gasto")))
        .when(line == 3, F.concat(F.lit("eliminaciones_"), month.cast("string"), F.lit("_"), year))
        .when(line == 4, uuid)
        .when(line == 5, F.concat(F.lit("ejecucion_ingresos_"), year))
        .when(line == 6, F.concat(F.lit("partidas-gasto-"), year))
        .otherwise(F.concat(F.lit("Ejecucion.Gastos-"), year)))
    code = F.element_at(F.array(*[F.lit(f) for f in ("CSV", "XLSX", "JSON", "XML", "PDF")]),
                        (F.col("l_orderkey") % 5 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    names = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        k.alias("k"), resource.alias("resource"), code.alias("formato")).distinct()
    kk, fetched = F.col("k"), (F.col("k") + F.length("formato")) % 4 != 0
    uri = F.concat(F.lit(DATASET_BASE), _dataset_name(kk))
    path = F.concat(F.lit("raw/id"), kk.cast("string"), F.lit("__"),
                    F.substring(F.md5(F.concat("resource", "formato")), 1, 8), F.lit("__"),
                    F.col("resource"), F.lit("."), F.lower("formato"))
    listed = names.select(
        F.md5(F.concat_ws("|", uri, "resource", "formato")).alias("distribution_id"),
        uri.alias("dataset_uri"), "formato",
        F.concat(F.lit("http://datos.example/file/"), F.col("resource")).alias("access_url"),
        (F.length("resource") * 1000 + kk).cast("bigint").alias("byte_size"),
        F.when(fetched, path).alias("local_path"),
        F.when(fetched, F.lit("2024-01-01T00:00:00")).alias("downloaded_at"),
    )
    return cut(spark, listed, "distributions")


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fiscalis.operators import selection as se

    return se.local_distributions(distributions(spark, sf_dir), catalog(spark, sf_dir, ["ccaa_slug"]))

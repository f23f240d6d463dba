"""Expression (EXP), normalisation (NRM) and validation (VAL) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions import amounts as am
from fiscalis.functions import labels as lb
from fiscalis.functions import text as tx
from fiscalis.operators import normalize as nz
from fiscalis.operators import quality as qa
from fiscalis.operators import sinks as sk
from fiscalis.plans.analytics_queries import cap_label, dash_label
from fiscalis.plans.catalog_queries import choose, text
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.feature_queries import KEYS, features
from fiscalis.plans.model_queries import pretty
from fiscalis.plans.registry import query
from fiscalis.session import cut
from fiscalis.sources import sample_tables as st

def n_rows():
    return F.count(F.lit(1)).alias("n")


def pick(values, index):
    """The value at a position of a literal list (None allowed)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index):
    shown = ", ".join("NULL" if v is None else text(v) for v in values)
    return f"([{shown}])[{index} % {len(values)} + 1]"


# --- expressions -------------------------------------------------------------

@query("exp01_slugify", check("""
SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'),
  '[^a-zA-Z0-9]+', '-', 'g'), '-'))) AS slug FROM documents"""))
def exp01(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", F.md5(tx.slugify(F.col("text"))).alias("slug"))


@query("exp02_fold_accents", check("SELECT doc_id, md5(strip_accents(text)) AS plano FROM documents"))
def exp02(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("plano"))


@query("exp03_chapter_digit", check("""
SELECT code, TRY_CAST(d AS INTEGER) AS capitulo_id, n FROM (SELECT *, CASE WHEN regexp_extract(code, '(\\d)', 1)
  BETWEEN '1' AND '9' THEN regexp_extract(code, '(\\d)', 1) END AS d
FROM (SELECT 'G' || (l_partkey % 25) AS code, count(*) AS n FROM lineitem GROUP BY 1))"""))
def exp03(spark, sf):
    code = F.concat(F.lit("G"), (F.col("l_partkey") % 25).cast("string"))
    return st.table(spark, sf, "lineitem").groupBy(code.alias("code")).agg(n_rows()).select(
        "code", tx.chapter_digit(F.col("code")).alias("capitulo_id"), "n")


LABELS = ["Presupuesto inicial", "CREDITO DEFINITIVO", "Autorizaciones de gasto", "fase a previa", "Disposiciones",
          "Compromisos", "Obligaciones reconocidas netas", "Obl. reconocidas", "Pagos líquidos", "pago realizado",
          "PRESUPUESTO_EJECUTADO", "INGRESOS_GASTOS_LIQUIDOS", "INGRESOS_GASTOS_LIQUIDOS_CORRIENTE", "OBR",
          "Crédito inicial", "Presupuesto  definitivo", None, "otra"]
PHASE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(texto), {text(p)}) THEN {text(code)}" for p, code in ref.PHASE_PATTERNS) + " END"


@query("exp04_phase_from_text", check(f"""
SELECT texto, {PHASE_SQL} AS fase, n
FROM (SELECT {sql_pick(LABELS, 'l_partkey')} AS texto, count(*) AS n FROM lineitem GROUP BY 1)"""))
def exp04(spark, sf):
    return st.table(spark, sf, "lineitem").groupBy(pick(LABELS, F.col("l_partkey")).alias("texto")).agg(n_rows()).select(
        "texto", tx.phase_from_text(F.col("texto")).alias("fase"), "n")


@query("exp05_parse_year", check("""
SELECT texto, CASE WHEN regexp_matches(substr(texto, 1, 4), '^\\s*[+-]?\\d+\\s*$')
  AND TRY_CAST(trim(substr(texto, 1, 4)) AS INTEGER) BETWEEN 1980 AND 2100
  THEN TRY_CAST(trim(substr(texto, 1, 4)) AS INTEGER) END AS anio, n
FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN year(o_orderdate) || '.0'
  WHEN 2 THEN right(CAST(year(o_orderdate) AS VARCHAR), 2) WHEN 3 THEN CAST(year(o_orderdate) - 17 AS VARCHAR)
  WHEN 4 THEN 'año ' || year(o_orderdate) END AS texto, count(*) AS n FROM orders GROUP BY 1)"""))
def exp05(spark, sf):
    year, k = F.year("o_orderdate"), F.col("o_orderkey") % 6
    shown = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, F.concat(year.cast("string"), F.lit(".0")))
        .when(k == 2, F.substring(year.cast("string"), 3, 2)).when(k == 3, (year - 17).cast("string"))
        .when(k == 4, F.concat(F.lit("año "), year.cast("string"))))
    return st.table(spark, sf, "orders").groupBy(shown.alias("texto")).agg(n_rows()).select(
        "texto", tx.parse_year(F.col("texto")).alias("anio"), "n")


# Chapter spellings and what they mean.
CHAPTERS = {"10000": 1, "7": 7, "1 GASTOS DE PERSOAL": 1, "0": None, "-3": None, "G_1": None, "4.0": 4, "62": 6,
            "22 Bienes": 2, "": None, "9E2": 9, " 5 ": 5, "012": None, "08 Activos": 8}


@query("exp06_parse_chapter", check(f"""
SELECT texto, CAST({choose('texto', {k: v for k, v in CHAPTERS.items() if v})} AS INTEGER) AS capitulo_id, n
FROM (SELECT {sql_pick([*CHAPTERS, None], 'l_partkey')} AS texto, count(*) AS n FROM lineitem GROUP BY 1)"""))
def exp06(spark, sf):
    return st.table(spark, sf, "lineitem").groupBy(pick([*CHAPTERS, None], F.col("l_partkey")).alias("texto")).agg(
        n_rows()).select("texto", tx.parse_chapter(F.col("texto")).alias("capitulo_id"), "n")


@query("exp07_chapter_in_label", check("""
SELECT texto, TRY_CAST(nullif(regexp_extract(texto, '\\b([1-9])\\b', 1), '') AS INTEGER) AS capitulo_id, n
FROM (SELECT 'Cap. ' || (l_partkey % 14) || ' Gastos' AS texto, count(*) AS n FROM lineitem GROUP BY 1)"""))
def exp07(spark, sf):
    shown = F.concat(F.lit("Cap. "), (F.col("l_partkey") % 14).cast("string"), F.lit(" Gastos"))
    return st.table(spark, sf, "lineitem").groupBy(shown.alias("texto")).agg(n_rows()).select(
        "texto", tx.chapter_in_label(F.col("texto")).alias("capitulo_id"), "n")


@query("exp08_as_smallint", check("""
SELECT texto, CASE k WHEN 0 THEN CAST(v AS SMALLINT) WHEN 1 THEN CAST(v AS SMALLINT) END AS capitulo_id, n
FROM (SELECT l_linenumber % 4 AS k, l_partkey % 9 AS v, CASE l_linenumber % 4 WHEN 0 THEN (l_partkey % 9) || '.0'
  WHEN 1 THEN CAST(l_partkey % 9 AS VARCHAR) WHEN 2 THEN 'cap ' || (l_partkey % 9) END AS texto, count(*) AS n
  FROM lineitem GROUP BY ALL)"""))
def exp08(spark, sf):
    k, v = F.col("l_linenumber") % 4, (F.col("l_partkey") % 9)
    shown = (
        F.when(k == 0, F.concat(v.cast("string"), F.lit(".0"))).when(k == 1, v.cast("string"))
        .when(k == 2, F.concat(F.lit("cap "), v.cast("string"))))
    rows = st.table(spark, sf, "lineitem").groupBy(k.alias("k"), v.alias("v"), shown.alias("texto")).agg(n_rows())
    return rows.select("texto", tx.as_smallint(F.col("texto")).alias("capitulo_id"), "n")


@query("exp09_parse_amount", check("""
SELECT l_linenumber AS variante, count(v) AS n, CAST(sum(v) AS DOUBLE) AS importe
FROM (SELECT l_linenumber, CASE WHEN l_linenumber NOT IN (5, 6) THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS v
  FROM lineitem) GROUP BY l_linenumber"""))
def exp09(spark, sf):
    price, k = F.col("l_extendedprice"), F.col("l_linenumber")
    anglo = F.format_number(price, 2)
    euro = F.translate(anglo, ",.", ".,")
    shown = (
        F.when(k == 1, euro).when(k == 2, anglo).when(k == 3, F.concat(F.lit("€ "), euro))
        .when(k == 4, F.concat(euro, F.lit(" EUR"))).when(k == 5, pick(["-", "s/d", "N/A", " "], F.col("l_partkey")))
        .when(k == 6, F.concat(anglo, F.lit(" miles"))).otherwise(price.cast("string")))
    rows = st.table(spark, sf, "lineitem").select(k.alias("variante"), am.parse_amount(shown).alias("v"))
    return rows.groupBy("variante").agg(F.count("v").alias("n"), am.money_sum(F.col("v")).alias("importe"))


@query("exp10_euro_labels", check("""
SELECT o_orderkey, CASE WHEN v IS NULL THEN '—' WHEN v >= 1e9 THEN format('{:,.1f} B€', v / 1e9)
  WHEN v >= 1e6 THEN format('{:,.0f} M€', v / 1e6) WHEN v >= 1e3 THEN format('{:,.0f} k€', v / 1e3)
  ELSE format('{:,.0f} €', v) END AS importe,
  CASE WHEN v IS NULL THEN '—' ELSE format('{:.1f}%', (o_orderkey / 777.0::DOUBLE) * 100) END AS porcentaje
FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice / 100000 WHEN 2 THEN o_totalprice
  WHEN 3 THEN o_totalprice * 100 WHEN 4 THEN o_totalprice * 100000 ELSE o_totalprice * 10 END AS v FROM orders)"""))
def exp10(spark, sf):
    k, price = F.col("o_orderkey") % 7, F.col("o_totalprice")
    value = (
        F.when(k == 0, F.lit(None)).when(k == 1, price / 100000).when(k == 2, price).when(k == 3, price * 100)
        .when(k == 4, price * 100000).otherwise(price * 10))
    share = F.when(value.isNotNull(), F.col("o_orderkey") / F.lit(777.0))
    return st.table(spark, sf, "orders").select(
        "o_orderkey", am.euro_label(value).alias("importe"), am.percent_label(share).alias("porcentaje"))


@query("exp11_p_labels", check("""
SELECT k, CASE WHEN p IS NULL THEN '—' WHEN p < 1e-4 THEN format('{:.2e}', p) ELSE format('{:.4f}', p) END AS p,
  CASE WHEN m >= 1000 THEN format('{:.0f}MM€', m / 1000) ELSE format('{:.0f}M€', m) END AS meur, n
FROM (SELECT *, CASE WHEN k % 5 > 0 THEN pow(0.5, k) END AS p, k * 123.25::DOUBLE AS m
  FROM (SELECT CAST(o_orderkey % 40 AS INTEGER) AS k, count(*) AS n FROM orders GROUP BY 1))"""))
def exp11(spark, sf):
    k = F.col("k")
    p = F.when(k % 5 > 0, F.pow(F.lit(0.5), k))
    rows = st.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).cast("int").alias("k")).agg(n_rows())
    return rows.select("k", am.p_label(p).alias("p"), am.million_label(k * F.lit(123.25)).alias("meur"), "n")


SLUGS = [r[0] for r in ref.REGIONS]


@query("exp12_labels", check(f"""
SELECT slug, cap, coalesce({choose('slug', ref.REGION_LABELS)}, slug) AS ccaa,
  coalesce({cap_label('cap')}, 'Cap.' || cap, '?') AS capitulo,
  CASE WHEN cap BETWEEN 1 AND 9 THEN {dash_label('cap')} ELSE coalesce(CAST(cap AS VARCHAR), '—') END AS panel, n
FROM (SELECT {sql_pick(SLUGS, 'c_nationkey')} AS slug,
  CASE WHEN c_custkey % 13 > 0 THEN CAST(c_custkey % 12 AS INTEGER) END AS cap, count(*) AS n FROM customer GROUP BY ALL)"""))
def exp12(spark, sf):
    cap = F.when(F.col("c_custkey") % 13 > 0, (F.col("c_custkey") % 12).cast("int"))
    rows = st.table(spark, sf, "customer").groupBy(pick(SLUGS, F.col("c_nationkey")).alias("slug"), cap.alias("cap")).agg(n_rows())
    return rows.select(
        "slug", "cap", lb.region_label(F.col("slug")).alias("ccaa"), lb.chapter_label(F.col("cap")).alias("capitulo"),
        lb.dashboard_chapter(F.col("cap")).alias("panel"), "n")


@query("exp13_season", check(f"""
SELECT {KEYS}, round(sin(2 * pi() * coalesce(trimestre, 0) / 4.0), 6) + 0.0::DOUBLE AS q_sin,
  round(cos(2 * pi() * coalesce(trimestre, 0) / 4.0), 6) + 0.0::DOUBLE AS q_cos FROM feat"""))
def exp13(spark, sf):
    return pretty(features(spark, sf).select(*KEYS.split(", "), "q_sin", "q_cos"), {"q_sin": 6, "q_cos": 6})


@query("exp14_safe_ratio", check("""
SELECT o_orderkey, round(o_totalprice / nullif(o_orderkey % 3, 0), 6) AS r FROM orders"""))
def exp14(spark, sf):
    r = am.ratio(F.col("o_totalprice"), (F.col("o_orderkey") % 3).cast("double"))
    return st.table(spark, sf, "orders").select("o_orderkey", F.round(r, 6).alias("r"))


@query("exp15_clip", check("""
SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN least(greatest(c_acctbal, -100.5::DOUBLE), 2000.25::DOUBLE) END AS v FROM customer"""))
def exp15(spark, sf):
    balance = F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal"))
    return st.table(spark, sf, "customer").select("c_custkey", am.clip(balance, -100.5, 2000.25).alias("v"))


@query("exp16_log_round_trip", check("""
SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS l, round(exp(ln(1 + abs(c_acctbal))) - 1, 4) AS v FROM customer"""))
def exp16(spark, sf):
    log = F.log1p(F.abs("c_acctbal"))
    return st.table(spark, sf, "customer").select("c_custkey", F.round(log, 6).alias("l"), F.round(F.expm1(log), 4).alias("v"))


CHAPTER_ROWS = ", ".join(f"({n}, {text(name)}, {text(kind)})" for n, name, kind in ref.CHAPTERS)


@query("exp17_spend_kind", check(f"""
SELECT ccaa_slug, f.capitulo_id, CASE WHEN f.capitulo_id IN (1, 2, 3, 4) THEN 'corriente'
  WHEN f.capitulo_id IN (6, 7) THEN 'capital' END AS clase, tipo, count(*) AS n
FROM fact f LEFT JOIN (VALUES {CHAPTER_ROWS}) AS d(capitulo_id, nombre, tipo) USING (capitulo_id) GROUP BY ALL"""))
def exp17(spark, sf):
    counts = st.facts(spark, sf).groupBy("ccaa_slug", "capitulo_id").agg(n_rows())
    dim = lb.chapter_dimension(spark).select("capitulo_id", "tipo")
    return counts.join(dim, "capitulo_id", "left").select(
        "ccaa_slug", "capitulo_id", am.spend_kind(F.col("capitulo_id")).alias("clase"), "tipo", "n")


@query("exp18_month_number", check("""
SELECT mes, CAST(substr(mes, 1, 2) AS INTEGER) AS numero, n FROM (
  SELECT strftime(o_orderdate, '%m') || ' - ' || year(o_orderdate) AS mes, count(*) AS n FROM orders GROUP BY 1)"""))
def exp18(spark, sf):
    month = F.concat(F.date_format("o_orderdate", "MM"), F.lit(" - "), F.year("o_orderdate").cast("string"))
    return st.table(spark, sf, "orders").groupBy(month.alias("mes")).agg(n_rows()).select(
        "mes", tx.month_number(F.col("mes")).alias("numero"), "n")


@query("exp19_load_time")
def exp19(spark, sf):
    return sk.with_load_time(st.facts(spark, sf).groupBy("ccaa_slug").agg(n_rows()))


# --- normalisation -------------------------------------------------------------

def euro(col):
    return F.translate(F.format_number(col, 2), ",.", ".,")


SUMMARY = ["ccaa_slug", "entidad_id", "anio", "capitulo_id", "fase", "dataset_uri"]
SUMMARY_SQL = ", ".join(SUMMARY)
TOTALS = "count(*) AS n, CAST(sum(CAST(importe_eur AS DECIMAL(18,2))) AS DOUBLE) AS importe"


def summary(facts):
    return facts.groupBy(*SUMMARY).agg(n_rows(), am.money_sum(F.col("importe_eur")).alias("importe"))


ORIGIN = ["ccaa_slug", "dataset_uri"]


def budget_sheet(spark, sf):
    """The lines as a regional sheet: own headers, European amounts, chapter codes."""
    chapter = F.col("capitulo_id").cast("string")
    return st.wide_lines(spark, sf).select(
        *ORIGIN, F.col("anio").cast("string").alias("Ejercicio"),
        F.when(F.col("capitulo_id") % 2 == 0, F.concat(chapter, F.lit("0000"))).otherwise(
            F.concat(chapter, F.lit(" GASTOS"))).alias(" Capítulo  Económico"),
        F.col("entidad_id").alias("Territorio"), euro(F.col("PRE")).alias("Crédito Inicial"),
        F.concat(euro(F.col("CRE")), F.lit(" €")).alias("Crédito Definitivo"),
        euro(F.col("OBR")).alias("Obligaciones Reconocidas Netas"), euro(F.col("PAG")).alias("Pagos Líquidos"))


@query("nrm01_clean_label", check("""
SELECT doc_id, md5(regexp_replace(lower(strip_accents(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(173), ''))),
  '\\s+', ' ', 'g')) AS etiqueta FROM documents"""))
def nrm01(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", F.md5(tx.clean_label(F.col("text"))).alias("etiqueta"))


@query("nrm02_header_dialect", check(f"SELECT {SUMMARY_SQL}, {TOTALS} FROM fact GROUP BY ALL"))
def nrm02(spark, sf):
    return summary(nz.normalize(budget_sheet(spark, sf)))


@query("nrm03_first_of_equal_headers", check(f"SELECT {SUMMARY_SQL}, {TOTALS} FROM fact WHERE fase = 'PRE' GROUP BY ALL"))
def nrm03(spark, sf):
    sheet = budget_sheet(spark, sf)
    doubled = sheet.select(
        *ORIGIN, F.col("Ejercicio").alias("Año"), F.lit("1900").alias("Exercici"), " Capítulo  Económico", "Territorio",
        "Crédito Inicial", F.lit("1,00").alias("Prev. Inicial"))
    return summary(nz.normalize(doubled))


STATES = ["PRESUPUESTO_INICIAL", "PRESUPUESTO_DEFINITIVO", "PRESUPUESTO_EJECUTADO", "INGRESOS_GASTOS_LIQUIDOS_CERRADOS"]
STATE_PHASE = {"PRESUPUESTO_INICIAL": "PRE", "PRESUPUESTO_DEFINITIVO": "CRE", "PRESUPUESTO_EJECUTADO": "OBR"}


def sdmx(spark, sf):
    cents = (F.col("PRE") * 100).cast("bigint")
    part = (
        F.when(cents % 5 == 0, "GASTOS").when(cents % 5 == 1, "G_10")
        .otherwise(F.concat(F.lit(" g_"), F.coalesce(F.col("capitulo_id"), F.lit(0)).cast("string"))))
    return st.wide_lines(spark, sf).select(
        *ORIGIN, F.col("anio").cast("string").alias("TIME_PERIOD"), F.col("PRE").cast("string").alias("OBS_VALUE"),
        pick(STATES, cents).alias("PRESUPUESTO_ESTADO"), F.col("entidad_id").alias("TERRITORIO"),
        F.when(cents % 3 == 0, "PORCENTAJE").otherwise("Importe_Presupuestario").alias("MEDIDAS"), part.alias("PRESUPUESTO_PARTIDA"))


CTES["sdmx"] = f"""
SELECT *, CAST(PRE * 100 AS BIGINT) AS cents, PRE AS importe_eur,
  {choose(sql_pick(STATES, 'CAST(PRE * 100 AS BIGINT)'), STATE_PHASE)} AS fase FROM wide_lines"""


@query("nrm04_sdmx_measure", check(
    f"SELECT ccaa_slug, anio, count(*) AS n FROM sdmx WHERE cents % 3 <> 0 GROUP BY ALL"))
def nrm04(spark, sf):
    kept = nz.sdmx_measure(nz.with_canonical_names(sdmx(spark, sf)))
    return kept.groupBy("ccaa_slug", F.col("anio").cast("int").alias("anio")).agg(n_rows())


@query("nrm05_sdmx_chapters", check(f"""
SELECT {SUMMARY_SQL}, {TOTALS} FROM sdmx WHERE cents % 3 <> 0 AND cents % 5 > 1 AND capitulo_id IS NOT NULL
  AND fase IS NOT NULL GROUP BY ALL"""))
def nrm05(spark, sf):
    return summary(nz.normalize(sdmx(spark, sf)))


@query("nrm06_programme_file", check(f"""
SELECT {SUMMARY_SQL}, {TOTALS} FROM sdmx WHERE cents % 3 <> 0 AND cents % 5 > 1 AND capitulo_id IS NOT NULL
  AND fase IS NOT NULL GROUP BY ALL"""))
def nrm06(spark, sf):
    """An accepted file together with one that splits the same amounts by programme."""
    accepted = sdmx(spark, sf)
    split_again = accepted.withColumn("PRESUPUESTO_PROGRAMA", F.lit("P1"))
    return summary(nz.consolidate([nz.normalize(accepted), nz.normalize(split_again)]))


@query("nrm07_year_from_sheet", check("""
SELECT ccaa_slug, anio, fase, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM fact
WHERE fase = 'PRE' GROUP BY ALL"""))
def nrm07(spark, sf):
    sheet = st.wide_lines(spark, sf).select(
        *ORIGIN, F.concat(F.lit("Hoja "), F.col("anio").cast("string"), F.lit(" def")).alias("__sheet__"),
        F.col("PRE").cast("string").alias("Importe"))
    return nz.normalize(sheet).groupBy("ccaa_slug", "anio", "fase").agg(n_rows(), am.money_sum(F.col("importe_eur")).alias("importe"))


@query("nrm08_unpivot_phases", check("""
SELECT ccaa_slug, anio, fase, count(*) AS n, count(importe_eur) AS con_importe, CAST(sum(importe_eur) AS DOUBLE) AS importe
FROM (SELECT *, 'PRE' AS fase, PRE AS importe_eur FROM wide_lines UNION ALL SELECT *, 'OBR', OBR FROM wide_lines)
GROUP BY ALL"""))
def nrm08(spark, sf):
    wide = st.wide_lines(spark, sf).select(
        "ccaa_slug", "anio", F.lit("old").alias("fase"), F.col("PRE").alias("importe_pre"), F.col("OBR").alias("importe_obr"))
    return nz.unpivot_phases(wide).groupBy("ccaa_slug", "anio", "fase").agg(
        n_rows(), F.count("importe_eur").alias("con_importe"), am.money_sum(F.col("importe_eur")).alias("importe"))


@query("nrm09_canonical_input", check(f"""
SELECT {SUMMARY_SQL}, {TOTALS} FROM (SELECT * REPLACE (CASE fase WHEN 'PAG' THEN 'CRE' ELSE fase END AS fase)
  FROM fact WHERE fase <> 'CRE') GROUP BY ALL"""))
def nrm09(spark, sf):
    phase = (
        F.when(F.col("fase") == "PAG", "Crédito/credito definitivo").when(F.col("fase") == "CRE", "desconocida")
        .otherwise(F.col("fase")))
    return summary(nz.normalize(st.facts(spark, sf).withColumn("fase", phase)))


@query("nrm10_labelled_phases", check(f"""
SELECT {SUMMARY_SQL}, {TOTALS} FROM (SELECT * REPLACE (CASE WHEN dataset_uri IN ('ds/0', 'ds/1') THEN 'OBR' ELSE 'PRE' END AS fase)
  FROM fact WHERE fase = 'PRE' AND (dataset_uri NOT IN ('ds/0', 'ds/1') OR CAST(importe_eur * 100 AS BIGINT) % 2 = 1)) GROUP BY ALL"""))
def nrm10(spark, sf):
    odd = (F.col("PRE") * 100).cast("bigint") % 2 == 1
    label = F.when(F.col("dataset_uri").isin("ds/0", "ds/1") & odd, "Obligaciones reconocidas netas").otherwise("OBR 12")
    sheet = st.wide_lines(spark, sf).select(
        *ORIGIN, F.col("dataset_uri").alias("distribution_id"), F.col("anio").alias("Any"), F.col("capitulo_id").alias("Capítol"),
        F.col("entidad_id").alias("territorio"), label.alias("Concepto"), F.col("PRE").cast("string").alias("Valor"))
    return summary(nz.normalize(sheet))


@query("nrm11_amount_only", check(f"SELECT {SUMMARY_SQL}, {TOTALS} FROM fact WHERE fase = 'PRE' GROUP BY ALL"))
def nrm11(spark, sf):
    sheet = st.wide_lines(spark, sf).select(
        *ORIGIN, F.col("anio").alias("año"), F.col("capitulo_id").alias("cap."), F.col("entidad_id").alias("territorio"),
        euro(F.col("PRE")).alias("Importe en miles de euros"))
    return summary(nz.normalize(sheet))


@query("nrm12_canonical_rows", check(f"""
SELECT {SUMMARY_SQL}, count(*) AS n, count(trimestre) AS n_trimestre, count(grupo_funcional_id) AS n_grupo
FROM fact WHERE NOT (anio = 1997 OR fase = 'PAG' OR CAST(importe_eur * 100 AS BIGINT) % 11 = 0) GROUP BY ALL"""))
def nrm12(spark, sf):
    cents = (F.col("importe_eur") * 100).cast("bigint")
    holes = st.facts(spark, sf).withColumns({
        "anio": F.when(F.col("anio") != 1997, F.col("anio")), "fase": F.when(F.col("fase") != "PAG", F.col("fase")),
        "importe_eur": F.when(cents % 11 != 0, F.col("importe_eur")), "sobra": F.lit(1)})
    return nz.canonical_rows(holes).groupBy(*SUMMARY).agg(
        n_rows(), F.count("trimestre").alias("n_trimestre"), F.count("grupo_funcional_id").alias("n_grupo"))


TITLES = ["Obligaciones reconocidas netas", "La obligacion", "Credito definitivo y pagos", "presupuesto inicial",
          "PAGOS", "Otro", "Presupuesto definitivo"]


def contains_case(column, rules, default="NULL"):
    return "CASE " + " ".join(f"WHEN contains({column}, {text(k)}) THEN {text(v)}" for k, v in rules) + f" ELSE {default} END"


@query("nrm13_phase_from_title", check(f"""
SELECT doc_id, {contains_case('lower(titulo)', ref.TITLE_PHASES, "'PRE'")} AS fase
FROM (SELECT doc_id, {sql_pick(TITLES, 'doc_id')} || ' ' || text AS titulo FROM documents)"""))
def nrm13(spark, sf):
    title = F.concat(pick(TITLES, F.col("doc_id")), F.lit(" "), F.col("text"))
    return st.table(spark, sf, "documents").select("doc_id", tx.phase_from_title(title).alias("fase"))


INDICATORS = ["Obligaciones Reconocidas", " Crédito definitivo", "Presupuesto inicial", "Créditos iniciales", "Pagos",
              "Autorizaciones", "Compromisos", "Otros", None]


@query("nrm14_phase_from_indicator", check(f"""
SELECT indicador, {contains_case('strip_accents(lower(trim(indicador)))', ref.INDICATOR_PHASES)} AS fase, n
FROM (SELECT {sql_pick(INDICATORS, 'l_partkey')} AS indicador, count(*) AS n FROM lineitem GROUP BY 1)"""))
def nrm14(spark, sf):
    return st.table(spark, sf, "lineitem").groupBy(pick(INDICATORS, F.col("l_partkey")).alias("indicador")).agg(n_rows()).select(
        "indicador", tx.phase_from_indicator(F.col("indicador")).alias("fase"), "n")


@query("nrm15_consolidate", check("""
SELECT dataset_uri, fase, origen, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM (
  SELECT dataset_uri, fase, importe_eur, 'hoja' AS origen FROM fact UNION ALL
  SELECT dataset_uri, fase, importe_eur, NULL FROM sdmx WHERE cents % 3 <> 0 AND cents % 5 > 1
    AND capitulo_id IS NOT NULL AND fase IS NOT NULL) GROUP BY ALL"""))
def nrm15(spark, sf):
    parts = [nz.normalize(budget_sheet(spark, sf)).withColumn("origen", F.lit("hoja")), nz.normalize(sdmx(spark, sf))]
    return nz.consolidate(parts).groupBy("dataset_uri", "fase", "origen").agg(
        n_rows(), am.money_sum(F.col("importe_eur")).alias("importe"))


# --- validation --------------------------------------------------------------------

def staged(spark, rows):
    """Rows in a staging table: files are judged after they were staged, and
    the judgement passes over them more than once."""
    return cut(spark, rows, "staging")


def dirty(spark, sf):
    """Facts with broken rows, each in a file of one dataset, region and year."""
    cents = (F.col("importe_eur") * 100).cast("bigint")
    return st.facts(spark, sf).withColumn(
        "distribution_id", F.concat_ws("/", "dataset_uri", "ccaa_slug", F.col("anio").cast("string"))).withColumns({
            "fase": F.when(cents % 997 == 0, "EUR").otherwise(F.col("fase")),
            "anio": F.when(cents % 991 == 0, 1900).when(cents % 983 == 0, F.lit(None)).otherwise(F.col("anio")),
            "trimestre": F.when(cents % 977 == 0, 7).otherwise(F.col("trimestre")),
            "capitulo_id": F.when(cents % 971 == 0, 12).otherwise(F.col("capitulo_id")),
            "dataset_uri": F.when(cents % 967 != 0, F.col("dataset_uri")),
        })


CTES["dirty"] = """
SELECT * EXCLUDE (c) REPLACE (CASE WHEN c % 997 = 0 THEN 'EUR' ELSE fase END AS fase,
  CASE WHEN c % 991 = 0 THEN 1900 WHEN c % 983 = 0 THEN NULL ELSE anio END AS anio,
  CASE WHEN c % 977 = 0 THEN 7 ELSE trimestre END AS trimestre,
  CASE WHEN c % 971 = 0 THEN 12 ELSE capitulo_id END AS capitulo_id,
  CASE WHEN c % 967 <> 0 THEN dataset_uri END AS dataset_uri)
FROM (SELECT *, CAST(importe_eur * 100 AS BIGINT) AS c, dataset_uri || '/' || ccaa_slug || '/' || anio AS distribution_id FROM fact)"""
BROKEN = {"fase_known": "fase NOT IN ('PRE','CRE','ARN','DIS','OBR','PAG')", "anio_present": "anio IS NULL",
          "anio_range": "anio NOT BETWEEN 1980 AND 2100", "trimestre_known": "trimestre NOT BETWEEN 1 AND 4",
          "capitulo_range": "capitulo_id NOT BETWEEN 0 AND 9", "dataset_present": "dataset_uri IS NULL",
          "importe_present": "importe_eur IS NULL", "importe_floor": "importe_eur < -1e12", "ccaa_slug_present": "ccaa_slug IS NULL"}


@query("val01_violations", check(" UNION ALL ".join(
    f"SELECT {text(r)} AS rule, count(*) AS n FROM dirty WHERE {c} HAVING count(*) > 0" for r, c in BROKEN.items())))
def val01(spark, sf):
    return qa.violations(dirty(spark, sf))


ANY = " OR ".join(f"coalesce({c}, false)" for c in BROKEN.values())


@query("val02_whole_file_acceptance", check(f"""
SELECT distribution_id, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM dirty
GROUP BY distribution_id HAVING NOT bool_or({ANY})"""))
def val02(spark, sf):
    return qa.accept_whole_files(staged(spark, dirty(spark, sf))).groupBy("distribution_id").agg(
        n_rows(), am.money_sum(F.col("importe_eur")).alias("importe"))


def repeated(spark, sf):
    """Facts and, from 1998, a copy of ds/0 with other quarters and a copy of
    ds/1 with one amount changed."""
    fact = st.facts(spark, sf)
    copy = fact.where((F.col("dataset_uri") == "ds/0") & (F.col("anio") >= 1998)).withColumns(
        {"dataset_uri": F.lit("ds/0-copy"), "trimestre": F.lit(4)})
    near = fact.where((F.col("dataset_uri") == "ds/1") & (F.col("anio") >= 1998)).withColumns({
        "dataset_uri": F.lit("ds/1-near"),
        "importe_eur": (F.col("importe_eur") + F.when(F.col("fase") == "PRE", F.lit("0.01")).otherwise("0").cast("decimal(3,2)"))
        .cast(am.MONEY)})
    return fact.unionByName(copy).unionByName(near)


CTES["repeated"] = """
SELECT * FROM fact UNION ALL BY NAME
SELECT * REPLACE ('ds/0-copy' AS dataset_uri, 4 AS trimestre) FROM fact WHERE dataset_uri = 'ds/0' AND anio >= 1998
UNION ALL BY NAME SELECT * REPLACE ('ds/1-near' AS dataset_uri,
  CAST(importe_eur + CASE WHEN fase = 'PRE' THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS importe_eur)
FROM fact WHERE dataset_uri = 'ds/1' AND anio >= 1998"""


@query("val03_duplicate_blocks", check(f"""
SELECT ccaa_slug, anio, dataset_uri, count(*) AS n, CAST(sum(importe_eur) AS DOUBLE) AS importe FROM repeated
JOIN (SELECT ccaa_slug, anio, min(dataset_uri) AS dataset_uri FROM (
    SELECT ccaa_slug, anio, dataset_uri, md5(string_agg(r, '~' ORDER BY r)) AS h FROM (
      SELECT *, concat_ws('|', coalesce(entidad_id, ''), coalesce(CAST(capitulo_id AS VARCHAR), ''),
        coalesce(grupo_funcional_id, ''), fase, CAST(importe_eur AS VARCHAR)) AS r FROM repeated) GROUP BY ALL)
  GROUP BY ccaa_slug, anio, h) USING (ccaa_slug, anio, dataset_uri) GROUP BY ALL"""))
def val03(spark, sf):
    return qa.drop_duplicate_blocks(staged(spark, repeated(spark, sf))).groupBy("ccaa_slug", "anio", "dataset_uri").agg(
        n_rows(), am.money_sum(F.col("importe_eur")).alias("importe"))


@query("val04_fact_contract", check("""
SELECT ccaa_slug, count(*) AS n, '' AS missing, '' AS extra, true AS ok FROM fact GROUP BY ccaa_slug"""))
def val04(spark, sf):
    return qa.fact_contract(st.facts(spark, sf))


LACKING = " || ".join(
    f"CASE WHEN bool_or({c} IS NOT NULL) THEN '' ELSE ',{c}' END" for c in ref.REQUIRED_FEATURES)


@query("val05_feature_contract", check(f"""
SELECT ccaa_slug, count(*) AS n, count(DISTINCT (entidad_id, capitulo_id, anio)) AS combos, min(anio) AS anio_min,
  max(anio) AS anio_max, substr({LACKING}, 2) AS missing, {LACKING} = '' AS ok FROM feat GROUP BY ccaa_slug"""))
def val05(spark, sf):
    return qa.feature_contract(features(spark, sf))


@query("val06_usability", check(f"""
SELECT distribution_id, total, valid, round(valid / greatest(total, 1) * 100, 6) AS pct, CASE WHEN valid * 100 >= total * 99
  THEN 'x' END IS NOT NULL AS casi, CASE WHEN total = 0 THEN 'sin datos' WHEN valid / total * 100 >= 80 THEN 'explotable'
  WHEN valid / total * 100 >= 50 THEN 'parcial' ELSE 'errores' END AS grado
FROM (SELECT distribution_id, count(*) AS total, count(*) FILTER (NOT ({ANY} OR CAST(importe_eur AS BIGINT) % 3 = 0
  AND ccaa_slug < 'nation_15' OR ccaa_slug < 'nation_11' AND CAST(importe_eur AS BIGINT) % 4 > 0)) AS valid
  FROM dirty GROUP BY distribution_id)""".replace(
    "CAST(importe_eur AS BIGINT)", "CAST(floor(importe_eur) AS BIGINT)")))
def val06(spark, sf):
    whole = F.floor("importe_eur").cast("bigint")
    bad = ((whole % 3 == 0) & (F.col("ccaa_slug") < "nation_15")) | ((F.col("ccaa_slug") < "nation_11") & (whole % 4 > 0))
    rows = qa.broken_rules(dirty(spark, sf)).groupBy("distribution_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~((F.size("broken") > 0) | bad)).alias("valid"))
    out = qa.usability(rows).withColumn("casi", F.col("valid") * 100 >= F.col("total") * 99)
    return pretty(out, {"pct": 6})


LIMIT = 90000.0


@query("val07_plausible_facts", check(f"""
SELECT ccaa_slug, fase, count(*) AS n FROM fact WHERE importe_eur BETWEEN -{LIMIT} AND {LIMIT} GROUP BY ALL"""))
def val07(spark, sf):
    return qa.plausible_facts(st.facts(spark, sf), LIMIT).groupBy("ccaa_slug", "fase").agg(n_rows())


HUGE = " OR ".join(f"coalesce(abs({c}) > {LIMIT}, false)" for c in qa.AMOUNT_COLUMNS)


@query("val08_plausible_features", check(f"SELECT {KEYS}, PRE, OBR FROM feat WHERE NOT ({HUGE})"))
def val08(spark, sf):
    return qa.plausible_features(features(spark, sf), LIMIT).select(*KEYS.split(", "), "PRE", "OBR")


@query("val09_sanitising_report", check(f"""
SELECT ccaa_slug, count(*) AS n_filas, count(*) FILTER ({HUGE}) AS n_corruptas,
  round(count(*) FILTER ({HUGE}) / count(*) * 100, 3) AS pct_corruptas FROM feat GROUP BY ccaa_slug"""))
def val09(spark, sf):
    return qa.sanitising_report(features(spark, sf), LIMIT)


@query("val10_strictly_below", check(f"SELECT {KEYS}, PRE FROM feat WHERE abs(PRE) < {LIMIT}"))
def val10(spark, sf):
    return qa.strictly_below(features(spark, sf), "PRE", LIMIT).select(*KEYS.split(", "), "PRE")


@query("val11_load_diagnosis", check(f"""
SELECT dataset_uri, count(*) FILTER (importe_eur > {LIMIT}) AS n_altas,
  CAST(sum(importe_eur) FILTER (importe_eur > {LIMIT}) AS DOUBLE) AS suma_altas,
  count(*) FILTER (importe_eur < {LIMIT}) AS n_normales,
  round(avg(CAST(importe_eur AS DOUBLE)) FILTER (importe_eur < {LIMIT}), 4) AS media_normales
FROM fact GROUP BY dataset_uri"""))
def val11(spark, sf):
    return pretty(qa.load_diagnosis(st.facts(spark, sf), "dataset_uri", LIMIT), {"media_normales": 4})

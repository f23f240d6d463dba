"""Coverage, distribution and dashboard queries (ANA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.labels import region_dimension
from fiscalis.operators import analytics as an
from fiscalis.operators import catalog as ca
from fiscalis.operators import selection as se
from fiscalis.plans.catalog_queries import text
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.feature_queries import clean_features, features, stored_features
from fiscalis.plans.model_queries import predictions, pretty
from fiscalis.plans.registry import query
from fiscalis.session import cut
from fiscalis.sources import sample_tables as st

SINCE = 1996
YEARS = range(1995, 2002)
CORE = "(" + ", ".join(text(r) for r in st.CORE) + ")"
BUDGET = "(" + ", ".join(text(r) for r in st.BUDGET_ONLY) + ")"


def money(column: str, where: str = "") -> str:
    keep = f" FILTER ({where})" if where else ""
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))){keep} AS DOUBLE)"


def cap_label(column: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in ref.CHAPTER_LABELS.items())
    return f"CASE {column} {arms} END"


def dash_label(column: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in ref.DASHBOARD_CHAPTERS.items())
    return f"CASE {column} {arms} ELSE '—' END"


CTES["year_totals"] = """
SELECT ccaa_slug, anio, fase, count(*) AS n_hechos, CAST(sum(importe_eur) AS DOUBLE) AS importe_total
FROM fact WHERE importe_eur BETWEEN -1e11 AND 1e11 GROUP BY ALL"""
CTES["chapter_totals"] = """
SELECT ccaa_slug, capitulo_id, anio, fase, count(*) AS n_hechos, CAST(sum(importe_eur) AS DOUBLE) AS importe_total
FROM fact WHERE capitulo_id IS NOT NULL AND importe_eur BETWEEN -1e11 AND 1e11 GROUP BY ALL"""


@query("ana01_year_totals", check("SELECT * FROM year_totals"))
def ana01(spark, sf):
    return an.year_totals(st.facts(spark, sf))


@query("ana02_chapter_totals", check("SELECT * FROM chapter_totals"))
def ana02(spark, sf):
    return an.chapter_totals(st.facts(spark, sf))


@query("ana03_coverage", check("""
SELECT ccaa_slug, count(*) AS hechos_total, min(anio) AS anio_min, max(anio) AS anio_max,
  count(DISTINCT anio) AS n_anios, count(DISTINCT entidad_id) AS n_entidades,
  round(CAST(sum(importe_eur) AS DOUBLE) / 1e6, 1) AS importe_meur FROM fact GROUP BY ccaa_slug"""))
def ana03(spark, sf):
    return an.coverage(st.facts(spark, sf))


@query("ana04_region_phases", check(f"""
SELECT ccaa_slug, string_agg(DISTINCT fase, ',' ORDER BY fase) AS fases,
  CASE WHEN ccaa_slug IN {CORE} THEN '{ref.CORE_GROUP}' ELSE '{ref.BUDGET_ONLY_GROUP}' END AS grupo
FROM fact GROUP BY ccaa_slug"""))
def ana04(spark, sf):
    return an.region_phases(st.facts(spark, sf), st.CORE)


@query("ana05_coverage_matrix", check("SELECT ccaa_slug, " + ", ".join(
    f"round(ln(1 + coalesce(sum(n_hechos) FILTER (anio = {y}), 0)), 6) AS y{y}" for y in YEARS)
    + " FROM year_totals GROUP BY ccaa_slug"))
def ana05(spark, sf):
    out = an.coverage_matrix(an.year_totals(st.facts(spark, sf)))
    return pretty(out, {c: 6 for c in out.columns if c != "ccaa_slug"})


def zeroed(phase: str) -> str:
    return f"coalesce({money('importe_total', f'fase = {text(phase)}')}, 0)"


PICK = f"FROM year_totals WHERE ccaa_slug IN {CORE} AND fase IN ('PRE', 'OBR') AND anio >= {SINCE}"


@query("ana06_phase_evolution", check(
    f"SELECT anio, {zeroed('PRE')} AS PRE, {zeroed('OBR')} AS OBR {PICK} GROUP BY anio"))
def ana06(spark, sf):
    return an.phase_evolution(an.year_totals(st.facts(spark, sf)), st.CORE, SINCE)


GAP = "SELECT ccaa_slug, PRE, OBR, round(PRE - OBR, 2) AS brecha, round((PRE - OBR) / nullif(PRE, 0) * 100, 6) AS brecha_pct FROM"


@query("ana07_gap_by_region", check(
    f"{GAP} (SELECT ccaa_slug, {zeroed('PRE')} AS PRE, {zeroed('OBR')} AS OBR {PICK} GROUP BY ccaa_slug)"))
def ana07(spark, sf):
    return pretty(an.gap_by_region(an.year_totals(st.facts(spark, sf)), st.CORE, SINCE), {"brecha": 2, "brecha_pct": 6})


@query("ana08_execution_by_year", check(f"""
SELECT *, round(OBR / nullif(PRE, 0) * 100, 6) AS tasa FROM (SELECT ccaa_slug, anio,
  {money('importe_total', "fase = 'PRE'")} AS PRE, {money('importe_total', "fase IN ('CRE', 'ARN')")} AS CRE,
  {money('importe_total', "fase = 'OBR'")} AS OBR
FROM year_totals WHERE ccaa_slug IN {CORE} AND fase IN ('PRE', 'OBR', 'CRE', 'ARN') AND anio >= {SINCE}
GROUP BY ccaa_slug, anio)"""))
def ana08(spark, sf):
    return pretty(an.execution_by_year(an.year_totals(st.facts(spark, sf)), st.CORE, SINCE), {"tasa": 6})


PICK_CH = PICK.replace("year_totals", "chapter_totals")


@query("ana09_phases_by_chapter", check(f"""
SELECT capitulo_id, {zeroed('PRE')} AS PRE, {zeroed('OBR')} AS OBR, {cap_label('capitulo_id')} AS cap_label
{PICK_CH} GROUP BY capitulo_id"""))
def ana09(spark, sf):
    return an.phases_by_chapter(an.chapter_totals(st.facts(spark, sf)), st.CORE, SINCE)


@query("ana10_execution_matrix", check(f"SELECT capitulo_id, {cap_label('capitulo_id')} AS cap_label, " + ", ".join(
    f"round(" + money('importe_total', f"anio = {y} AND fase = 'OBR'") + " / nullif("
    + money('importe_total', f"anio = {y} AND fase = 'PRE'") + f", 0) * 100, 6) AS y{y}"
    for y in YEARS if y >= SINCE) + f" {PICK_CH} GROUP BY capitulo_id"))
def ana10(spark, sf):
    out = an.execution_matrix(an.chapter_totals(st.facts(spark, sf)), st.CORE, SINCE)
    return pretty(out, {c: 6 for c in out.columns if c.startswith("y")})


def clipped(column: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN least(greatest({column}, {lo}.0), {hi}.0) END"


def quartiles(value: str) -> str:
    return (f"count({value}) AS n, round(quantile_cont({value}, 0.25), 6) AS p25, "
            f"round(quantile_cont({value}, 0.5), 6) AS mediana, round(quantile_cont({value}, 0.75), 6) AS p75")


QR = {"p25": 6, "mediana": 6, "p75": 6}


@query("ana11_gap_quartiles", check(f"""
SELECT ccaa_slug, {quartiles('v')} FROM (SELECT ccaa_slug, {clipped('brecha_pct', -2, 2)} AS v FROM clean_feat
WHERE ccaa_slug IN {CORE}) WHERE v IS NOT NULL GROUP BY ccaa_slug"""))
def ana11(spark, sf):
    return pretty(an.gap_quartiles(clean_stored(spark, sf), st.CORE), QR)


def hist_sql(values: str, bins: str) -> str:
    return check(f"""
SELECT variable, CAST(coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * k), k - 1), 0) AS INTEGER) AS bin,
  count(*) AS n
FROM ({values}) v JOIN (SELECT variable, min(value) AS lo, max(value) AS hi, {bins} AS k FROM ({values})
  WHERE value IS NOT NULL GROUP BY variable) b USING (variable)
WHERE value IS NOT NULL GROUP BY ALL""")


@query("ana11_gap_histogram", hist_sql(
    f"SELECT 'brecha_pct' AS variable, {clipped('brecha_pct', -2, 2)} AS value FROM clean_feat WHERE ccaa_slug IN {CORE}",
    "80"))
def ana11_hist(spark, sf):
    rows = clean_stored(spark, sf).where(F.col("ccaa_slug").isin(st.CORE))
    values = an.long_values(rows, {"brecha_pct": an.clip(F.col("brecha_pct"), -2, 2)}, [])
    return an.histogram(values, an.fixed_bins(80))


@query("ana12_execution_quartiles", check(f"""
SELECT capitulo_id, {quartiles('v')}, {cap_label('capitulo_id')} AS cap_label
FROM (SELECT capitulo_id, {clipped('ejecutado_pct', 0, 2)} AS v FROM clean_feat WHERE ccaa_slug IN {CORE}
  AND capitulo_id IS NOT NULL AND ejecutado_pct IS NOT NULL) GROUP BY capitulo_id"""))
def ana12(spark, sf):
    return pretty(an.execution_quartiles(clean_stored(spark, sf), st.CORE), QR)


WINSOR = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM clean_feat)), "
    f"(SELECT quantile_cont({c}, 0.99) FROM clean_feat)) END AS {c}" if c in an.WINSORISED else c
    for c in an.CORRELATED)


@query("ana13_correlations", check(f"""
SELECT x, y, round(r, 5) AS r FROM (""" + " UNION ALL ".join(
    f"SELECT {text(a)} AS x, {text(b)} AS y, corr({a}, {b}) AS r FROM (SELECT {WINSOR} FROM clean_feat)"
    for i, a in enumerate(an.CORRELATED) for b in an.CORRELATED[:i]) + ")"))
def ana13(spark, sf):
    return pretty(an.correlations(clean_stored(spark, sf)), {"r": 5})


@query("ana14_budget_evolution", check(f"""
SELECT ccaa_slug, anio, round({money('importe_total')} / 1e6, 6) AS pre_meur FROM year_totals
WHERE ccaa_slug IN {BUDGET} AND fase = 'PRE' AND anio >= {SINCE} GROUP BY ccaa_slug, anio"""))
def ana14(spark, sf):
    return pretty(an.budget_evolution(an.year_totals(st.facts(spark, sf)), st.BUDGET_ONLY, SINCE), {"pre_meur": 6})


@query("ana14_budget_chapter_mix", check("SELECT ccaa_slug, " + ", ".join(
    "coalesce(" + money('importe_total', f"capitulo_id = {c}") + f", 0) AS cap_{c}" for c in range(1, 10))
    + f" FROM chapter_totals WHERE ccaa_slug IN {BUDGET} AND fase = 'PRE' AND anio >= {SINCE} GROUP BY ccaa_slug"))
def ana14_mix(spark, sf):
    return an.budget_chapter_mix(an.chapter_totals(st.facts(spark, sf)), st.BUDGET_ONLY, SINCE)


DESCRIBED = {"PRE": 2, "OBR": 2, "CRE": 2, "brecha_eur": 2, "brecha_pct": 5, "ejecutado_pct": 5, "pago_pct": 5,
             "ratio_cre_pre": 5}


def describe_sql(values: str, keys: str, quantiles: dict[str, float], digits: int) -> str:
    cols = ", ".join(f"round(quantile_cont(value, {p}), {digits}) AS {n}" for n, p in quantiles.items())
    return f"""SELECT {keys}, round(avg(value), {digits}) AS media, round(stddev_samp(value), {digits}) AS desv,
  round(min(value), {digits}) AS minimo, round(max(value), {digits}) AS maximo, count(value) AS n, {cols}
FROM ({values}) WHERE value IS NOT NULL GROUP BY {keys}"""


@query("ana15_describe", check(" UNION ALL BY NAME ".join("(" + describe_sql(
    f"SELECT {text(c)} AS variable, {c} AS value FROM clean_feat", "variable", an.DESCRIBE, 3) + ")" for c in DESCRIBED)))
def ana15(spark, sf):
    values = an.long_values(clean_stored(spark, sf), {c: F.col(c) for c in DESCRIBED}, [])
    out = an.describe(values, ["variable"], an.DESCRIBE)
    return pretty(out, {c: 3 for c in out.columns if c not in ("variable", "n")})


def clean_stored(spark, sf):
    from fiscalis.operators.quality import plausible_features
    return plausible_features(stored_features(spark, sf))


@query("ana16_execution_by_chapter", check(f"""
SELECT capitulo_id, round(avg(v), 6) AS media, round(stddev_samp(v), 6) AS desv, {quartiles('v')},
  {cap_label('capitulo_id')} AS cap_label
FROM (SELECT capitulo_id, ejecutado_pct AS v FROM clean_feat
  WHERE capitulo_id IS NOT NULL AND ejecutado_pct IS NOT NULL) GROUP BY capitulo_id"""))
def ana16(spark, sf):
    return pretty(an.execution_by_chapter(clean_stored(spark, sf)), {**QR, "media": 6, "desv": 6})


@query("ana17_histograms", hist_sql(f"""
SELECT 'OBR' AS variable, CASE WHEN OBR > 0 THEN ln(1 + OBR) END AS value FROM clean_feat
UNION ALL SELECT 'ejecutado_pct', {clipped('ejecutado_pct', 0, 2)} FROM clean_feat
UNION ALL SELECT 'brecha_pct', {clipped('brecha_pct', -2, 2)} FROM clean_feat""", "60"))
def ana17(spark, sf):
    shown = {k: v for k, v in an.study_values().items() if k != "PRE"}
    return an.histogram(an.long_values(clean_stored(spark, sf), shown, []), an.fixed_bins(60))


@query("ana18_annual_phases", check("SELECT ccaa_slug, anio, " + ", ".join(
    money('importe_total', f"fase = {text(p)}") + f" AS {p}" for p in ("PRE", "OBR", "CRE", "ARN"))
    + " FROM year_totals WHERE fase IN ('PRE', 'OBR', 'CRE', 'ARN') GROUP BY ccaa_slug, anio"))
def ana18(spark, sf):
    return an.annual_phases(an.year_totals(st.facts(spark, sf)))


@query("ana18_chapter_pre_obr", check("SELECT ccaa_slug, capitulo_id, anio, " + ", ".join(
    money('importe_total', f"fase = {text(p)}") + f" AS {p}" for p in ("PRE", "OBR"))
    + f" {PICK_CH} GROUP BY ccaa_slug, capitulo_id, anio"))
def ana18_chapters(spark, sf):
    return an.chapter_pre_obr(an.chapter_totals(st.facts(spark, sf)), st.CORE, SINCE)


@query("ana19_volume", check("""
SELECT ccaa_slug, count(*) AS filas, min(anio) AS anio_min, max(anio) AS anio_max,
  count(DISTINCT anio) AS anios_con_dato FROM fact GROUP BY ccaa_slug"""))
def ana19(spark, sf):
    return an.volume(st.facts(spark, sf))


@query("ana20_phase_counts", check("SELECT ccaa_slug, " + ", ".join(
    f"count(*) FILTER (fase = {text(p)}) AS {p}" for p in ref.PHASES) + " FROM fact GROUP BY ccaa_slug"))
def ana20(spark, sf):
    return an.phase_counts(st.facts(spark, sf))


@query("ana21_null_shares", check("""
SELECT ccaa_slug, count(*) AS filas,
  round(100.0 * sum(CASE WHEN entidad_id IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 1) AS pct_null_entidad,
  round(100.0 * sum(CASE WHEN trimestre IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 1) AS pct_null_trimestre
FROM fact GROUP BY ccaa_slug"""))
def ana21(spark, sf):
    return pretty(an.null_shares(st.facts(spark, sf)).select(
        "ccaa_slug", "filas", F.col("pct_null_entidad").cast("double").alias("pct_null_entidad"),
        F.col("pct_null_trimestre").cast("double").alias("pct_null_trimestre")), {})


@query("ana22_downloads_by_format", check("""
SELECT formato, count(*) AS n_distribuciones, count(downloaded_at) AS descargadas FROM dist GROUP BY formato"""))
def ana22(spark, sf):
    return ca.downloads_by_format(st.distributions(spark, sf))


REGION_ROWS = ", ".join(f"({text(s)}, {text(n)}, {text(c)})" for s, n, _, c, _ in ref.REGIONS)
CTES["dim_region"] = f"SELECT * FROM (VALUES {REGION_ROWS}) AS t(slug, nombre, cobertura)"


@query("ana23_region_summary", check("""
SELECT slug, nombre, cobertura, publisher_id AS publicador_principal, 'API datos.gob.es' AS tipo_acceso,
  CAST(n_datasets AS BIGINT) AS n_datasets
FROM dim_region LEFT JOIN (SELECT ccaa_slug, count(*) AS n_datasets FROM catalogue GROUP BY 1) d ON slug = d.ccaa_slug
LEFT JOIN (SELECT ccaa_slug, publisher_id, row_number() OVER (PARTITION BY ccaa_slug
  ORDER BY count(*) DESC, publisher_id NULLS LAST) AS k FROM catalogue GROUP BY 1, 2) p
  ON slug = p.ccaa_slug AND k = 1"""))
def ana23(spark, sf):
    return an.region_summary(region_dimension(spark), st.catalog(spark, sf, ["ccaa_slug", "publisher_id"]))


# Ten regions of the catalogue own the sample facts.
OWNERS = [r[0] for r in ref.REGIONS[:10]]
CTES["owned_fact"] = f"""
SELECT f.* EXCLUDE (ccaa_slug), ([{', '.join(text(s) for s in OWNERS)}])[
  CAST(replace(ccaa_slug, 'nation_', '') AS INTEGER) % 10 + 1] AS ccaa_slug FROM fact f"""
CTES["states"] = """
SELECT slug, nombre, cobertura, coalesce(n_ds, 0) AS n_ds, coalesce(n_dist, 0) AS n_dist,
  coalesce(n_desc, 0) AS n_desc, coalesce(n_raw, 0) AS n_raw, coalesce(n_curado, 0) AS n_curado, anio_min, anio_max,
  CASE WHEN coalesce(n_curado, 0) > 0 THEN 'CURADO' WHEN coalesce(n_desc, 0) > 0 OR coalesce(n_raw, 0) > 0
    THEN 'DESCARGADO' WHEN coalesce(n_ds, 0) > 0 THEN 'CATALOGADO' ELSE 'PENDIENTE' END AS estado
FROM dim_region
LEFT JOIN (SELECT ccaa_slug, count(*) AS n_ds FROM catalogue GROUP BY 1) a ON slug = a.ccaa_slug
LEFT JOIN (SELECT ccaa_slug, count(*) AS n_dist, count(downloaded_at) AS n_desc FROM dist
  JOIN catalogue ON uri = dataset_uri GROUP BY 1) b ON slug = b.ccaa_slug
LEFT JOIN (SELECT ccaa_slug, count(*) AS n_raw FROM local_dist GROUP BY 1) c ON slug = c.ccaa_slug
LEFT JOIN (SELECT ccaa_slug, count(*) AS n_curado, min(anio) AS anio_min, max(anio) AS anio_max
  FROM owned_fact GROUP BY 1) e ON slug = e.ccaa_slug"""


def states(spark, sf):
    owners = F.array(*[F.lit(s) for s in OWNERS])
    number = F.replace(F.col("ccaa_slug"), F.lit("nation_"), F.lit("")).cast("int")
    fact = st.facts(spark, sf).withColumn("ccaa_slug", F.element_at(owners, number % 10 + 1))
    datasets, files = cut(spark, st.catalog(spark, sf, ["ccaa_slug"]), "catalog"), st.distributions(spark, sf)
    return an.pipeline_state(region_dimension(spark), datasets, files, se.local_distributions(files, datasets), fact)


@query("ana24_pipeline_state", check("SELECT * FROM states"))
def ana24(spark, sf):
    return states(spark, sf)


@query("ana25_regions_by_state", check("""
SELECT estado, count(*) AS n, string_agg(nombre, ', ' ORDER BY nombre) AS nombres FROM states GROUP BY estado"""))
def ana25(spark, sf):
    return an.regions_by_state(states(spark, sf))


@query("ana25_phase_completeness", check("""
SELECT ccaa_slug, count(*) AS filas, string_agg(DISTINCT fase, ', ' ORDER BY fase) AS fases,
  bool_or(fase = 'PRE') AND bool_or(fase = 'OBR') AS completa FROM fact GROUP BY ccaa_slug"""))
def ana25_phases(spark, sf):
    return an.phase_completeness(st.facts(spark, sf))


@query("ana26_batch_summary", check("""
SELECT CASE WHEN grouping(ccaa_slug) = 1 THEN 'TOTAL' ELSE ccaa_slug END AS ccaa_slug, count(*) AS filas,
  round(CAST(sum(importe_eur) AS DOUBLE) / 1e6, 6) AS meur, min(anio) || '-' || max(anio) AS anios,
  string_agg(DISTINCT fase, ',' ORDER BY fase) AS fases FROM fact GROUP BY ROLLUP (ccaa_slug)"""))
def ana26(spark, sf):
    return pretty(an.batch_summary(st.facts(spark, sf)), {"meur": 6})


@query("ana27_region_phase_totals", check(
    "SELECT ccaa_slug, fase, CAST(sum(importe_eur) AS DOUBLE) AS importe_eur FROM fact GROUP BY ALL"))
def ana27(spark, sf):
    return an.region_phase_totals(st.facts(spark, sf))


@query("ana28_filtered_features", check("""
SELECT ccaa_slug, entidad_id, anio, trimestre, capitulo_id, PRE, OBR FROM feat
WHERE ccaa_slug = 'nation_2' AND anio BETWEEN 1996 AND 1999 AND capitulo_id = 3"""))
def ana28(spark, sf):
    return an.apply_filters(features(spark, sf), "nation_2", (1996, 1999), 3).select(
        "ccaa_slug", "entidad_id", "anio", "trimestre", "capitulo_id", "PRE", "OBR")


@query("ana29_filter_domains", check("""
SELECT n_name AS nombre, lower(n_name) AS slug, (SELECT min(anio) FROM feat) AS anio_min,
  (SELECT max(anio) FROM feat) AS anio_max FROM nation WHERE lower(n_name) IN (SELECT ccaa_slug FROM feat)"""))
def ana29(spark, sf):
    regions = st.table(spark, sf, "nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("nombre"))
    return an.filter_domains(regions, stored_features(spark, sf))


def positive(column: str, extra: str = "") -> str:
    return f"coalesce({money(column, f'{column} > 0{extra}')}, 0)"


@query("ana30_kpis", check(f"""
SELECT PRE, CRE, OBR, PAG, obr_rows, round(o / nullif(c, 0), 6) AS tasa, round((p - o) / nullif(p, 0), 6) AS brecha,
  round(g / nullif(o, 0), 6) AS pago
FROM (SELECT {', '.join(f'{positive(c)} AS {c}' for c in ('PRE', 'CRE', 'OBR', 'PAG'))},
  {positive('PRE', ' AND OBR > 0')} AS p, {positive('CRE', ' AND OBR > 0')} AS c, {positive('OBR')} AS o,
  {positive('PAG', ' AND OBR > 0')} AS g, count(*) FILTER (OBR > 0) AS obr_rows FROM clean_feat)"""))
def ana30(spark, sf):
    return pretty(an.kpis(clean_features(spark, sf)), {"tasa": 6, "brecha": 6, "pago": 6})


@query("ana31_coverage_kpis", check("""
SELECT count(DISTINCT ccaa_slug) AS total, count(DISTINCT ccaa_slug) FILTER (OBR > 0) AS con_obr,
  count(DISTINCT ccaa_slug) - count(DISTINCT ccaa_slug) FILTER (OBR > 0) AS solo_presupuesto FROM clean_feat"""))
def ana31(spark, sf):
    return an.coverage_kpis(clean_features(spark, sf))


@query("ana32_region_comparison", check(f"""
SELECT ccaa_slug AS ccaa, p AS presupuesto, o AS obligaciones, round(o / nullif(c, 0), 6) AS tasa_ejecucion,
  round((pe - o) / nullif(pe, 0), 6) AS brecha, CASE WHEN o > 0 THEN 'Sí' ELSE 'Solo presupuesto' END AS ejecucion
FROM (SELECT ccaa_slug, {positive('PRE')} AS p, {positive('OBR')} AS o, {positive('CRE', ' AND OBR > 0')} AS c,
  {positive('PRE', ' AND OBR > 0')} AS pe FROM clean_feat GROUP BY ccaa_slug)"""))
def ana32(spark, sf):
    return pretty(an.region_comparison(clean_features(spark, sf)), {"tasa_ejecucion": 6, "brecha": 6})


def phase_sums_sql(by: str) -> str:
    return check(" UNION ALL ".join(f"""
SELECT {by}, {text(p)} AS fase, coalesce({money(p)}, 0) AS importe, {text(label)} AS etiqueta,
  round(coalesce({money(p)}, 0) / 1e6, 6) AS meur FROM clean_feat GROUP BY {by}"""
                                    for p, label in ref.PHASE_LABELS.items()))


@query("ana33_phase_sums_by_region", phase_sums_sql("ccaa_slug"))
def ana33(spark, sf):
    return pretty(an.phase_sums_long(clean_features(spark, sf), "ccaa_slug"), {"meur": 6})


@query("ana33_phase_sums_by_year", phase_sums_sql("anio"))
def ana33_years(spark, sf):
    return pretty(an.phase_sums_long(clean_features(spark, sf), "anio"), {"meur": 6})


@query("ana34_execution_by_region", check(f"""
SELECT *, round(OBR / CRE * 100, 1) AS tasa FROM (SELECT ccaa_slug, {money('OBR')} AS OBR, {money('CRE')} AS CRE
FROM clean_feat WHERE OBR > 0 AND CRE > 0 GROUP BY ccaa_slug)"""))
def ana34(spark, sf):
    return an.execution_by_region(clean_features(spark, sf))


@query("ana35_region_detail", check(f"""
SELECT ccaa_slug, {dash_label('capitulo_id')} AS capitulo, anio, PRE, CRE, OBR, PAG,
  round(ratio_cre_pre, 6) AS ratio_cre_pre, round(ejecutado_pct, 6) AS ejecutado_pct,
  round(brecha_pct, 6) AS brecha_pct, obr_lag_1 FROM feat"""))
def ana35(spark, sf):
    return pretty(an.region_detail(features(spark, sf)), {"ratio_cre_pre": 6, "ejecutado_pct": 6, "brecha_pct": 6})


@query("ana36_prediction_kpis", check("""
SELECT count(*) AS predicciones, count(DISTINCT ccaa_slug) AS ccaa, round(quantile_cont(mape, 0.5), 6) AS mape_mediano
FROM pred"""))
def ana36(spark, sf):
    return pretty(an.prediction_kpis(cut(spark, predictions(spark, sf), "predictions")), {"mape_mediano": 6})


PRED_VIEW = f"ccaa_slug AS ccaa, anio, {dash_label('capitulo_id')} AS capitulo, modelo"


@query("ana37_prediction_detail", check(f"""
SELECT {PRED_VIEW}, round(importe_predicho / 1e6, 6) AS meur_predicho, round(importe_real / 1e6, 6) AS meur_real,
  round(desviacion_rel, 6) AS desviacion_rel, alerta FROM pred"""))
def ana37(spark, sf):
    return pretty(an.prediction_detail(predictions(spark, sf)),
                  {"meur_predicho": 6, "meur_real": 6, "desviacion_rel": 6})


@query("ana38_alert_counts", check("SELECT alerta, count(*) AS n FROM pred GROUP BY alerta"))
def ana38(spark, sf):
    return an.alert_counts(predictions(spark, sf))


@query("ana38_alerts_by_region", check("SELECT ccaa_slug, " + ", ".join(
    f"count(*) FILTER (alerta = '{a}') AS {a}" for a in ("verde", "amarillo", "rojo", "gris"))
    + " FROM pred GROUP BY ccaa_slug"))
def ana38_regions(spark, sf):
    return an.alerts_by_region(predictions(spark, sf))


@query("ana39_red_cases", check(f"""
SELECT {PRED_VIEW}, round(desviacion_rel, 6) AS desviacion_rel, alerta FROM pred WHERE alerta = 'rojo'"""))
def ana39(spark, sf):
    return pretty(an.red_cases(predictions(spark, sf)), {"desviacion_rel": 6})


@query("ana40_gap_from_facts", check(f"""
{GAP} (SELECT ccaa_slug, coalesce({money('importe_eur', "fase = 'PRE'")}, 0) AS PRE,
  coalesce({money('importe_eur', "fase = 'OBR'")}, 0) AS OBR
FROM fact WHERE fase IN ('PRE', 'OBR') AND anio >= {SINCE} AND ccaa_slug IN {CORE} GROUP BY ccaa_slug)"""))
def ana40(spark, sf):
    return pretty(an.gap_from_facts(st.facts(spark, sf), st.CORE, SINCE), {"brecha": 2, "brecha_pct": 6})


@query("ana41_yearly_spending", check(f"""
SELECT * FROM (SELECT ccaa_slug, anio, coalesce({money('OBR')}, 0) AS OBR FROM clean_feat GROUP BY ccaa_slug, anio)
WHERE OBR > 0"""))
def ana41(spark, sf):
    return an.yearly_spending(clean_features(spark, sf))


@query("ana41_yearly_execution", check(f"""
SELECT ccaa_slug, anio, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS mediana
FROM (SELECT ccaa_slug, anio, {clipped('ejecutado_pct', 0, 2)} AS v FROM clean_feat) WHERE v IS NOT NULL
GROUP BY ccaa_slug, anio"""))
def ana41_median(spark, sf):
    return pretty(an.yearly_execution(clean_stored(spark, sf)), {"mediana": 6})


STUDY = {"OBR": "CASE WHEN OBR > 0 THEN ln(1 + OBR) END", "PRE": "CASE WHEN PRE > 0 THEN ln(1 + PRE) END",
         "ejecutado_pct": clipped("ejecutado_pct", 0, 2), "brecha_pct": clipped("brecha_pct", -2, 2)}
CTES["study"] = " UNION ALL ".join(
    f"SELECT ccaa_slug, {text(v)} AS variable, {e} AS value FROM clean_feat" for v, e in STUDY.items())


@query("ana42_region_descriptives", check(f"""
SELECT *, round(cvx, 4) AS cv FROM (
{describe_sql('SELECT * FROM study', 'ccaa_slug, variable', an.QUARTILES, 4).replace(
    'count(value) AS n', 'count(value) AS n, stddev_samp(value) / nullif(avg(value), 0) AS cvx')})
WHERE n >= 5""".replace("SELECT *, round(cvx", "SELECT * EXCLUDE (cvx), round(cvx")))
def ana42(spark, sf):
    out = an.region_descriptives(clean_stored(spark, sf))
    return pretty(out, {c: 4 for c in out.columns if c not in ("ccaa_slug", "variable", "n")})


@query("ana43_budget_descriptives", check(f"""
SELECT ccaa_slug, round(avg(PRE), 2) AS media, round(stddev_samp(PRE), 2) AS desv, round(max(PRE), 2) AS maximo,
  count(*) AS n, round(quantile_cont(PRE, 0.25), 4) AS p25, round(quantile_cont(PRE, 0.5), 4) AS mediana,
  round(quantile_cont(PRE, 0.75), 4) AS p75, round({money('PRE')} / 1e6, 1) AS total_meur,
  round(stddev_samp(PRE) / nullif(avg(PRE), 0), 3) AS cv
FROM feat WHERE ccaa_slug IN {BUDGET} AND abs(PRE) < 1e11 AND PRE >= 0 GROUP BY ccaa_slug HAVING count(*) >= 3"""))
def ana43(spark, sf):
    out = an.budget_descriptives(stored_features(spark, sf), st.BUDGET_ONLY)
    return pretty(out, {**{c: 2 for c in ("media", "desv", "maximo")}, **{c: 4 for c in an.QUARTILES},
                        "total_meur": 1, "cv": 3})


@query("ana44_budget_histogram", hist_sql(
    f"SELECT ccaa_slug AS variable, CASE WHEN PRE > 0 THEN ln(1 + PRE) END AS value FROM feat WHERE ccaa_slug IN {BUDGET}",
    "least(40, greatest(8, floor(count(*) / 3)))"))
def ana44(spark, sf):
    return an.histogram(an.budget_log_values(stored_features(spark, sf), st.BUDGET_ONLY), an.sized_bins)


@query("ana44_budget_composition", check(f"""
SELECT ccaa_slug, 'capitulo' AS serie, capitulo_id AS clave, round(coalesce({money('PRE')}, 0) / 1e6, 6) AS meur
FROM feat WHERE ccaa_slug IN {BUDGET} AND capitulo_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT ccaa_slug, 'anio', anio, round(coalesce({money('PRE')}, 0) / 1e6, 6) FROM feat
WHERE ccaa_slug IN {BUDGET} AND anio IS NOT NULL GROUP BY ALL"""))
def ana44_mix(spark, sf):
    return pretty(an.budget_composition(stored_features(spark, sf), st.BUDGET_ONLY), {"meur": 6})

"""Coverage, distribution and dashboard queries over facts and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.amounts import clip, money_sum, ratio, zero
from fiscalis.functions.labels import chapter_label, dashboard_chapter, region_label
from fiscalis.operators.linear import pairwise_correlations
from fiscalis.operators.quality import plausible_facts
from fiscalis.operators.ranking import group_quantiles


def _phase(name: str, amount: str = "importe_total") -> Column:
    """Sum of one phase, 0 when it never occurs."""
    return zero(money_sum(F.when(F.col("fase") == name, F.col(amount))))


def _phase_or_null(name: str, amount: str = "importe_total") -> Column:
    return money_sum(F.when(F.col("fase") == name, F.col(amount)))


def domain(df: DataFrame, column: str) -> list:
    """The distinct values of a column with a small fixed domain (years,
    chapters), for the columns of a matrix."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def matrix(df: DataFrame, rows: list[str], column: str, prefix: str, cell) -> DataFrame:
    """One column per value of `column`, in a single aggregation."""
    return df.groupBy(*rows).agg(*[
        cell(F.col(column) == value).alias(f"{prefix}{value}") for value in domain(df, column)])


# --- totals ----------------------------------------------------------------

def year_totals(fact: DataFrame) -> DataFrame:
    return plausible_facts(fact).groupBy("ccaa_slug", "anio", "fase").agg(
        F.count(F.lit(1)).alias("n_hechos"), money_sum(F.col("importe_eur")).alias("importe_total"))


def chapter_totals(fact: DataFrame) -> DataFrame:
    return (
        plausible_facts(fact).where(F.col("capitulo_id").isNotNull())
        .groupBy("ccaa_slug", "capitulo_id", "anio", "fase")
        .agg(F.count(F.lit(1)).alias("n_hechos"), money_sum(F.col("importe_eur")).alias("importe_total"))
    )


def coverage(fact: DataFrame) -> DataFrame:
    return fact.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("hechos_total"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"),
        F.count_distinct("anio").alias("n_anios"), F.count_distinct("entidad_id").alias("n_entidades"),
        F.round(money_sum(F.col("importe_eur")) / 1e6, 1).alias("importe_meur"),
    ).orderBy(F.col("hechos_total").desc(), "ccaa_slug")


def region_phases(fact: DataFrame, core: list[str]) -> DataFrame:
    """Phases a region publishes, and the group it belongs to."""
    return fact.groupBy("ccaa_slug").agg(
        F.array_join(F.sort_array(F.collect_set("fase")), ",").alias("fases")).withColumn(
        "grupo", F.when(F.col("ccaa_slug").isin(core), ref.CORE_GROUP).otherwise(ref.BUDGET_ONLY_GROUP))


def coverage_matrix(totals: DataFrame) -> DataFrame:
    """Region × year intensity, log(1 + facts); years without facts have no column."""
    return matrix(totals, ["ccaa_slug"], "anio", "y", lambda hit: F.log1p(
        F.coalesce(F.sum(F.when(hit, F.col("n_hechos"))), F.lit(0)).cast("double")))


def _selected(totals: DataFrame, regions: list[str], phases: list[str], since: int) -> DataFrame:
    return totals.where(
        F.col("ccaa_slug").isin(regions) & F.col("fase").isin(phases) & (F.col("anio") >= since))


def phase_evolution(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    return _selected(totals, regions, ["PRE", "OBR"], since).groupBy("anio").agg(
        _phase("PRE").alias("PRE"), _phase("OBR").alias("OBR")).orderBy("anio")


def gap_by_region(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    sums = _selected(totals, regions, ["PRE", "OBR"], since).groupBy("ccaa_slug").agg(
        _phase("PRE").alias("PRE"), _phase("OBR").alias("OBR"))
    gap = F.col("PRE") - F.col("OBR")
    return sums.withColumns({"brecha": gap, "brecha_pct": ratio(gap, F.col("PRE")) * 100}).orderBy("brecha_pct")


def execution_by_year(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    """OBR/PRE in percent; older sources publish the credit as ARN."""
    rows = _selected(totals, regions, ["PRE", "OBR", "CRE", "ARN"], since).withColumn(
        "fase", F.when(F.col("fase") == "ARN", "CRE").otherwise(F.col("fase")))
    sums = rows.groupBy("ccaa_slug", "anio").agg(*[_phase_or_null(p).alias(p) for p in ("PRE", "CRE", "OBR")])
    return sums.withColumn("tasa", ratio(F.col("OBR"), F.col("PRE")) * 100)


def phases_by_chapter(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    return _selected(totals, regions, ["PRE", "OBR"], since).groupBy("capitulo_id").agg(
        _phase("PRE").alias("PRE"), _phase("OBR").alias("OBR")).withColumn(
        "cap_label", chapter_label(F.col("capitulo_id"))).orderBy("capitulo_id")


def execution_matrix(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    """OBR/PRE in percent by chapter and year."""
    rows = _selected(totals, regions, ["PRE", "OBR"], since)

    def cell(hit: Column) -> Column:
        def part(phase: str) -> Column:
            return money_sum(F.when(hit & (F.col("fase") == phase), F.col("importe_total")))
        return ratio(part("OBR"), part("PRE")) * 100

    return matrix(rows, ["capitulo_id"], "anio", "y", cell).withColumn(
        "cap_label", chapter_label(F.col("capitulo_id")))


def budget_evolution(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    return _selected(totals, regions, ["PRE"], since).groupBy("ccaa_slug", "anio").agg(
        (_phase("PRE") / 1e6).alias("pre_meur"))


def budget_chapter_mix(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    """Region × chapter, zero where a region has no such chapter."""
    rows = _selected(totals, regions, ["PRE"], since)
    return matrix(rows, ["ccaa_slug"], "capitulo_id", "cap_", lambda hit: zero(
        money_sum(F.when(hit, F.col("importe_total")))))


def annual_phases(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("fase").isin("PRE", "OBR", "CRE", "ARN")).groupBy("ccaa_slug", "anio").agg(
        *[_phase_or_null(p).alias(p) for p in ("PRE", "OBR", "CRE", "ARN")])


def chapter_pre_obr(totals: DataFrame, regions: list[str], since: int) -> DataFrame:
    return _selected(totals, regions, ["PRE", "OBR"], since).groupBy("ccaa_slug", "capitulo_id", "anio").agg(
        _phase_or_null("PRE").alias("PRE"), _phase_or_null("OBR").alias("OBR"))


def gap_from_facts(fact: DataFrame, regions: list[str], since: int) -> DataFrame:
    """The gap per region summed from facts, without the plausibility filter."""
    rows = _selected(fact, regions, ["PRE", "OBR"], since)
    sums = rows.groupBy("ccaa_slug").agg(
        _phase("PRE", "importe_eur").alias("PRE"), _phase("OBR", "importe_eur").alias("OBR"))
    gap = F.col("PRE") - F.col("OBR")
    return sums.withColumns({"brecha": gap, "brecha_pct": ratio(gap, F.col("PRE")) * 100})


# --- distributions of feature values ----------------------------------------

def long_values(features: DataFrame, variables: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, variable, value): the non-null values of several expressions."""
    wide = features.select(*keys, *[c.cast("double").alias(n) for n, c in variables.items()])
    return wide.unpivot(keys, list(variables), "variable", "value").where(F.col("value").isNotNull())


def study_values() -> dict[str, Column]:
    """The four studied variables: amounts in log scale, ratios clipped."""
    return {
        "OBR": F.when(F.col("OBR") > 0, F.log1p("OBR")),
        "PRE": F.when(F.col("PRE") > 0, F.log1p("PRE")),
        "ejecutado_pct": clip(F.col("ejecutado_pct"), 0, 2),
        "brecha_pct": clip(F.col("brecha_pct"), -2, 2),
    }


def histogram(values: DataFrame, bins: Callable[[Column], Column]) -> DataFrame:
    """Equal-width bins between the least and greatest value of each variable;
    `bins` gives their number from the variable's number of values.

    The bounds are one row per variable; they reach the rows as one small map.
    """
    bounds = values.groupBy("variable").agg(F.struct(
        F.min("value").alias("lo"), F.max("value").alias("hi"), bins(F.count(F.lit(1))).alias("k")).alias("b"))
    known = bounds.agg(F.map_from_entries(F.collect_list(F.struct("variable", "b")))).scalar()
    rows = values.withColumn("_b", F.try_element_at(known, F.col("variable")))
    lo, hi, k = (F.col(f"_b.{c}") for c in ("lo", "hi", "k"))
    place = F.floor((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * k)
    return rows.groupBy(
        "variable", F.coalesce(F.least(place, k - 1), F.lit(0)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def fixed_bins(k: int) -> Callable[[Column], Column]:
    return lambda _: F.lit(k)


def sized_bins(n: Column) -> Column:
    """A third of the values, between 8 and 40."""
    return F.least(F.lit(40), F.greatest(F.lit(8), F.floor(n / 3)))


QUARTILES = {"p25": 0.25, "mediana": 0.5, "p75": 0.75}
DESCRIBE = {"p10": 0.1, "p25": 0.25, "mediana": 0.5, "p75": 0.75, "p90": 0.9}


def describe(values: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles per key group."""
    moments = values.groupBy(*keys).agg(
        F.avg("value").alias("media"), F.stddev_samp("value").alias("desv"),
        F.min("value").alias("minimo"), F.max("value").alias("maximo"))
    return moments.join(group_quantiles(values, keys, "value", probs), keys)


def gap_quartiles(features: DataFrame, regions: list[str]) -> DataFrame:
    rows = features.where(F.col("ccaa_slug").isin(regions)).select(
        "ccaa_slug", clip(F.col("brecha_pct"), -2, 2).alias("value"))
    return group_quantiles(rows, ["ccaa_slug"], "value", QUARTILES).orderBy("mediana")


def execution_values(features: DataFrame, lo: float = 0, hi: float = 2) -> DataFrame:
    """(ccaa_slug, capitulo_id, value) of the clipped execution rate."""
    return features.where(F.col("capitulo_id").isNotNull() & F.col("ejecutado_pct").isNotNull()).select(
        "ccaa_slug", "capitulo_id", clip(F.col("ejecutado_pct"), lo, hi).alias("value"))


def execution_quartiles(features: DataFrame, regions: list[str]) -> DataFrame:
    rows = execution_values(features).where(F.col("ccaa_slug").isin(regions))
    return group_quantiles(rows, ["capitulo_id"], "value", QUARTILES).withColumn(
        "cap_label", chapter_label(F.col("capitulo_id")))


def execution_by_chapter(features: DataFrame) -> DataFrame:
    rows = features.where(F.col("capitulo_id").isNotNull() & F.col("ejecutado_pct").isNotNull()).select(
        "capitulo_id", F.col("ejecutado_pct").alias("value"))
    return describe(rows, ["capitulo_id"], QUARTILES).drop("minimo", "maximo").withColumn(
        "cap_label", chapter_label(F.col("capitulo_id")))


CORRELATED = ["PRE", "OBR", "CRE", "brecha_eur", "brecha_pct", "ejecutado_pct", "pago_pct", "ratio_cre_pre",
              "obr_lag_1", "obr_lag_2", "obr_lag_3", "obr_lag_4", "obr_rolling4_mean", "obr_rolling4_std"]
WINSORISED = ["PRE", "OBR", "CRE", "brecha_eur", "obr_lag_1", "obr_rolling4_mean"]


def correlations(features: DataFrame) -> DataFrame:
    """Lower triangle of the pairwise-complete Pearson matrix, six columns
    winsorised at their 1st and 99th percentile."""
    values = long_values(features, {c: F.col(c) for c in WINSORISED}, [])
    tails = group_quantiles(values, ["variable"], "value", {"lo": 0.01, "hi": 0.99})
    known = tails.agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("lo", "hi"))))).scalar()

    def cut(c: str) -> Column:
        if c not in WINSORISED:
            return F.col(c)
        b = F.try_element_at(F.col("_tails"), F.lit(c))
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), b["lo"]), b["hi"])).alias(c)

    cutted = features.withColumn("_tails", known).select(*[cut(c) for c in CORRELATED])
    return pairwise_correlations(cutted, CORRELATED)


# --- evidence and coverage ---------------------------------------------------

def volume(fact: DataFrame) -> DataFrame:
    return fact.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("filas"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"),
        F.count_distinct("anio").alias("anios_con_dato")).orderBy(F.col("filas").desc(), "ccaa_slug")


def phase_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("ccaa_slug").agg(*[F.count_if(F.col("fase") == p).alias(p) for p in ref.PHASES])


def null_shares(fact: DataFrame) -> DataFrame:
    def share(c: str) -> Column:
        return F.round(F.lit(100.0) * F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 1)

    return fact.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("filas"), share("entidad_id").alias("pct_null_entidad"),
        share("trimestre").alias("pct_null_trimestre"))


def region_summary(regions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Coverage, main publisher and number of datasets of every region."""
    per_publisher = datasets.groupBy("ccaa_slug", "publisher_id").agg(F.count(F.lit(1)).alias("n"))
    # NULL publishers lose ties.
    summary = per_publisher.groupBy("ccaa_slug").agg(
        F.sum("n").alias("n_datasets"),
        F.min(F.struct(-F.col("n"), F.col("publisher_id").isNull(), "publisher_id")).alias("first"))
    return regions.join(summary, regions["slug"] == summary["ccaa_slug"], "left").select(
        "slug", "nombre", "cobertura", F.col("first.publisher_id").alias("publicador_principal"),
        F.lit("API datos.gob.es").alias("tipo_acceso"), "n_datasets")


STATES = ["CURADO", "DESCARGADO", "CATALOGADO", "PENDIENTE"]


def pipeline_state(regions: DataFrame, datasets: DataFrame, distributions: DataFrame,
                   raw_files: DataFrame, fact: DataFrame) -> DataFrame:
    """How far each region has come, from four independent counts."""
    def counted(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy(F.col("ccaa_slug").alias("slug")).agg(*aggs)

    n = F.count(F.lit(1))
    owned = distributions.join(datasets.select(F.col("uri").alias("dataset_uri"), "ccaa_slug"), "dataset_uri")
    parts = [
        counted(datasets, n.alias("n_ds")),
        counted(owned, n.alias("n_dist"), F.count("downloaded_at").alias("n_desc")),
        counted(raw_files, n.alias("n_raw")),
        counted(fact, n.alias("n_curado"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max")),
    ]
    rows = regions.select("slug", "nombre", "cobertura")
    for part in parts:
        rows = rows.join(part, "slug", "left")
    rows = rows.fillna(0, ["n_ds", "n_dist", "n_desc", "n_raw", "n_curado"])
    state = (
        F.when(F.col("n_curado") > 0, "CURADO")
        .when((F.col("n_desc") > 0) | (F.col("n_raw") > 0), "DESCARGADO")
        .when(F.col("n_ds") > 0, "CATALOGADO").otherwise("PENDIENTE"))
    order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("estado"))
    return rows.withColumn("estado", state).orderBy(order, "cobertura", "slug")


def regions_by_state(states: DataFrame) -> DataFrame:
    return states.groupBy("estado").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("nombre")), ", ").alias("nombres"))


def phase_completeness(fact: DataFrame) -> DataFrame:
    """Phases per region and whether budget and spending are both there."""
    phases = F.sort_array(F.collect_set("fase"))
    return fact.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("filas"), F.array_join(phases, ", ").alias("fases"),
        (F.bool_or(F.col("fase") == "PRE") & F.bool_or(F.col("fase") == "OBR")).alias("completa"))


def batch_summary(fact: DataFrame) -> DataFrame:
    """Rows, amount, years and phases per region and for all together."""
    return fact.rollup("ccaa_slug").agg(
        F.count(F.lit(1)).alias("filas"), (money_sum(F.col("importe_eur")) / 1e6).alias("meur"),
        F.concat_ws("-", F.min("anio").cast("string"), F.max("anio").cast("string")).alias("anios"),
        F.array_join(F.sort_array(F.collect_set("fase")), ",").alias("fases"),
        F.grouping("ccaa_slug").alias("_all"),
    ).withColumn("ccaa_slug", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("ccaa_slug"))).drop("_all")


def region_phase_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy("ccaa_slug", "fase").agg(money_sum(F.col("importe_eur")).alias("importe_eur"))


# --- dashboard ---------------------------------------------------------------

def apply_filters(df: DataFrame, region: str | None = None, years: tuple[int, int] | None = None,
                  chapter: int | None = None) -> DataFrame:
    """The sidebar selection; a missing filter or column selects everything."""
    if region and "ccaa_slug" in df.columns:
        df = df.where(F.col("ccaa_slug") == region)
    if years and "anio" in df.columns:
        df = df.where(F.col("anio").between(*years))
    if chapter and "capitulo_id" in df.columns:
        df = df.where(F.col("capitulo_id") == chapter)
    return df


def filter_domains(regions: DataFrame, features: DataFrame) -> DataFrame:
    """Regions that have data, each with the year range of all the data."""
    years = features.agg(F.struct(F.min("anio").alias("lo"), F.max("anio").alias("hi"))).scalar()
    present = features.select(F.col("ccaa_slug").alias("slug")).distinct()
    return regions.join(present, "slug", "left_semi").select(
        "slug", "nombre", years["lo"].alias("anio_min"), years["hi"].alias("anio_max"))


def _positive(c: str, where: Column | None = None) -> Column:
    keep = F.col(c) > 0
    return zero(money_sum(F.when(keep if where is None else keep & where, F.col(c))))


def kpis(features: DataFrame) -> DataFrame:
    """Totals of positive amounts; rates over rows with spending only."""
    spent = F.col("OBR") > 0
    sums = features.agg(
        *[_positive(c).alias(c) for c in ("PRE", "CRE", "OBR", "PAG")],
        *[_positive(c, spent).alias(f"_{c}") for c in ("PRE", "CRE", "OBR", "PAG")],
        F.count_if(spent).alias("obr_rows"))
    return sums.select(
        "PRE", "CRE", "OBR", "PAG", "obr_rows",
        ratio(F.col("_OBR"), F.col("_CRE")).alias("tasa"),
        ratio(F.col("_PRE") - F.col("_OBR"), F.col("_PRE")).alias("brecha"),
        ratio(F.col("_PAG"), F.col("_OBR")).alias("pago"))


def coverage_kpis(features: DataFrame) -> DataFrame:
    total = F.count_distinct("ccaa_slug")
    spending = F.count_distinct(F.when(F.col("OBR") > 0, F.col("ccaa_slug")))
    return features.agg(total.alias("total"), spending.alias("con_obr")).withColumn(
        "solo_presupuesto", F.col("total") - F.col("con_obr"))


def region_comparison(features: DataFrame) -> DataFrame:
    """Budget, spending, rate and gap by region, largest budget first."""
    spent = F.col("OBR") > 0
    sums = features.groupBy("ccaa_slug").agg(
        _positive("PRE").alias("presupuesto"), _positive("OBR").alias("obligaciones"),
        _positive("CRE", spent).alias("_cre"), _positive("PRE", spent).alias("_pre"))
    return sums.select(
        region_label(F.col("ccaa_slug")).alias("ccaa"), "presupuesto", "obligaciones",
        ratio(F.col("obligaciones"), F.col("_cre")).alias("tasa_ejecucion"),
        ratio(F.col("_pre") - F.col("obligaciones"), F.col("_pre")).alias("brecha"),
        F.when(F.col("obligaciones") > 0, "Sí").otherwise("Solo presupuesto").alias("ejecucion"),
    ).orderBy(F.col("presupuesto").desc(), "ccaa")


def phase_sums_long(features: DataFrame, by: str) -> DataFrame:
    """Budget, credit and spending per group as rows, in millions, groups with
    the largest budget first."""
    phases = list(ref.PHASE_LABELS)
    keyed = features.where(F.col(by).isNotNull())
    sums = keyed.groupBy(by).agg(*[zero(money_sum(F.col(p))).alias(p) for p in phases])
    long = sums.withColumn("_pre", F.col("PRE")).unpivot([by, "_pre"], phases, "fase", "importe")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ref.PHASE_LABELS.items() for x in kv]), F.col("fase"))
    return long.withColumns({"etiqueta": label, "meur": F.col("importe") / 1e6}).orderBy(
        F.col("_pre").desc(), by).drop("_pre")


def execution_by_region(features: DataFrame) -> DataFrame:
    rows = features.where((F.col("OBR") > 0) & (F.col("CRE") > 0))
    sums = rows.groupBy("ccaa_slug").agg(money_sum(F.col("OBR")).alias("OBR"), money_sum(F.col("CRE")).alias("CRE"))
    return sums.withColumn("tasa", F.round(F.col("OBR") / F.col("CRE") * 100, 1)).orderBy("tasa", "ccaa_slug")


def region_detail(features: DataFrame) -> DataFrame:
    return features.select(
        "ccaa_slug", dashboard_chapter(F.col("capitulo_id")).alias("capitulo"), "anio", "PRE", "CRE", "OBR", "PAG",
        "ratio_cre_pre", "ejecutado_pct", "brecha_pct", "obr_lag_1")


# --- predictions on the dashboard ---------------------------------------------

def prediction_kpis(predictions: DataFrame) -> DataFrame:
    counts = predictions.agg(F.count(F.lit(1)).alias("predicciones"), F.count_distinct("ccaa_slug").alias("ccaa"))
    mape = group_quantiles(predictions, [], "mape", {"mape_mediano": 0.5})
    return counts.withColumn("mape_mediano", mape.select("mape_mediano").scalar())


def prediction_detail(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        region_label(F.col("ccaa_slug")).alias("ccaa"), "anio", dashboard_chapter(F.col("capitulo_id")).alias("capitulo"),
        "modelo", (F.col("importe_predicho") / 1e6).alias("meur_predicho"),
        (F.col("importe_real") / 1e6).alias("meur_real"), "desviacion_rel", "alerta").orderBy("ccaa", "anio")


def alert_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("alerta").agg(F.count(F.lit(1)).alias("n"))


def alerts_by_region(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("ccaa_slug").agg(*[
        F.count_if(F.col("alerta") == a).alias(a) for a in ("verde", "amarillo", "rojo", "gris")])


def red_cases(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("alerta") == "rojo").select(
        region_label(F.col("ccaa_slug")).alias("ccaa"), "anio", dashboard_chapter(F.col("capitulo_id")).alias("capitulo"),
        "modelo", "desviacion_rel", "alerta").orderBy(F.abs("desviacion_rel").desc(), "ccaa", "anio")


# --- regional statistics --------------------------------------------------------

def yearly_spending(features: DataFrame) -> DataFrame:
    sums = features.groupBy("ccaa_slug", "anio").agg(zero(money_sum(F.col("OBR"))).alias("OBR"))
    return sums.where(F.col("OBR") > 0)


def yearly_execution(features: DataFrame) -> DataFrame:
    """Median clipped execution rate by region and year."""
    rows = features.where(F.col("anio").isNotNull()).select(
        "ccaa_slug", "anio", clip(F.col("ejecutado_pct"), 0, 2).alias("value"))
    return group_quantiles(rows, ["ccaa_slug", "anio"], "value", {"mediana": 0.5})


def region_descriptives(features: DataFrame, min_rows: int = 5) -> DataFrame:
    """Descriptives of the four studied variables per region."""
    values = long_values(features, study_values(), ["ccaa_slug"])
    out = describe(values, ["ccaa_slug", "variable"], QUARTILES).where(F.col("n") >= min_rows)
    return out.withColumn("cv", ratio(F.col("desv"), F.col("media")))


def budget_descriptives(features: DataFrame, regions: list[str], min_rows: int = 3) -> DataFrame:
    """Descriptives of the initial budget where nothing else is published."""
    rows = features.where(F.col("ccaa_slug").isin(regions) & (F.abs("PRE") < ref.MAX_AMOUNT) & (F.col("PRE") >= 0))
    values = rows.select("ccaa_slug", F.col("PRE").alias("value"))
    totals = rows.groupBy("ccaa_slug").agg((money_sum(F.col("PRE")) / 1e6).alias("total_meur"))
    out = describe(values, ["ccaa_slug"], QUARTILES).where(F.col("n") >= min_rows)
    return out.join(totals, "ccaa_slug").withColumn("cv", ratio(F.col("desv"), F.col("media"))).drop("minimo")


def budget_log_values(features: DataFrame, regions: list[str]) -> DataFrame:
    """(variable = region, value): positive budgets in log scale."""
    return features.where(F.col("ccaa_slug").isin(regions) & (F.col("PRE") > 0)).select(
        F.col("ccaa_slug").alias("variable"), F.log1p("PRE").alias("value"))


def budget_composition(features: DataFrame, regions: list[str]) -> DataFrame:
    """Budget by region, chapter and year with subtotals by chapter and by year."""
    rows = features.where(F.col("ccaa_slug").isin(regions))
    meur = (zero(money_sum(F.col("PRE"))) / 1e6).alias("meur")
    mix = rows.where(F.col("capitulo_id").isNotNull()).groupBy("ccaa_slug", "capitulo_id").agg(meur).select(
        "ccaa_slug", F.lit("capitulo").alias("serie"), F.col("capitulo_id").alias("clave"), "meur")
    years = rows.where(F.col("anio").isNotNull()).groupBy("ccaa_slug", "anio").agg(meur).select(
        "ccaa_slug", F.lit("anio").alias("serie"), F.col("anio").alias("clave"), "meur")
    return mix.unionByName(years)

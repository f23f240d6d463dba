"""Hypothesis-test queries (STA)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fiscalis.operators import analytics as an
from fiscalis.operators import stats as sa
from fiscalis.plans.analytics_queries import clean_stored, clipped
from fiscalis.plans.check_sql import CTES, check
from fiscalis.plans.model_queries import pretty
from fiscalis.plans.registry import query

BY = ["ccaa_slug", "variable"]


def study(spark, sf):
    return an.long_values(clean_stored(spark, sf), an.study_values(), ["ccaa_slug"])


CTES["shapes"] = """
SELECT ccaa_slug, variable, CAST(count(*) AS DOUBLE) AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS g1,
  avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS g2
FROM (SELECT *, value - avg(value) OVER (PARTITION BY ccaa_slug, variable) AS d FROM study WHERE value IS NOT NULL)
GROUP BY ccaa_slug, variable HAVING avg(d ** 2) > 0"""


@query("sta01_shape", check("""
SELECT ccaa_slug, variable, CAST(n AS BIGINT) AS n, round(g1, 5) AS asimetria, round(g2, 5) AS curtosis
FROM shapes WHERE n >= 20"""))
def sta01(spark, sf):
    return pretty(sa.shape(study(spark, sf), BY).where(F.col("n") >= 20), {"asimetria": 5, "curtosis": 5})


CTES["k_parts"] = """
SELECT *, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
  g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s
FROM shapes WHERE n >= 20"""
CTES["k_steps"] = """
SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
  (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4)))))
    / sqrt(2 / (9 * a)) AS zk
FROM (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / s ** 2)) AS a FROM k_parts)"""


@query("sta02_k_squared", check("""
SELECT ccaa_slug, variable, CAST(n AS BIGINT) AS n, round(zs * zs + zk * zk, 3) AS k2,
  round(exp(-(zs * zs + zk * zk) / 2), 6) AS p_k2 FROM k_steps"""))
def sta02(spark, sf):
    out = sa.normality_by_moments(study(spark, sf), BY).select(*BY, "n", "k2", "p_k2")
    return pretty(out, {"k2": 3, "p_k2": 6})


@query("sta03_ks_distance")
def sta03(spark, sf):
    return sa.ks_distance(study(spark, sf), BY)


@query("sta04_normality_by_region")
def sta04(spark, sf):
    return sa.normality_table(study(spark, sf), BY)


@query("sta04_normality_report")
def sta04_report(spark, sf):
    """All regions pooled: raw and log spending, ratios clipped at 5."""
    shown = {
        "OBR": F.col("OBR"), "log(1+OBR)": F.when(F.col("OBR") > 0, F.log1p("OBR")),
        "ejecutado_pct": an.clip(F.col("ejecutado_pct"), -5, 5), "brecha_pct": an.clip(F.col("brecha_pct"), -5, 5),
    }
    return sa.normality_table(an.long_values(clean_stored(spark, sf), shown, []), ["variable"])


CTES["rates"] = f"""
SELECT ccaa_slug, capitulo_id, {clipped('ejecutado_pct', 0, 2)} AS v, {clipped('ejecutado_pct', -5, 5)} AS v5
FROM clean_feat WHERE capitulo_id IS NOT NULL AND ejecutado_pct IS NOT NULL"""


def levene_sql(scope: str) -> str:
    by, first = (f"{scope}, ", f"{scope}, ") if scope else ("", "")
    group = f"GROUP BY {scope}" if scope else ""
    return check(f"""
SELECT {first}k, CAST(n AS BIGINT) AS n, round((n - k) / (k - 1) * between_g / inside, 5) AS w FROM (
  SELECT {first}count(*) AS k, sum(n) AS n, sum(inside) AS inside, sum(n * (m - grand) ** 2) AS between_g FROM (
    SELECT *, sum(n * m) OVER (PARTITION BY {scope or '1'}) / sum(n) OVER (PARTITION BY {scope or '1'}) AS grand FROM (
      SELECT {by}capitulo_id, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS inside FROM (
        SELECT *, abs(v5 - median(v5) OVER (PARTITION BY {by}capitulo_id)) AS z FROM rates)
      GROUP BY {by}capitulo_id HAVING count(*) >= 20)) {group} HAVING count(*) >= 2)""")


def rates(spark, sf, lo=0, hi=2):
    return an.execution_values(clean_stored(spark, sf), lo, hi)


@query("sta05_levene_pooled", levene_sql(""))
def sta05(spark, sf):
    return pretty(sa.levene(rates(spark, sf, -5, 5), []), {"w": 5})


@query("sta05_levene_by_region", levene_sql("ccaa_slug"))
def sta05_region(spark, sf):
    return pretty(sa.levene(rates(spark, sf, -5, 5), ["ccaa_slug"]), {"w": 5})


CTES["reg_rows"] = """
SELECT ccaa_slug, OBR AS y, PRE AS x1, CRE AS x2
FROM (SELECT *, bool_or(CRE IS NOT NULL) OVER (PARTITION BY ccaa_slug) AS has FROM clean_feat)
WHERE abs(OBR) < 1e11 AND abs(PRE) < 1e11 AND (NOT has OR coalesce(abs(CRE) < 1e11, false))"""


CTES["pool_rows"] = """
SELECT '(todas)' AS ccaa_slug, OBR AS y, PRE AS x1, CRE AS x2 FROM clean_feat
WHERE OBR IS NOT NULL AND PRE IS NOT NULL AND CRE IS NOT NULL"""


def fit_sql(rows: str, target: str, least: int = 50) -> str:
    return f"""
SELECT ccaa_slug, n, k, my - b1 * m1 - coalesce(b2 * m2, 0) AS b0, b1, b2,
  (b1 * c1y + coalesce(b2 * c2y, 0)) / nullif(vy, 0) AS r2
FROM (SELECT *, CASE WHEN k = 2 THEN (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) ELSE c1y / v1 END AS b1,
    CASE WHEN k = 2 THEN (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) END AS b2
  FROM (SELECT ccaa_slug, count(*) AS n, CASE WHEN count(x2) > 0 THEN 2 ELSE 1 END AS k, avg(x1) AS m1,
      avg(x2) AS m2, avg({target}) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, var_pop({target}) AS vy,
      covar_pop(x1, x2) AS c12, covar_pop(x1, {target}) AS c1y, covar_pop(x2, {target}) AS c2y
    FROM {rows} GROUP BY ccaa_slug HAVING count(*) >= {least}))"""


CTES["fits"] = fit_sql("reg_rows", "y")
CTES["errors"] = """
SELECT r.*, y - (b0 + b1 * x1 + coalesce(b2 * x2, 0)) AS e,
  (y - (b0 + b1 * x1 + coalesce(b2 * x2, 0))) ** 2 AS e2 FROM reg_rows r JOIN fits USING (ccaa_slug)"""
CTES["fits2"] = fit_sql("errors", "e2")


def regression(spark, sf):
    return sa.regression_rows(clean_stored(spark, sf))


@query("sta06_ols", check("""
SELECT ccaa_slug, n, k, round(b0, 2) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(r2, 6) AS r2 FROM fits"""))
def sta06(spark, sf):
    return pretty(sa.ols(regression(spark, sf)), {"b0": 2, "b1": 5, "b2": 5, "r2": 6})


@query("sta07_breusch_pagan", check("SELECT ccaa_slug, n, k, round(n * r2, 4) AS lm FROM fits2"))
def sta07(spark, sf):
    return pretty(sa.breusch_pagan(regression(spark, sf)), {"lm": 4})


CTES["pool_fit"] = fit_sql("pool_rows", "y", 51)
CTES["pool_errors"] = """
SELECT r.*, (y - (b0 + b1 * x1 + b2 * x2)) ** 2 AS e2 FROM pool_rows r JOIN pool_fit USING (ccaa_slug)"""
CTES["pool_fit2"] = fit_sql("pool_errors", "e2", 51)


@query("sta06_ols_pooled", check("""
SELECT ccaa_slug, n, k, round(b0, 2) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(r2, 6) AS r2 FROM pool_fit"""))
def sta06_pooled(spark, sf):
    """All regions pooled, more than 50 rows."""
    return pretty(sa.ols(sa.pooled_rows(clean_stored(spark, sf)), min_rows=51), {"b0": 2, "b1": 5, "b2": 5, "r2": 6})


@query("sta07_breusch_pagan_pooled", check("SELECT ccaa_slug, n, k, round(n * r2, 4) AS lm FROM pool_fit2"))
def sta07_pooled(spark, sf):
    return pretty(sa.breusch_pagan(sa.pooled_rows(clean_stored(spark, sf)), 51), {"lm": 4})


@query("sta08_white")
def sta08(spark, sf):
    return sa.white(regression(spark, sf))


@query("sta09_scale_location")
def sta09(spark, sf):
    return sa.scale_location(regression(spark, sf))


def spearman_sql(other: str) -> str:
    return check(f"""
SELECT ccaa_slug, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
  SELECT ccaa_slug, rank() OVER x + (count(*) OVER (PARTITION BY ccaa_slug, OBR) - 1) / 2.0 AS rx,
    rank() OVER y + (count(*) OVER (PARTITION BY ccaa_slug, {other}) - 1) / 2.0 AS ry
  FROM clean_feat WHERE OBR > 0 AND {other} > 0
  WINDOW x AS (PARTITION BY ccaa_slug ORDER BY OBR), y AS (PARTITION BY ccaa_slug ORDER BY {other}))
GROUP BY ccaa_slug HAVING count(*) >= 10""")


def pairs(spark, sf, other):
    return clean_stored(spark, sf).select("ccaa_slug", F.col("OBR").alias("x"), F.col(other).alias("y"))


@query("sta10_spearman_budget", spearman_sql("PRE"))
def sta10(spark, sf):
    return pretty(sa.spearman(pairs(spark, sf, "PRE")), {"rho": 6})


@query("sta10_spearman_credit", spearman_sql("CRE"))
def sta10_credit(spark, sf):
    return pretty(sa.spearman(pairs(spark, sf, "CRE")), {"rho": 6})


@query("sta10_spearman_significance")
def sta10_table(spark, sf):
    return sa.spearman_table(pairs(spark, sf, "PRE"))


def kruskal_sql(scope: str) -> str:
    by, first = (f"{scope}, ", f"{scope}, ") if scope else ("", "")
    part = f"PARTITION BY {scope}" if scope else ""
    group = f"GROUP BY {scope}" if scope else ""
    tie = f"SELECT {first}sum(t ** 3 - t) AS ties FROM (SELECT {by}v, CAST(count(*) AS DOUBLE) AS t FROM kept GROUP BY {by}v) {group}"
    using = f"JOIN ({tie}) USING ({scope})" if scope else f", ({tie})"
    return check(f"""
SELECT {first}n_capitulos, CAST(n AS BIGINT) AS n,
  round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS h
FROM (WITH kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {by}capitulo_id) AS c FROM rates) WHERE c >= 20)
  SELECT * FROM (SELECT {first}count(*) AS n_capitulos, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS s FROM (
    SELECT {by}capitulo_id, count(*) AS n, sum(rk) AS r FROM (
      SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {by}v) - 1) / 2.0 AS rk FROM kept)
    GROUP BY {by}capitulo_id) {group}) {using}) WHERE n_capitulos >= 2""")


@query("sta11_kruskal_pooled", kruskal_sql(""))
def sta11(spark, sf):
    return pretty(sa.kruskal(rates(spark, sf), []), {"h": 4})


@query("sta11_kruskal_by_region", kruskal_sql("ccaa_slug"))
def sta11_region(spark, sf):
    return pretty(sa.kruskal(rates(spark, sf), ["ccaa_slug"]), {"h": 4})


@query("sta12_mann_whitney_by_region", check("""
SELECT ccaa_slug, n_corr, n_capital, r - n_corr * (n_corr + 1) / 2.0 AS u, round(m1, 6) AS mediana_corr,
  round(m2, 6) AS mediana_capital FROM (
  SELECT ccaa_slug, count(*) FILTER (t = 1) AS n_corr, count(*) FILTER (t = 2) AS n_capital, sum(rk) FILTER (t = 1) AS r,
    quantile_cont(v, 0.5) FILTER (t = 1) AS m1, quantile_cont(v, 0.5) FILTER (t = 2) AS m2 FROM (
    SELECT *, CAST(rank() OVER (PARTITION BY ccaa_slug ORDER BY v) + (count(*) OVER (PARTITION BY ccaa_slug, v) - 1) / 2.0
      AS DOUBLE) AS rk FROM (SELECT *, CASE WHEN capitulo_id <= 4 THEN 1 WHEN capitulo_id IN (6, 7) THEN 2 END AS t FROM rates)
    WHERE t IS NOT NULL) GROUP BY ccaa_slug) WHERE n_corr >= 20 AND n_capital >= 20"""))
def sta12(spark, sf):
    return pretty(sa.mann_whitney(rates(spark, sf), ["ccaa_slug"]).drop("z"),
                  {"mediana_corr": 6, "mediana_capital": 6})


@query("sta12_mann_whitney_direction")
def sta12_table(spark, sf):
    """Regions and all of them pooled, with p-value and direction."""
    values = rates(spark, sf)
    pooled = values.withColumn("ccaa_slug", F.lit("(todas)"))
    return sa.mann_whitney_table(values, ["ccaa_slug"]).unionByName(sa.mann_whitney_table(pooled, ["ccaa_slug"]))


@query("sta13_rejections")
def sta13(spark, sf):
    clean = clean_stored(spark, sf)
    values = an.long_values(clean, an.study_values(), ["ccaa_slug"])
    normal = sa.normality_table(values, BY).select(
        F.concat(F.lit("normalidad "), "variable").alias("hipotesis"), (F.col("normal_consenso") == "No").alias("rechaza"))
    rows = sa.regression_rows(clean)
    spread = sa.breusch_pagan_table(rows).select(
        F.lit("varianza constante").alias("hipotesis"), (F.col("p") < sa.ALPHA).alias("rechaza"))
    chapters = sa.levene_table(an.execution_values(clean, -5, 5), ["ccaa_slug"]).select(
        F.lit("varianza igual entre capítulos").alias("hipotesis"), (F.col("p") < sa.ALPHA).alias("rechaza"))
    return sa.rejections(reduce(lambda a, b: a.unionByName(b), [normal, spread, chapters]))


@query("sta14_kruskal_p_values")
def sta14(spark, sf):
    return sa.kruskal_table(rates(spark, sf), ["ccaa_slug"])


GRID, NORMAL = sa.quantile_grid()


@query("sta15_quantile_pairs", check(f"""
SELECT ccaa_slug, variable, unnest({GRID}::DOUBLE[]) AS p, round(unnest({NORMAL}::DOUBLE[]), 9) AS teorico, round(unnest(quantile_cont(value, {GRID})), 3) AS muestral
FROM study WHERE value IS NOT NULL GROUP BY ccaa_slug, variable HAVING count(*) >= 10"""))
def sta15(spark, sf):
    return pretty(sa.quantile_pairs(study(spark, sf), BY), {"teorico": 9, "muestral": 3})

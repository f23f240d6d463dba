"""Hypothesis tests computed from moments, counts and ranks.

Every statistic is an aggregation: a test over a region, or over all regions
pooled, never gathers its observations in one task.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions import tails
from fiscalis.functions.amounts import ratio
from fiscalis.functions.labels import lookup
from fiscalis.operators.linear import explained_share
from fiscalis.operators.ranking import group_medians, group_quantiles, mid_ranks, positions, running_sums, value_counts

ALPHA = 0.05


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


# --- normality -----------------------------------------------------------------

def shape(values: DataFrame, keys: list[str]) -> DataFrame:
    """Size, biased skewness and excess kurtosis."""
    return values.groupBy(*keys).agg(
        F.count("value").alias("n"), F.skewness("value").alias("asimetria"), F.kurtosis("value").alias("curtosis"))


def k_squared(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson omnibus statistic from size, skewness and excess kurtosis."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    scaled = F.when(y == 0, F.lit(1.0)).otherwise(y) / F.sqrt(2 / (w2 - 1))
    z_skew = F.ln(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(0.5 * F.ln(w2))
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / F.sqrt(variance)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    low = 1 + x * F.sqrt(2 / (a - 4))
    cubic = F.signum(low) * F.pow((1 - 2 / a) / F.nullif(F.abs(low), F.lit(0.0)), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - cubic) / F.sqrt(2 / (9 * a))
    return z_skew * z_skew + z_kurt * z_kurt


def normality_by_moments(values: DataFrame, keys: list[str], min_rows: int = 20) -> DataFrame:
    out = shape(values, keys).where(F.col("n") >= min_rows)
    k2 = k_squared(F.col("n"), F.col("asimetria"), F.col("curtosis"))
    return out.withColumn("k2", k2).withColumn("p_k2", F.exp(-F.col("k2") / 2))


def ks_distance(values: DataFrame, keys: list[str], min_rows: int = 20) -> DataFrame:
    """Kolmogorov-Smirnov distance of the z-score to the standard normal."""
    moments = values.groupBy(*keys).agg(
        F.count("value").alias("n_all"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    placed = positions(value_counts(values, keys, "value"), keys)
    rows = placed.join(moments.where((F.col("n_all") >= min_rows) & (F.col("_sd") > 0)), keys)
    rows = rows.withColumn("_z", (F.col("value") - F.col("_mean")) / F.col("_sd"))
    rows = rows.withColumn("_cdf", tails.normal_tail_native(-F.col("_z")))
    above = (F.col("below") + F.col("n")) / F.col("total") - F.col("_cdf")
    under = F.col("_cdf") - F.col("below") / F.col("total")
    return rows.groupBy(*keys).agg(
        F.max("total").alias("n"), F.max(F.greatest(above, under)).alias("ks")).withColumns({
            "p_ks": tails.kolmogorov_column(F.col("ks"), F.col("n")), "p_ks_exacto": tails.kolmogorov_exact_column(F.col("ks"), F.col("n"))})


SHAPIRO_ROWS, SHAPIRO_LEAST, SEED = 5000, 12, 42
# Royston's polynomials for the two largest weights and for the distribution of ln(1 - W).
LAST_WEIGHT = (0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
W_SPREAD = (-0.4803, -0.082676, 0.0030302)


def _polynomial(x: Column, coefficients: tuple[float, ...], first: int = 0) -> Column:
    """Sum of c_k x^(k + first)."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    for _ in range(first):
        out = out * x
    return out


def shapiro_wilk(values: DataFrame, keys: list[str], min_rows: int = 20) -> DataFrame:
    """Shapiro-Wilk W by Royston's approximation, and its p-value, for groups of `min_rows` (12 at least).

    The test is defined for up to 5,000 rows: of larger groups so many are drawn, each task passing on no more
    than that. Ranks, weights and sums are then windows over groups of bounded size. Groups
    without spread have no W.
    """
    drawn = Window.partitionBy(*keys).orderBy("_draw")
    ordered, group = Window.partitionBy(*keys).orderBy("value"), Window.partitionBy(*keys)
    some = values.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"), F.rand(SEED).alias("_draw"))
    some = some.withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= SHAPIRO_ROWS).select(*keys, "value")
    placed = some.withColumns({"i": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(group)}).where(
        F.col("n") >= max(min_rows, SHAPIRO_LEAST))
    scored = tails.with_normal_quantile(placed.withColumn("_p", (F.col("i") - 0.375) / (F.col("n") + 0.25)), "_p", "m")
    u = 1 / F.sqrt("n")
    sums = scored.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("ss"), F.max(F.when(F.col("i") == F.col("n"), F.col("m"))).alias("m1"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("m2"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("spread"))
    sums = sums.withColumns({"a1": _polynomial(u, LAST_WEIGHT, 1) + F.col("m1") / F.sqrt("ss"), "a2": _polynomial(u, NEXT_WEIGHT, 1) + F.col("m2") / F.sqrt("ss")})
    rest = (F.col("ss") - 2 * F.col("m1") * F.col("m1") - 2 * F.col("m2") * F.col("m2")) / (1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2"))
    sums = sums.withColumn("rest", F.sqrt(rest))
    weight = (F.when(F.col("i") == F.col("n"), F.col("a1")).when(F.col("i") == 1, -F.col("a1")).when(F.col("i") == F.col("n") - 1, F.col("a2"))
              .when(F.col("i") == 2, -F.col("a2")).otherwise(F.col("m") / F.col("rest")))
    line = scored.drop("n").join(sums, keys)
    w = line.groupBy(*keys).agg(F.max("n").alias("n_shapiro"), F.sum(weight * (F.col("value") - F.col("mean"))).alias("_b"), F.max("spread").alias("_spread"))
    found = w.where(F.col("_spread") > 0).select(*keys, "n_shapiro", F.least(F.lit(1.0), F.col("_b") * F.col("_b") / F.col("_spread")).alias("shapiro"))
    log_n = F.ln("n_shapiro")
    z = (F.ln(F.greatest(1 - F.col("shapiro"), F.lit(1e-300))) - _polynomial(log_n, W_MEAN)) / F.exp(_polynomial(log_n, W_SPREAD))
    return found.withColumn("_z", z).withColumn("p_shapiro", tails.normal_tail_native(F.col("_z"))).drop("_z")


def normality_table(values: DataFrame, keys: list[str], min_rows: int = 20) -> DataFrame:
    """All three tests and both verdicts: by K² alone, and by no test rejecting."""
    table = normality_by_moments(values, keys, min_rows).join(
        ks_distance(values, keys, min_rows).drop("n"), keys, "left").join(shapiro_wilk(values, keys, min_rows), keys, "left")
    by_k2 = F.when(F.col("p_k2") < ALPHA, "No").otherwise("Sí")
    none = F.lit(True)
    for p in ("p_k2", "p_ks_exacto", "p_shapiro"):
        none = none & (F.coalesce(p, F.lit(1.0)) >= ALPHA)
    return table.withColumns({
        "normal_k2": by_k2, "normal_consenso": F.when(none, "Sí").otherwise("No"),
        "recomendacion": F.when(none, "Paramétrica").otherwise("No paramétrica"),
    })


def quantile_grid() -> tuple[list[float], list[float]]:
    """Shares, and the standard normal quantile of each."""
    grid = [0.01, *[k / 20 for k in range(1, 20)], 0.99]
    return grid, [NormalDist().inv_cdf(p) for p in grid]


def quantile_pairs(values: DataFrame, keys: list[str], min_rows: int = 10) -> DataFrame:
    """Sample quantiles on a fixed grid next to the normal ones."""
    grid, normal = quantile_grid()
    probs = {f"q{i}": p for i, p in enumerate(grid)}
    found = group_quantiles(values, keys, "value", probs).where(F.col("n") >= min_rows)
    return found.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(normal[i]).alias("teorico"), F.col(f"q{i}").alias("muestral"))
        for i, p in enumerate(grid)])))


# --- equal variances between chapters --------------------------------------------

def large_groups(values: DataFrame, keys: list[str], min_rows: int = 20) -> DataFrame:
    """Values of the (scope, chapter) groups with enough rows."""
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_rows)
    return values.join(sizes.select(*keys), keys, "left_semi")


def levene(values: DataFrame, scope: list[str], min_rows: int = 20) -> DataFrame:
    """Brown-Forsythe W between chapters, from group medians and group sums."""
    keys = [*scope, "capitulo_id"]
    kept = large_groups(values, keys, min_rows)
    medians = group_medians(kept, keys, "value").drop("n")
    spread = kept.join(medians, keys).withColumn("z", F.abs(F.col("value") - F.col("median")))
    groups = spread.groupBy(*keys).agg(
        F.count("z").alias("n"), F.avg("z").alias("m"), (F.var_pop("z") * F.count("z")).alias("inside"))
    totals = groups.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("inside").alias("_inside"),
        F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_ss"))
    between = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n")
    w = (F.col("n") - F.col("k")) / (F.col("k") - 1) * between / F.nullif(F.col("_inside"), F.lit(0.0))
    return totals.where(F.col("k") >= 2).withColumn("w", w).drop("_inside", "_s", "_ss")


def levene_table(values: DataFrame, scope: list[str]) -> DataFrame:
    return levene(values, scope).withColumn(
        "p", tails.f_column(F.col("w"), F.col("k") - 1, F.col("n") - F.col("k"))).withColumn(
        "conclusion", F.when(F.col("p") < ALPHA, "Heterocedástico").otherwise("Homocedástico"))


# --- regression -------------------------------------------------------------------

def regression_rows(features: DataFrame) -> DataFrame:
    """(ccaa_slug, y, x1, x2): spending on budget and, where a region publishes
    it, credit. Rows with a missing or implausible value are left out."""
    credit = features.groupBy("ccaa_slug").agg(F.bool_or(F.col("CRE").isNotNull()).alias("_has"))
    rows = features.join(credit, "ccaa_slug").where(
        (F.abs("OBR") < ref.MAX_AMOUNT) & (F.abs("PRE") < ref.MAX_AMOUNT)
        & (~F.col("_has") | F.coalesce(F.abs("CRE") < ref.MAX_AMOUNT, F.lit(False))))
    return rows.select("ccaa_slug", F.col("OBR").alias("y"), F.col("PRE").alias("x1"), F.col("CRE").alias("x2"))


def pooled_rows(features: DataFrame) -> DataFrame:
    """All regions as one: rows with spending, budget and credit."""
    rows = features.where(F.col("OBR").isNotNull() & F.col("PRE").isNotNull() & F.col("CRE").isNotNull())
    return rows.select(F.lit("(todas)").alias("ccaa_slug"), F.col("OBR").alias("y"), F.col("PRE").alias("x1"), F.col("CRE").alias("x2"))


def ols(rows: DataFrame, y: str = "y", min_rows: int = 50) -> DataFrame:
    """Least squares of y on x1 (and x2 where it exists) per region, from
    centred second moments."""
    target = F.col(y)
    m = rows.groupBy("ccaa_slug").agg(
        F.count(F.lit(1)).alias("n"), F.count("x2").alias("_n2"),
        F.avg("x1").alias("_m1"), F.avg("x2").alias("_m2"), F.avg(target).alias("_my"),
        F.var_pop("x1").alias("_v1"), F.var_pop("x2").alias("_v2"), F.var_pop(target).alias("_vy"),
        F.covar_pop("x1", "x2").alias("_c12"), F.covar_pop("x1", y).alias("_c1y"), F.covar_pop("x2", y).alias("_c2y"),
    ).where(F.col("n") >= min_rows)
    both = F.col("_n2") > 0
    det = F.nullif(F.col("_v1") * F.col("_v2") - F.col("_c12") * F.col("_c12"), F.lit(0.0))
    b1 = F.when(both, (F.col("_c1y") * F.col("_v2") - F.col("_c2y") * F.col("_c12")) / det).otherwise(
        F.col("_c1y") / F.nullif(F.col("_v1"), F.lit(0.0)))
    b2 = F.when(both, (F.col("_c2y") * F.col("_v1") - F.col("_c1y") * F.col("_c12")) / det)
    fit = m.withColumns({"b1": b1, "b2": b2})
    explained = F.col("b1") * F.col("_c1y") + F.coalesce(F.col("b2") * F.col("_c2y"), F.lit(0.0))
    return fit.select(
        "ccaa_slug", "n", F.when(both, 2).otherwise(1).alias("k"),
        (F.col("_my") - F.col("b1") * F.col("_m1") - F.coalesce(F.col("b2") * F.col("_m2"), F.lit(0.0))).alias("b0"),
        "b1", "b2", ratio(explained, F.col("_vy")).alias("r2"))


def residuals(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Rows with their fitted value and residual."""
    fitted = F.col("b0") + F.col("b1") * F.col("x1") + F.coalesce(F.col("b2") * F.col("x2"), F.lit(0.0))
    return (
        rows.join(fit.select("ccaa_slug", "b0", "b1", "b2"), "ccaa_slug")
        .withColumn("ajustado", fitted).withColumn("residuo", F.col("y") - F.col("ajustado"))
        .drop("b0", "b1", "b2")
    )


def breusch_pagan(rows: DataFrame, min_rows: int = 50) -> DataFrame:
    """LM = n·R² of the squared residuals on the same regressors."""
    squared = residuals(rows, ols(rows, min_rows=min_rows)).withColumn("e2", F.col("residuo") * F.col("residuo"))
    return ols(squared, "e2", min_rows).select("ccaa_slug", "n", "k", (F.col("n") * F.col("r2")).alias("lm"))


def breusch_pagan_table(rows: DataFrame) -> DataFrame:
    return breusch_pagan(rows).withColumn("p", tails.chi2_column(F.col("lm"), F.col("k"))).withColumn(
        "conclusion", F.when(F.col("p") < ALPHA, "Heterocedástico").otherwise("Homocedástico"))


def white(rows: DataFrame, min_rows: int = 50) -> DataFrame:
    """LM = n·R² of the squared residuals on levels, squares and cross product.

    The regressors are standardised first: the spanned space, and so R², stays
    the same while the normal equations stay well conditioned.
    """
    squared = residuals(rows, ols(rows, min_rows=min_rows)).withColumn("e2", F.col("residuo") * F.col("residuo"))
    scale = squared.groupBy("ccaa_slug").agg(*[
        f(c).alias(f"{n}_{c}") for c in ("x1", "x2", "e2") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {f"z_{c}": F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0))
         for c in ("x1", "x2", "e2")}
    design = squared.join(scale, "ccaa_slug").withColumns(z).select(
        "ccaa_slug", F.lit(1.0).alias("one"), F.col("z_x1").alias("a"), F.col("z_x2").alias("b"),
        (F.col("z_x1") * F.col("z_x1")).alias("aa"), (F.col("z_x2") * F.col("z_x2")).alias("bb"),
        (F.col("z_x1") * F.col("z_x2")).alias("ab"), F.col("z_e2").alias("y"))
    share = explained_share(design, "ccaa_slug", ["one", "a", "b", "aa", "bb", "ab"], "y")
    found = share.select("ccaa_slug", "n", "k", (F.col("n") * F.col("r2")).alias("lm"))
    return found.withColumn("p", tails.chi2_column(F.col("lm"), F.col("k")))


def scale_location(rows: DataFrame, min_rows: int = 50) -> DataFrame:
    """Residual diagnostics with a trailing mean over the order of fitted values.

    The window is max(20, n / 20) rows and at least 5 are needed. A running sum
    per row, differenced against the row one window earlier, gives the mean: no
    region is sorted whole.
    """
    errors = residuals(rows, ols(rows, min_rows=min_rows))
    spread = errors.groupBy("ccaa_slug").agg(F.stddev_samp("residuo").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    rows = errors.join(spread, "ccaa_slug").select(
        "ccaa_slug", "ajustado", "residuo", F.greatest(F.lit(20), F.floor(F.col("_n") / 20)).alias("_w"),
        F.sqrt(F.abs(F.col("residuo") / (F.col("_sd") + 1e-9))).alias("escala"), F.lit(1).alias("uno"))
    placed = running_sums(rows, ["ccaa_slug"], "ajustado", ["uno", "escala"], ["residuo"]).withColumnsRenamed({"_run_uno": "orden", "_run_escala": "_run"})
    earlier = placed.select("ccaa_slug", (F.col("orden") + F.col("_w")).alias("orden"), F.col("_run").alias("_then"))
    size = F.least(F.col("orden"), F.col("_w"))
    mean = (F.col("_run") - F.coalesce(F.col("_then"), F.lit(0.0))) / size
    return placed.join(earlier, ["ccaa_slug", "orden"], "left").select(
        "ccaa_slug", "orden", "ajustado", "residuo", "escala", F.when(size >= 5, mean).alias("tendencia"))


# --- rank tests ---------------------------------------------------------------------

def spearman(pairs: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rank correlation of x and y per region over positive pairs.

    Ranks are made per distinct value and joined to the distinct pairs, so ties
    and hot values never gather in one window.
    """
    counted = pairs.where((F.col("x") > 0) & (F.col("y") > 0)).groupBy("ccaa_slug", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))

    def ranks(column: str) -> DataFrame:
        values = counted.groupBy("ccaa_slug", F.col(column).alias("value")).agg(F.sum("n").alias("n"))
        return mid_ranks(values, ["ccaa_slug"]).select(
            "ccaa_slug", F.col("value").alias(column), F.col("rank").alias(f"_r{column}"), F.col("total").alias(f"_t{column}"))

    ranked = counted.join(ranks("x"), ["ccaa_slug", "x"]).join(ranks("y").drop("_ty"), ["ccaa_slug", "y"])
    middle = (F.col("_tx") + 1) / 2.0
    dx, dy, w = F.col("_rx") - middle, F.col("_ry") - middle, F.col("n")
    sums = ranked.groupBy("ccaa_slug").agg(
        F.max("_tx").alias("n"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"))
    rho = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_yy")), F.lit(0.0))
    return sums.where(F.col("n") >= min_rows).withColumn("rho", rho).drop("_xy", "_xx", "_yy")


def spearman_table(pairs: DataFrame) -> DataFrame:
    r = F.least(F.greatest(F.col("rho"), F.lit(-1.0)), F.lit(1.0))
    t = r * F.sqrt((F.col("n") - 2) / F.nullif((1 - r) * (1 + r), F.lit(0.0)))
    p = F.when(F.abs(r) == 1, 0.0).otherwise(tails.t_column(t, F.col("n") - 2))
    return spearman(pairs).withColumn("p", p).withColumn(
        "signif", F.when(F.col("p") < ALPHA, "Sí").otherwise("No"))


def _ties(scope: list[str], ranked: DataFrame, *aggs: Column) -> DataFrame:
    t = F.col("n").cast("double")
    total = [F.max("total").alias("n_all"), F.sum(t * t * t - t).alias("_ties"), *aggs]
    return ranked.groupBy(*scope).agg(*total)


def kruskal(values: DataFrame, scope: list[str], min_rows: int = 20) -> DataFrame:
    """Kruskal-Wallis H between chapters, corrected for ties.

    One row per distinct value carries the counts of the nine chapters, so the
    rank sums need no join back to the observations.
    """
    kept = large_groups(values, [*scope, "capitulo_id"], min_rows)
    chapters = [c for c, _, _ in ref.CHAPTERS]
    counts = kept.groupBy(*scope, "value").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("capitulo_id") == c).alias(f"_c{c}") for c in chapters])
    sums = _ties(scope, mid_ranks(counts, scope), *[F.sum(f"_c{c}").alias(f"_n{c}") for c in chapters],
                 *[F.sum(F.col("rank") * F.col(f"_c{c}")).alias(f"_r{c}") for c in chapters])
    n = F.col("n_all").cast("double")
    groups = _sum([F.when(F.col(f"_n{c}") > 0, 1).otherwise(0) for c in chapters])
    squares = _sum([F.when(F.col(f"_n{c}") > 0, F.col(f"_r{c}") * F.col(f"_r{c}") / F.nullif(
        F.col(f"_n{c}"), F.lit(0))).otherwise(0.0) for c in chapters])
    h = (12 / (n * (n + 1)) * squares - 3 * (n + 1)) / F.nullif(
        1 - F.col("_ties") / (n * n * n - n), F.lit(0.0))
    return sums.select(*scope, groups.alias("n_capitulos"), F.col("n_all").alias("n"), h.alias("h")).where(
        F.col("n_capitulos") >= 2)


def kruskal_table(values: DataFrame, scope: list[str]) -> DataFrame:
    return kruskal(values, scope).withColumn(
        "p", tails.chi2_column(F.col("h"), F.col("n_capitulos") - 1)).withColumn(
        "conclusion", F.when(F.col("p") < ALPHA, "Difieren").otherwise("Iguales"))


def mann_whitney(values: DataFrame, scope: list[str], min_rows: int = 20) -> DataFrame:
    """U of current against capital spending, with its tie-corrected z."""
    kinds = {c: ("corriente" if c <= 4 else "capital") for c in (1, 2, 3, 4, 6, 7)}
    kind = lookup(kinds, F.col("capitulo_id"))
    rows = values.withColumn("tipo", kind).where(F.col("tipo").isNotNull())
    counts = rows.groupBy(*scope, "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tipo") == "corriente").alias("_a"))
    sums = _ties(scope, mid_ranks(counts, scope), F.sum("_a").alias("n_corr"),
                 F.sum(F.col("rank") * F.col("_a")).alias("_r"))
    n1, n = F.col("n_corr").cast("double"), F.col("n_all").cast("double")
    n2 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    tests = sums.select(
        *scope, "n_corr", (F.col("n_all") - F.col("n_corr")).alias("n_capital"), u.alias("u"), z.alias("z"),
    ).where((F.col("n_corr") >= min_rows) & (F.col("n_capital") >= min_rows))
    medians = group_medians(rows, [*scope, "tipo"], "value")
    paired = medians.groupBy(*scope).agg(
        F.max(F.when(F.col("tipo") == "corriente", F.col("median"))).alias("mediana_corr"),
        F.max(F.when(F.col("tipo") == "capital", F.col("median"))).alias("mediana_capital"))
    return tests.join(paired, scope)


def mann_whitney_table(values: DataFrame, scope: list[str]) -> DataFrame:
    p = F.least(F.lit(1.0), 2 * tails.normal_tail_native(F.col("z")))
    direction = (
        F.when(F.col("p") >= ALPHA, "Sin diferencia")
        .when(F.col("mediana_capital") < F.col("mediana_corr"), "Capital ejecuta menos")
        .otherwise("Capital ejecuta más"))
    return mann_whitney(values, scope).withColumn("p", p).withColumn("direccion", direction)


# --- summary ---------------------------------------------------------------------------

def rejections(tests: DataFrame) -> DataFrame:
    """Regions tested and regions that reject, per hypothesis; needs `hipotesis`
    and `rechaza`."""
    return tests.groupBy("hipotesis").agg(
        F.count("rechaza").alias("n"), F.count_if("rechaza").alias("n_rechaza"),
        (F.count_if("rechaza") / F.nullif(F.count("rechaza"), F.lit(0))).alias("cuota"))

"""Cross-product sums per group, and what is solved from them.

Tasks reduce their rows to one small matrix per group with numpy, Spark adds the
matrices, and only those sums are solved: a group of any size costs the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups a task holds before it passes its sums on.
HELD_GROUPS = 2000


def gram(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, gram): sums of all products of two columns per group, row by row.

    Columns are doubles without NULL; keys are texts.
    """
    size = len(columns)

    def reduce_rows(batches):
        held: dict = {}

        def flush():
            rows = [(*key, *np.ravel(g)) for key, g in held.items()]
            held.clear()
            return pd.DataFrame(
                [(*r[: len(keys)], list(r[len(keys):])) for r in rows], columns=[*keys, "gram"])

        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                x = part[columns].to_numpy(dtype=float)
                held[key] = held.get(key, 0) + x.T @ x
            if len(held) > HELD_GROUPS:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join([*[f"{k} string" for k in keys], "gram array<double>"])
    parts = df.select(*keys, *columns).mapInPandas(reduce_rows, schema)
    cells = parts.select(*keys, F.posexplode("gram").alias("_at", "_v"))
    sums = cells.groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    # size × size cells per group.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda c: c["_v"]).alias("gram")
    return (sums.groupBy(*keys) if keys else sums.groupBy()).agg(listed).where(F.size("gram") == size * size)


def _square(flat) -> np.ndarray:
    size = int(round(len(flat) ** 0.5))
    return np.asarray(flat, dtype=float).reshape(size, size)


def explained_share(df: DataFrame, key: str, regressors: list[str], target: str) -> DataFrame:
    """(key, n, k, r2) of the regression of target on the regressors, whose
    first is the constant; k counts independent regressors without it."""
    def solve(batches):
        for pdf in batches:
            out = []
            for name, flat in zip(pdf[key], pdf["gram"]):
                g = _square(flat)
                n, xx, xy, yy = g[0, 0], g[:-1, :-1], g[:-1, -1], g[-1, -1]
                total = yy - xy[0] ** 2 / n
                fitted = xy @ np.linalg.pinv(xx, rcond=1e-12) @ xy - xy[0] ** 2 / n
                rank = int(np.linalg.matrix_rank(xx, tol=1e-9 * n))
                out.append((name, int(n), rank - 1, float(fitted / total) if total > 0 else None))
            yield pd.DataFrame(out, columns=[key, "n", "k", "r2"])

    return gram(df, [key], [*regressors, target]).mapInPandas(solve, f"{key} string, n bigint, k int, r2 double")


def pairwise_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for the lower triangle, each over the rows where both are known.

    One matrix holds all that is needed: the products of values, presence marks
    and squares of every two columns.
    """
    size = len(columns)
    value = [F.coalesce(c, F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)]
    known = [F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0).alias(f"m{i}") for i, c in enumerate(columns)]
    square = [F.coalesce(F.col(c) * F.col(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)]
    wide = df.select(*value, *known, *square)

    def solve(batches):
        for pdf in batches:
            out = []
            for flat in pdf["gram"]:
                g = _square(flat)
                v, m, s = slice(0, size), slice(size, 2 * size), slice(2 * size, 3 * size)
                n, sums, squares, products = g[m, m], g[v, m], g[s, m], g[v, v]
                for i in range(size):
                    for j in range(i):
                        c = n[i, j]
                        if c < 2:
                            continue
                        cov = products[i, j] - sums[i, j] * sums[j, i] / c
                        vx = squares[i, j] - sums[i, j] ** 2 / c
                        vy = squares[j, i] - sums[j, i] ** 2 / c
                        if vx > 0 and vy > 0:
                            out.append((columns[i], columns[j], cov / np.sqrt(vx * vy)))
            yield pd.DataFrame(out, columns=["x", "y", "r"])

    return gram(wide, [], wide.columns).mapInPandas(solve, "x string, y string, r double")


def fit_linear(design: DataFrame, key: str, numeric: list[str], flags: list[str], target: str,
               alpha: float) -> DataFrame:
    """(key, intercept, weights): least squares with an L2 penalty on
    standardised numeric columns and 0/1 flags, the intercept free. The weights
    apply to the columns as given, numeric first."""
    columns = [*numeric, *flags]

    def solve(batches):
        for pdf in batches:
            out = []
            for name, flat in zip(pdf[key], pdf["gram"]):
                g = _square(flat)
                n, mean = g[0, 0], g[0, 1:] / g[0, 0]
                centred = g[1:, 1:] - n * np.outer(mean, mean)
                spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0) / n)
                scale = np.ones(len(columns))
                scale[: len(numeric)] = spread[: len(numeric)]
                scale[scale <= 1e-12] = 1.0
                xx = centred[:-1, :-1] / np.outer(scale, scale)
                xy = centred[:-1, -1] / scale
                if alpha > 0:
                    weights = np.linalg.solve(xx + alpha * np.eye(len(columns)), xy) / scale
                else:
                    weights = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy / scale
                out.append((name, float(mean[-1] - mean[:-1] @ weights), weights.tolist()))
            yield pd.DataFrame(out, columns=[key, "intercept", "weights"])

    rows = design.select(key, F.lit(1.0).alias("_one"), *columns, F.col(target).cast("double").alias("_y"))
    return gram(rows, [key], ["_one", *columns, "_y"]).mapInPandas(
        solve, f"{key} string, intercept double, weights array<double>")


def linear_value(columns: list[str]) -> Column:
    """Fitted value of a row next to its group's intercept and weights."""
    total = F.col("intercept")
    for i, c in enumerate(columns):
        total = total + F.get("weights", F.lit(i)) * F.col(c)
    return total


def normal_equations(rows: DataFrame, fit: DataFrame, key: str, numeric: list[str], flags: list[str], target: str, alpha: float) -> DataFrame:
    """(key, columna, residuo): what is left of each normal equation of a fit, as a share of the sizes of its column and
    target. Zero for a least-squares fit, whatever the rows; the intercept has an equation too."""
    columns = [*numeric, *flags]
    left = rows.join(fit, key).withColumn("_r", F.col(target) - linear_value(columns))
    n = F.count(F.lit(1))
    sums = left.groupBy(key).agg(
        n.alias("_n"), F.avg("_r").alias("_mean"), F.var_pop(target).alias("_vy"), F.max("weights").alias("weights"),
        *[F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(columns)], *[F.covar_pop(c, "_r").alias(f"_c{i}") for i, c in enumerate(columns)])

    def share(i: int):
        spread = F.sqrt(f"_v{i}")
        scale = F.when(spread > 1e-12, spread).otherwise(F.lit(1.0)) if i < len(numeric) else F.lit(1.0)
        rest = F.col("_n") * F.col(f"_c{i}") / scale - alpha * F.get("weights", F.lit(i)) * scale
        return F.coalesce(rest / F.nullif(F.col("_n") * F.sqrt(F.col("_vy")) * spread / scale, F.lit(0.0)), F.lit(0.0))
    parts = [F.struct(F.lit("").alias("columna"), F.coalesce(F.col("_mean") / F.nullif(F.sqrt("_vy"), F.lit(0.0)), F.lit(0.0)).alias("residuo"))]
    parts += [F.struct(F.lit(c).alias("columna"), share(i).alias("residuo")) for i, c in enumerate(columns)]
    return sums.select(key, F.inline(F.array(*parts)))

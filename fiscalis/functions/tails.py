"""Tail probabilities: of the normal distribution as Spark expressions, the others
on one row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15
DURBIN_SIZE = 400  # rows of the largest matrix that is raised to a power


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, else a continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for part in (even, odd):
            d = 1 / (1 + part * d or 1e-300)
            c = 1 + part / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return front * h


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_part(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def kolmogorov_tail(d: float, n: float) -> float:
    """Large-sample Kolmogorov probability with the usual small-sample factor."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def _scaled(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """The matrix with its largest entry near 1, and the power of two that was taken out."""
    by = math.frexp(float(np.abs(matrix).max()))[1]
    return matrix * 2.0 ** -by, by


def kolmogorov_exact(d: float, n: float) -> float:
    """P(D >= d) for n values by the power of Durbin's matrix.

    Where the matrix would be large the probability is far in a tail: there, and beyond `DURBIN_SIZE`
    rows, the large-sample series with its correction stands in.
    """
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    s = n * d * d
    if s > 18:
        return min(1.0, 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s))
    k = math.ceil(n * d)
    size = 2 * k - 1
    if size > DURBIN_SIZE:
        return kolmogorov_tail(d, n)
    h = k - n * d
    i, j = np.indices((size, size))
    matrix = (i - j + 1 >= 0).astype(float)
    powers = h ** np.arange(1, size + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** size
    logs = np.cumsum(np.log(np.arange(1, size + 1)))  # of the factorials
    with np.errstate(over="ignore"):
        matrix = np.where(i - j + 1 > 0, matrix / np.exp(logs[np.clip(i - j, 0, size - 1)]), matrix)
    # matrix^n with the exponents of two kept apart, and n! / n^n by logarithms.
    result, shift, base, base_shift, left = np.eye(size), 0, matrix, 0, int(n)
    while left:
        if left & 1:
            result, shift = result @ base, shift + base_shift
        base, base_shift, left = base @ base, 2 * base_shift, left >> 1
        result, by = _scaled(result)
        shift += by
        base, by = _scaled(base)
        base_shift += by
    below = result[k - 1, k - 1]
    if below <= 0:
        return 1.0
    log = math.log(below) + shift * math.log(2) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, max(0.0, 1 - math.exp(min(log, 0.0))))


# --- the normal distribution as expressions ----------------------------------------

SERIES_TERMS, FRACTION_TERMS, SPLIT = 50, 40, 2.0


def _nested(x: Column) -> tuple[Column, Column]:
    """erfc of x >= 0, from its series and from its continued fraction."""
    t = 2 * x * x
    series = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = 1 + t / float(2 * k + 1) * series
    fraction = x
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = x + (k / 2) / fraction
    return 1 - 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * series, F.exp(-x * x) / math.sqrt(math.pi) / fraction


def normal_tail_native(z: Column) -> Column:
    """P(Z > z) inside generated code; `z` should be a column, not a long expression, as it is read often.

    The error is below 1e-14, and below 1e-11 of the value for z up to 37.
    """
    x = F.abs(z) / math.sqrt(2)
    low, high = _nested(x)
    half = F.when(x < SPLIT, low).otherwise(high) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


# A rational start of the normal quantile, good to 4.5e-4 (Abramowitz and Stegun 26.2.23).
QUANTILE_TOP, QUANTILE_BOTTOM = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def with_normal_quantile(df, p: str, name: str):
    """Add the value below which a share p of the normal distribution lies, to 1e-13.

    A rational start and two steps of Halley's method, each a projection of its own, so that
    no expression is written out twice.
    """
    tail = F.least(F.col(p), 1 - F.col(p))
    df = df.withColumn("_tail", tail).withColumn("_t", F.sqrt(-2 * F.ln("_tail")))
    t = F.col("_t")
    top = QUANTILE_TOP[0] + t * (QUANTILE_TOP[1] + t * QUANTILE_TOP[2])
    bottom = QUANTILE_BOTTOM[0] + t * (QUANTILE_BOTTOM[1] + t * (QUANTILE_BOTTOM[2] + t * QUANTILE_BOTTOM[3]))
    df = df.withColumn("_x", t - top / bottom)
    for _ in range(2):
        df = df.withColumn("_e", (normal_tail_native(F.col("_x")) - F.col("_tail")) * math.sqrt(2 * math.pi) * F.exp(F.col("_x") * F.col("_x") / 2))
        df = df.withColumn("_x", F.col("_x") + F.col("_e") / (1 - F.col("_x") * F.col("_e") / 2))
    return df.withColumn(name, F.when(F.col(p) < 0.5, -F.col("_x")).otherwise(F.col("_x"))).drop("_tail", "_t", "_x", "_e")


def _column(function, *args: Column) -> Column:
    """Evaluate a tail function on a small result, NULL where an input is NULL."""
    def batch(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([
            None if any(v is None or np.isnan(v) for v in row) else function(*map(float, row)) for row in rows
        ], dtype="float64")

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return batch(a, b, c)

    typed = [a.cast("double") for a in args]
    return F.pandas_udf((one, two, three)[len(args) - 1], "double")(*typed)


def chi2_column(x: Column, df: Column) -> Column:
    return _column(chi2_tail, x, df)


def f_column(x: Column, d1: Column, d2: Column) -> Column:
    return _column(f_tail, x, d1, d2)


def t_column(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def kolmogorov_column(d: Column, n: Column) -> Column:
    return _column(kolmogorov_tail, d, n)


def kolmogorov_exact_column(d: Column, n: Column) -> Column:
    return _column(kolmogorov_exact, d, n)

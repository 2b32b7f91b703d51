"""Correlations and trend lines."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import correlation as pearson
from worthline.operators.gram import correlation, moments_by
from worthline.operators.impute import impute_median
from worthline.session import written


#: Degrees from which the tail follows the normal law with corrections.
MANY_DEGREES = 10_000


def t_tail(r: float, n: int) -> float:
    """Two-sided p of a correlation ``r`` over ``n`` rows (t distribution, n-2 degrees).

    The incomplete beta function of 1 - r*r by its continued fraction; for many degrees, where that
    takes long, the normal tail at a corrected place (Hill 1970).
    """
    if n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    degrees = n - 2
    if degrees >= MANY_DEGREES:
        a = degrees - 0.5
        b = 48.0 * a * a
        y = -a * log1p(-r * r)
        z = sqrt(y) * (1.0 + (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b))
        return erfc(z / sqrt(2.0))
    a, b, x = degrees / 2.0, 0.5, 1.0 - r * r
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log1p(-r * r) + b * log(r * r)) if r else 0.0
    if not front:
        return 1.0 if not r else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, from the top down (modified Lentz)."""
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1.0 + step * d), 1.0 + step / c
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def pearson_vs_target(df: DataFrame, columns: Sequence[str], target: str, **options) -> DataFrame:
    """r, p and abs(r) of each column with the target, strongest first.

    Nulls become the column median; columns without any value and constant columns are left out.
    """
    narrow = written(df.select(*columns, target), "correlated")
    filled = impute_median(narrow, [*columns, target], stable=True, **options)
    row = filled.agg(F.count("*").alias("n"), *[pearson(c, target).alias(c) for c in columns]).first()
    found = [(c, row[c]) for c in columns if row[c] is not None and row[c] == row[c]]
    rows = [(c, float(r), t_tail(float(r), row["n"]), abs(float(r))) for c, r in found]
    rows.sort(key=lambda x: (-x[3], x[0]))
    return df.sparkSession.createDataFrame(rows, "variable string, correlation double, p_value double, correlation_abs double")


def corr_matrix_top(df: DataFrame, columns: Sequence[str], target: str, top: int = 15, **options) -> DataFrame:
    """Lower triangle (row, column, r) over the ``top`` strongest columns and the target."""
    names = [*columns, target]
    filled = impute_median(written(df.select(*names), "correlated"), names, stable=True, **options)
    present = filled.agg(*[F.count(c).alias(c) for c in columns]).first()
    names = [c for c in columns if present[c]] + [target]
    (moments,) = moments_by(filled, names).values()
    table = correlation(moments)
    strength = np.nan_to_num(np.abs(table[-1, :-1]), nan=-1.0)
    order = [i for i in sorted(range(len(strength)), key=lambda i: (-strength[i], names[i])) if strength[i] >= 0]
    chosen = [*order[:top], len(names) - 1]
    rows = [(names[i], names[j], float(table[i, j])) for at, i in enumerate(chosen) for j in chosen[:at]]
    return df.sparkSession.createDataFrame(rows, "row string, column string, r double")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line y ~ x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))

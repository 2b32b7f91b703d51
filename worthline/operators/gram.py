"""Centred cross-product sums per group in one pass, and the models that need nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.operators.partials import collect_sums, keyed, matrix, sum_by_key


@dataclass
class Moments:
    """n, mean vector and centred cross products of the columns in order."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __sub__(self, part: "Moments") -> "Moments":
        """Moments of the rows that are not in ``part``."""
        n = self.n - part.n
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.cross))
        mean = (self.n * self.mean - part.n * part.mean) / n
        shift = part.mean - mean
        cross = self.cross - part.cross - np.outer(shift, shift) * part.n * n / self.n
        return Moments(n, mean, cross)

    def __add__(self, part: "Moments") -> "Moments":
        n = self.n + part.n
        if n == 0:
            return self
        shift = part.mean - self.mean
        mean = self.mean + shift * part.n / n
        cross = self.cross + part.cross + np.outer(shift, shift) * self.n * part.n / n
        return Moments(n, mean, cross)


def gram_table(df: DataFrame, columns: Sequence[str], key_schema: str, centre: Sequence[float]) -> DataFrame:
    """Per key the sums [n, sums of (x - centre), cross products of (x - centre)], rows with nulls left out."""
    columns, centre = list(columns), np.asarray(centre, dtype=float)
    names = [part.split()[0] for part in key_schema.split(",")]

    def sums(batch):
        batch = batch.dropna(subset=columns)
        for key, part in batch.groupby(names, sort=False):
            x = matrix(part, columns) - centre
            yield tuple(key), np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    return sum_by_key(df.select(*names, *columns), key_schema, sums)


def moment_sums(df: DataFrame, columns: Sequence[str], segment: str | None = None, fold: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """The table of ``gram_table`` by (_seg, _fold), and the centre that its sums are taken from.

    A first pass gives the centre, against cancellation.
    """
    centre = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in centre])
    source = keyed(df, segment).withColumn("_fold", F.col(fold).cast("int") if fold else F.lit(0))
    return gram_table(source, columns, "_seg string, _fold int", centre), centre


def moments_of(sums: np.ndarray, centre: np.ndarray) -> Moments:
    """Moments from one row of sums."""
    p = len(centre)
    n, total, cross = sums[0], sums[1 : p + 1], sums[p + 1 :].reshape(p, p)
    mean = total / n
    return Moments(n, mean + centre, cross - n * np.outer(mean, mean))


def moments_by(
    df: DataFrame, columns: Sequence[str], segment: str | None = None, fold: str | None = None
) -> dict[tuple[str, int], Moments]:
    """{(segment, fold): Moments}."""
    table, centre = moment_sums(df, columns, segment, fold)
    return {key: moments_of(sums, centre) for key, sums in collect_sums(table).items()}


def correlation(moments: Moments) -> np.ndarray:
    std = np.sqrt(np.diag(moments.cross))
    with np.errstate(divide="ignore", invalid="ignore"):
        return moments.cross / np.outer(std, std)


def least_squares(moments: Moments) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the last column on the others."""
    xx, xy = moments.cross[:-1, :-1], moments.cross[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    coef = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale
    return coef, moments.mean[-1] - coef @ moments.mean[:-1]


def linear_regression_by(
    df: DataFrame, features: Sequence[str], target: str, segment: str | None = None
) -> DataFrame:
    """Least squares per segment: (segment, term, coefficient), the constant under ``(intercept)``."""
    rows = []
    for (seg, _), m in sorted(moments_by(df, [*features, target], segment).items()):
        coef, constant = least_squares(m)
        rows += [(seg, f, float(c)) for f, c in zip(features, coef)] + [(seg, "(intercept)", float(constant))]
    return df.sparkSession.createDataFrame(rows, "segment string, term string, coefficient double")


def linear_expression(coefficients: dict[str, float], constant: float):
    return sum((F.col(c) * F.lit(float(b)) for c, b in coefficients.items()), F.lit(float(constant)))

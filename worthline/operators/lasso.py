"""Cross-validated L1 regression from grouped moments: one data pass for all segments, folds and alphas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.operators.gram import Moments, moment_sums, moments_of
from worthline.operators.split import kfold

# Exponents of the least and greatest penalty, and how many are tried.
ALPHA_EXPONENTS = (-4, 2)
ALPHA_EXPONENTS_WIDE = (-6, 2)
ALPHA_COUNT = 100
HELD_OUT = -1


@dataclass
class LassoFit:
    """Coefficients on standardised features, the penalty chosen and the scores."""

    coefficients: np.ndarray
    intercept: float
    alpha: float
    cv_mse: np.ndarray
    train_r2: float
    test_r2: float | None
    n: float


def alpha_grid(exponents: tuple[int, int] = ALPHA_EXPONENTS, count: int = ALPHA_COUNT) -> np.ndarray:
    return np.logspace(*exponents, count)


def coordinate_descent(gram, xy, alpha, start, max_steps=5000, tolerance=1e-9):
    """Minimise w'Gw/2 - c'w + alpha |w|_1 one coefficient at a time.

    Only the coefficients that are not zero are gone round, until none moves; then those that should
    not be zero join them, until there are none.
    """
    w = start.copy()
    usable = np.diag(gram) > 0
    active = usable & (w != 0)
    rest = xy - gram @ w
    for _ in range(max_steps):
        moved = 0.0
        for j in np.flatnonzero(active):
            rho = rest[j] + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            if new != w[j]:
                rest -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tolerance * max(1.0, np.abs(w).max()):
            joining = usable & ~active & (np.abs(rest) > alpha * (1 + 1e-12) + 1e-15)
            if not joining.any():
                break
            active |= joining
    return w


def path(moments: Moments, scale: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coefficients for every penalty, strongest first so that each starts from its neighbour."""
    gram = moments.cross[:-1, :-1] / np.outer(scale, scale) / moments.n
    xy = moments.cross[:-1, -1] / scale / moments.n
    out = np.zeros((len(alphas), len(xy)))
    w = np.zeros(len(xy))
    for i in np.argsort(alphas)[::-1]:
        w = coordinate_descent(gram, xy, alphas[i], w)
        out[i] = w
    return out


def squared_error(w: np.ndarray, fitted: Moments, scored: Moments, scale: np.ndarray) -> float:
    """Sum of squared errors on ``scored`` of the model fitted on ``fitted``."""
    beta = w / scale
    shift = scored.mean[-1] - fitted.mean[-1] - beta @ (scored.mean[:-1] - fitted.mean[:-1])
    c = scored.cross
    return float(scored.n * shift**2 + c[-1, -1] - 2 * beta @ c[:-1, -1] + beta @ c[:-1, :-1] @ beta)


def lasso_cv(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    segment: str | None = None,
    alphas: np.ndarray | None = None,
    folds: int = 5,
    split: str | None = None,
    min_rows: int = 10,
) -> dict[str, LassoFit]:
    """Fit per segment. Rows marked ``test`` in ``split`` only score; segments under ``min_rows`` are left out.

    One pass gives the moments of every segment and fold; they stay on the executors, where each segment
    is solved in a task of its own. Only coefficients and scores come back.
    """
    table = lasso_table(df, features, target, key, segment, alphas, folds, split, min_rows)
    fits = {}
    for r in sorted(table.collect(), key=lambda r: r["segment"]):
        fits[r["segment"]] = LassoFit(
            np.array(r["coefficients"]), r["intercept"], r["alpha"], np.array(r["cv_mse"]), r["train_r2"], r["test_r2"], r["n"]
        )
    return fits


def lasso_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    segment: str | None = None,
    alphas: np.ndarray | None = None,
    folds: int = 5,
    split: str | None = None,
    min_rows: int = 10,
) -> DataFrame:
    """(segment, alpha, coefficients, intercept, cv_mse, train_r2, test_r2, n): ``lasso_cv`` as a table."""
    alphas = alpha_grid() if alphas is None else alphas
    fold = kfold(key, folds)
    if split:
        fold = F.when(F.col(split) == "test", HELD_OUT).otherwise(fold)
    columns = [*features, target]
    sums, centre = moment_sums(df.withColumn("_fold_of", fold), columns, segment, "_fold_of")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        parts = {int(f): moments_of(np.asarray(v, dtype=float), centre) for f, v in zip(group["_fold"], group["sums"])}
        fit = fit_moments(parts, alphas, min_rows)
        if fit is None:
            return pd.DataFrame({c: [] for c in names})
        test = None if fit.test_r2 is None else float(fit.test_r2)
        return pd.DataFrame([[group["_seg"].iloc[0], fit.alpha, fit.coefficients, fit.intercept, fit.cv_mse, fit.train_r2, test, fit.n]], columns=names)

    names = ["segment", "alpha", "coefficients", "intercept", "cv_mse", "train_r2", "test_r2", "n"]
    kinds = "segment string, alpha double, coefficients array<double>, intercept double, cv_mse array<double>, train_r2 double, test_r2 double, n double"
    return sums.filter("_seg is not null").groupBy("_seg").applyInPandas(solve, kinds)


def fit_moments(parts: dict[int, Moments], alphas: np.ndarray, min_rows: int) -> LassoFit | None:
    """The fit of one segment from the moments of its folds (and of its test rows, under ``HELD_OUT``)."""
    held = {f: m for f, m in parts.items() if f != HELD_OUT}
    test = parts.get(HELD_OUT)
    if not held:
        return None
    total = sum_moments(list(held.values()))
    if total.n + (test.n if test else 0) < min_rows:
        return None
    std = np.sqrt(np.diag(total.cross)[:-1] / total.n)
    std = np.where(std > 0, std, 1.0)
    errors = np.zeros(len(alphas))
    for part in held.values():
        rest = total - part
        if rest.n < 2:
            continue
        for i, w in enumerate(path(rest, std, alphas)):
            errors[i] += squared_error(w, rest, part, std) / part.n
    errors /= max(len(held), 1)
    best = int(errors.argmin())
    w = path(total, std, alphas[best:])[0]
    return LassoFit(
        w,
        float(total.mean[-1] - (w / std) @ total.mean[:-1]),
        float(alphas[best]),
        errors,
        float(r_squared(w, total, total, std)),
        float(r_squared(w, total, test, std)) if test else None,
        float(total.n),
    )


def sum_moments(parts: list[Moments]) -> Moments:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def r_squared(w, fitted: Moments, scored: Moments, scale) -> float:
    spread = scored.cross[-1, -1]
    return 1 - squared_error(w, fitted, scored, scale) / spread if spread > 0 else 0.0


def importance(spark, fits: dict[str, LassoFit], features: Sequence[str]) -> DataFrame:
    """(segment, variable, coefficient, importance)."""
    rows = [(seg, f, float(c), abs(float(c))) for seg, fit in fits.items() for f, c in zip(features, fit.coefficients)]
    return spark.createDataFrame(rows, "segment string, variable string, coefficient double, importance double")


def scores(spark, fits: dict[str, LassoFit]) -> DataFrame:
    rows = [(seg, fit.alpha, float(fit.cv_mse.min()), fit.train_r2, fit.test_r2, int(fit.n)) for seg, fit in fits.items()]
    return spark.createDataFrame(rows, "segment string, alpha double, cv_mse double, train_r2 double, test_r2 double, n_train int")

"""Accuracy of regressions, by segment and split, in one grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import column, ratio
from worthline.operators import quantiles
from worthline.operators.lookup import checked_small, lookup_join

OVERFIT_LIMIT = 2.0
SMALL_SHARE = 0.01


def _group_sums(df: DataFrame, keys: Sequence[str], real: str, predicted: str) -> DataFrame:
    error = F.col(real) - F.col(predicted)
    return df.filter(F.col(predicted).isNotNull() & F.col(real).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(real).alias("_var"),
        F.avg(F.abs(real)).alias("_level"),
    )


def _scores(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R2 of a constant target is 1 if it is met exactly and else 0; of a single row it is null."""
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n") > 1, F.when(F.col("_var") == 0, constant).otherwise(1 - ratio("mse", "_var")))
    return sums.select(*keys, "n", r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def _mape(df: DataFrame, sums: DataFrame, keys: Sequence[str], real: str, predicted: str) -> DataFrame:
    levels = sums.select(*keys, "_level")
    rows = df.select(*keys, real, predicted)
    joined = lookup_join(rows, levels, list(keys), "inner", null_safe=True) if keys else rows.withColumn("_level", levels.select("_level").scalar())
    size = F.abs(real)
    counted = F.when(size > F.col("_level") * SMALL_SHARE, F.abs(F.col(real) - F.col(predicted)) / size)
    return joined.groupBy(*keys).agg((F.avg(counted) * 100).alias("mape"))


def regression_metrics(df: DataFrame, keys: Sequence[str], real: str = "value", predicted: str = "predicted") -> DataFrame:
    """n, R2, MAE, MSE and RMSE per group; rows without a prediction are left out."""
    return _scores(_group_sums(df, keys, real, predicted), keys)


def safe_mape(df: DataFrame, keys: Sequence[str], real: str = "value", predicted: str = "predicted") -> DataFrame:
    """MAPE per group over rows whose actual value exceeds 1 % of the group's mean absolute value.

    The group means are a small table joined back, so no group is gathered in one task.
    """
    return _mape(df, _group_sums(df, keys, real, predicted), keys, real, predicted)


def overfit_ratio(train, test, mode: str = "r2_abs") -> Column:
    """How much better the training score is.

    ``r2_abs``: train/test R2, its absolute value when test is negative, infinite when test is zero.
    ``r2``: the same quotient, infinite when test is not positive. ``rmse``: train/test RMSE.
    ``r2_inverse``: test/train R2, null when train is zero.
    """
    a, b = column(train), column(test)
    inf = F.lit(float("inf"))
    if mode == "r2_abs":
        return F.when(b > 0, ratio(a, b)).when(b == 0, F.when(a > 0, inf).otherwise(F.lit(1.0))).otherwise(F.abs(ratio(a, b)))
    if mode == "r2":
        return F.when(b > 0, ratio(a, b)).otherwise(inf)
    if mode == "rmse":
        return ratio(a, b)
    if mode == "r2_inverse":
        return ratio(b, a)
    raise ValueError(f"unknown mode: {mode}")


def residual_stats(df: DataFrame, keys: Sequence[str] = (), real: str = "value", predicted: str = "predicted") -> DataFrame:
    """Residual mean, std (population), min, max, and the means of real and predicted."""
    error = F.col(real) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.avg(error).alias("res_mean"),
        F.stddev_pop(error).alias("res_std"),
        F.min(error).alias("res_min"),
        F.max(error).alias("res_max"),
        F.avg(real).alias("real_mean"),
        F.avg(predicted).alias("pred_mean"),
    )


def within_pct_share(
    df: DataFrame, limits: Sequence[int] = (20, 50), real: str = "value", predicted: str = "predicted", **options
) -> DataFrame:
    """Share of rows predicted within each limit, and mean and median percentage error; zeros left out."""
    pct = df.filter(F.col(real) != 0).select((F.abs(F.col(real) - F.col(predicted)) / F.abs(real) * 100).alias("pct"))
    aggs = [(ratio(F.count_if(F.col("pct") <= k), F.count("*")) * 100).alias(f"within_{k}") for k in limits]
    return quantiles.aggregate(pct, [], [*aggs, F.avg("pct").alias("mean_pct")], {"median_pct": ("pct", 0.5)}, **options)


def segment_summary(scored: DataFrame, segment: str, split: str = "split", real: str = "value", predicted: str = "predicted", mode: str = "r2_abs") -> DataFrame:
    """One row per segment with train and test metrics and the overfit ratio, best test R2 first."""
    keys = [segment, split]
    sums = _group_sums(scored, keys, real, predicted)
    known = checked_small(sums)
    sums = sums if known is None else known
    other = _mape(scored, sums, keys, real, predicted).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    both = _scores(sums, keys).join(other, same).drop(*[f"_{k}" for k in keys])
    measures = ["n", "r2", "mae", "mse", "rmse", "mape"]
    wide = both.groupBy(segment).agg(
        *[F.max(F.when(F.col(split) == part, F.col(m))).alias(f"{part}_{m}") for part in ("train", "test") for m in measures]
    )
    pair = ("train_rmse", "test_rmse") if mode == "rmse" else ("train_r2", "test_r2")
    wide = wide.withColumn("overfit_ratio", overfit_ratio(*pair, mode))
    return wide.orderBy(F.desc_nulls_last("test_r2"), segment)


def problem_segments(summary: DataFrame, segment: str, limit: float = OVERFIT_LIMIT) -> DataFrame:
    """A row for each segment whose overfit ratio exceeds the limit, beside the mean ratio of all segments."""
    mean = summary.agg(F.avg("overfit_ratio")).scalar()
    return summary.filter(F.col("overfit_ratio") > limit).select(segment, "overfit_ratio", mean.alias("mean_ratio"))


def score_coverage(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    return df.agg(F.count(predicted).alias("n_scored"), F.count("*").alias("n"))

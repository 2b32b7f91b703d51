"""The numbers behind the charts, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import ratio
from worthline.operators import quantiles
from worthline.operators.lookup import lookup_join
from worthline.operators.ordering import number_rows
from worthline.operators.partials import sum_by_key
from worthline.session import written

GRID_POINTS = 100
#: Rows that meet the places of a grid at once.
KERNEL_ROWS = 10_000
WHISKER = 1.5


def histogram(df: DataFrame, column: str, bins: int = 30, keys: Sequence[str] = (), density: bool = False) -> DataFrame:
    """(keys, bin, low, high, n): equal-width bins between the group's least and greatest value.

    The last bin includes its upper edge and empty bins are listed. Rows are reduced to counts per
    bin before anything is shuffled.
    """
    keys = list(keys)
    values = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    limits = values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_total"))
    limits = limits.withColumns(
        {
            "_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    )
    if keys:
        joined = lookup_join(values, limits, keys, "inner", null_safe=True)
        rows = None
    else:
        row = limits.first()
        rows = [row]
        joined = values.withColumns({c: F.lit(row[c]) for c in ("_lo", "_hi", "_total")})
    place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = joined.groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = limits if rows is None else df.sparkSession.createDataFrame(rows, limits.schema)
    width = (F.col("_hi") - F.col("_lo")) / bins
    every = frame.select(
        *keys, "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("_lo"), width.alias("_w")
    )
    out = lookup_join(every, counts, [*keys, "bin"], "left", null_safe=True)
    n = F.coalesce(F.col("n"), F.lit(0))
    columns = [
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
        n.alias("n"),
    ]
    if density:
        columns.append((n / (F.col("_total") * F.col("_w"))).alias("density"))
    return out.select(*columns)


def box_stats(df: DataFrame, column: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """Quartiles, mean, whiskers (farthest values within 1.5 interquartile ranges) and outliers."""
    keys = list(keys)
    values = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    values = written(values, "box")
    cuts = quantiles.percentiles(values, ["_v"], [0.25, 0.5, 0.75], keys, stable=True, **options)
    cuts = cuts.select(*keys, *[F.element_at("_v", i).alias(f"q{i}") for i in (1, 2, 3)])
    if keys:
        joined = lookup_join(values, cuts, keys, "inner", null_safe=True)
    else:
        row = cuts.first()
        joined = values.withColumns({f"q{i}": F.lit(row[f"q{i}"]) for i in (1, 2, 3)})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("_v").alias("mean"),
        *[F.first(f"q{i}").alias(f"q{i}") for i in (1, 2, 3)],
        F.least(F.min(F.when(inside, F.col("_v"))), F.first("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("_v"))), F.first("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def density_grid(df: DataFrame, column: str, keys: Sequence[str] = (), points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density at ``points`` places from the least to the greatest value.

    Bandwidth n^(-1/5) times the sample deviation. Each task adds its rows to one vector of places per
    group, so rows are never copied and the shuffle carries a vector per task and group.
    """
    keys = list(keys)
    values = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    fit = values.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    fit = fit.filter("_s > 0").withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    if keys:
        joined = lookup_join(values, fit, keys, "inner", null_safe=True)
    else:
        row = fit.first()
        known = row.asDict() if row else {}
        joined = values.withColumns({c: F.lit(known.get(c)).cast("double") for c in ("_n", "_lo", "_hi", "_h")})
        joined = joined.filter("_h > 0")
    shape = ["_n", "_lo", "_hi", "_h"]
    places = np.arange(points) / (points - 1)

    def sums(batch):
        for key, part in batch.groupby([*keys, *shape], sort=False, dropna=False):
            low, high, width = key[-3:]
            grid, total = low + places * (high - low), np.zeros(points)
            values = part["_v"].to_numpy()
            for i in range(0, len(values), KERNEL_ROWS):
                u = (grid - values[i : i + KERNEL_ROWS, None]) / width
                total += np.exp(-0.5 * u * u).sum(axis=0)
            yield tuple(None if k != k else k for k in key), total

    rows = joined.select(*keys, F.col("_n").cast("long").alias("_n"), *[F.col(c) for c in shape[1:]], "_v")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, *shape])
    vectors = sum_by_key(rows, kinds, sums).select(*keys, *shape, F.posexplode("sums").alias("point", "_sum"))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    norm = F.lit((2 * 3.141592653589793) ** 0.5)
    return vectors.select(*keys, "point", x.alias("x"), (F.col("_sum") / (F.col("_n") * F.col("_h") * norm)).alias("density"))


def normal_quantiles(points: int = 99) -> list[float]:
    law = NormalDist()
    return [law.inv_cdf((i + 1) / (points + 1)) for i in range(points)]


def qq_points(df: DataFrame, column: str, keys: Sequence[str] = (), points: int = 99, **options) -> DataFrame:
    """(keys, point, theoretical, observed): quantiles of the column against those of a normal law."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    arrays = quantiles.percentiles(df, [column], probs, keys, **options)
    normal = F.array(*[F.lit(q) for q in normal_quantiles(points)])
    pairs = F.posexplode(F.arrays_zip(normal.alias("theoretical"), F.col(column).alias("observed")))
    return arrays.select(*keys, pairs.alias("point", "_p")).select(*keys, (F.col("point") + 1).alias("point"), "_p.theoretical", "_p.observed")


def identity_bounds(df: DataFrame, a: str = "value", b: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """End points of the diagonal of a real-against-predicted chart."""
    return df.groupBy(*keys).agg(F.least(F.min(a), F.min(b)).alias("low"), F.greatest(F.max(a), F.max(b)).alias("high"))


def bars_normalised(df: DataFrame, group: str, main: str, other: str, unit: float = 1e6) -> DataFrame:
    """Group means of two columns, the second stretched to the height of the first."""
    means = df.groupBy(group).agg((F.avg(main) / unit).alias("main_mean"), F.avg(other).alias("other_mean"))
    tops = means.agg(F.max("main_mean").alias("m"), F.max("other_mean").alias("o"))
    factor = tops.select(ratio("m", "o")).scalar()
    return means.withColumn("other_scaled", F.col("other_mean") * factor)


def metric_bars_normalised(summary: DataFrame, metrics: Sequence[str] = ("mae", "mse", "rmse")) -> DataFrame:
    """Train and test metrics on one axis: R2 as it is, MAPE as a share, others by the larger of the two."""

    def pair(metric):
        train, test = F.col(f"train_{metric}"), F.col(f"test_{metric}")
        if metric == "r2":
            return train, test
        if metric == "mape":
            return train / 100, test / 100
        top = F.greatest(train, test)
        zero = F.lit(0.0)
        return (F.when(top > 0, train / top).otherwise(zero), F.when(top > 0, test / top).otherwise(zero))

    rows = []
    for metric in ("r2", *metrics, "mape"):
        train, test = pair(metric)
        rows.append(F.struct(F.lit(metric).alias("metric"), train.alias("train"), test.alias("test")))
    keys = [c for c in summary.columns if not c.startswith(("train_", "test_")) and c != "overfit_ratio"]
    return summary.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def group_means(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Mean point of each group with the ranges of both axes over all groups."""
    means = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("x"),
        F.avg(y).alias("y"),
        *[f(c).alias(f"{a}_{name}") for c, a in ((x, "x"), (y, "y")) for name, f in (("min", F.min), ("max", F.max))],
    )
    edges = means.agg(
        *[f(f"{a}_{name}").alias(f"{a}_{name}") for a in ("x", "y") for name, f in (("min", F.min), ("max", F.max))]
    )
    ranges = edges.select(F.struct("*")).scalar()
    return means.select(group, "n", "x", "y", ranges.alias("_r")).select(group, "n", "x", "y", "_r.*")


def silhouette_profile(samples: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rising silhouettes of each cluster with their place in it."""
    ordered = number_rows(samples.select(key, label, "silhouette"), ["silhouette", key], [label], "place")
    return ordered.select(key, label, "place", "silhouette")


def scatter_bins(df: DataFrame, x: str, y: str, kind: Column, width: float) -> DataFrame:
    """A scatter chart over all rows: the number of points of each class in square bins of ``width``.

    Rows without either value are left out; bin i holds values from i to i + 1 times the width.
    """
    bins = [F.floor(F.col(c) / width).alias(f"{c}_bin") for c in (x, y)]
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*bins, kind.alias("kind"))
    return points.groupBy(f"{x}_bin", f"{y}_bin", "kind").agg(F.count("*").alias("n"))

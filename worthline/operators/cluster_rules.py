"""Rules that choose the number of clusters and rate a clustering. Inputs are small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthline.functions.scalars import cluster_band, overall_band, ratio

DEFAULT_K = 3


def second_difference(inertia: DataFrame, keys: Sequence[str] = (), k: str = "k", value: str = "inertia") -> DataFrame:
    """First and second differences of the inertia along K (one row per K)."""
    along = Window.partitionBy(*keys).orderBy(k)
    first = F.lead(value, 1).over(along) - F.col(value)
    second = F.lead(value, 2).over(along) - 2 * F.lead(value, 1).over(along) + F.col(value)
    return inertia.withColumns({"diff1": first, "diff2": second})


def elbow_k(inertia: DataFrame, keys: Sequence[str] = (), k: str = "k", value: str = "inertia", normalise: bool = False) -> DataFrame:
    """K of the elbow per group of ``keys``.

    The K farthest from the line between the first and last point. The largest second difference
    points to the K three places after its first; if the two differ by more than one, the
    smaller wins. Fewer than three points give 3. ``normalise`` puts both axes on 0..1 first.
    """
    group = Window.partitionBy(*keys)
    x, y = F.col(k).cast("double"), F.col(value).cast("double")
    if normalise:
        x = ratio(x - F.min(k).over(group), F.max(k).over(group) - F.min(k).over(group))
        y = ratio(y - F.min(value).over(group), F.max(value).over(group) - F.min(value).over(group))
    points = inertia.withColumns({"_x": x, "_y": y})
    points = points.withColumns(
        {
            "_x1": F.min_by("_x", k).over(group),
            "_x2": F.max_by("_x", k).over(group),
            "_y1": F.min_by("_y", k).over(group),
            "_y2": F.max_by("_y", k).over(group),
        }
    )
    up = F.col("_y2") - F.col("_y1")
    across = F.col("_x2") - F.col("_x1")
    area = up * F.col("_x") - across * F.col("_y") + F.col("_x2") * F.col("_y1") - F.col("_y2") * F.col("_x1")
    points = points.withColumn("distance", ratio(F.abs(area), F.sqrt(up * up + across * across)))
    points = second_difference(points, keys, k, value)
    # the difference that starts at place i selects place i + 2 of the list of K
    points = points.withColumn("_k_alt", F.lead(k, 2).over(Window.partitionBy(*keys).orderBy(k)))
    earliest = -F.col(k)
    best = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.max_by(k, F.struct("distance", earliest)).alias("_k_line"),
        F.max("distance").alias("distance"),
        F.max_by("_k_alt", F.when(F.col("diff2").isNotNull(), F.struct("diff2", earliest))).alias("_k_bend"),
    )
    differ = (F.col("n_points") >= 4) & (F.abs(F.col("_k_line") - F.col("_k_bend")) > 1)
    chosen = (
        F.when(F.col("n_points") < 3, F.lit(DEFAULT_K))
        .when(differ, F.least("_k_line", "_k_bend"))
        .otherwise(F.col("_k_line"))
    )
    return best.select(*keys, chosen.cast("int").alias("k"), "distance")


def choose_k(elbow, max_k):
    """The elbow has priority; at least 2 and at most ``max_k`` clusters."""
    return F.least(F.greatest(elbow, F.lit(2)), max_k)


def largest_k(n):
    """Most clusters tried for a table of n rows."""
    return F.least(F.lit(10), F.floor(n / 5))


def method_agreement(df: DataFrame, a: str = "k_elbow", b: str = "k_silhouette") -> DataFrame:
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("n_agree"), F.count("*").alias("n"))


def quality_totals(df: DataFrame) -> DataFrame:
    """Clusterings by overall quality, with the good, fair and poor clusters they hold."""
    rated = df.withColumn("quality", overall_band("good", "poor", "k"))
    out = rated.groupBy("quality").agg(
        F.count("*").alias("n"),
        F.sum("good").alias("n_good"),
        F.sum("fair").alias("n_fair"),
        F.sum("poor").alias("n_poor"),
    )
    total = out.agg(F.sum("n")).scalar()
    return out.withColumn("pct", F.col("n") * 100.0 / total)


def cluster_quality(per_cluster: DataFrame, keys: Sequence[str] = (), silhouette: str = "silhouette") -> DataFrame:
    """Per group of ``keys``: clusters by quality and the overall band, from one row per cluster."""
    band = cluster_band(silhouette)
    counts = per_cluster.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.count_if(band == "BUENA").alias("good"),
        F.count_if(band == "REGULAR").alias("fair"),
        F.count_if(band == "POBRE").alias("poor"),
    )
    return counts.withColumn("overall", overall_band("good", "poor", "k"))


def centroid_pairs(centroids: DataFrame, dims: Sequence[str], label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest distance between centroids and their ratio.

    Works on the list of the (at most ``max_k``) centroids of a group, not on a join of rows.
    """
    points = F.array_sort(F.collect_list(F.struct(label, *dims)))
    lists = centroids.groupBy(*keys).agg(points.alias("_c"))

    def distance(a, b):
        return F.sqrt(sum(((a[d] - b[d]) * (a[d] - b[d]) for d in dims), F.lit(0.0)))

    pairs = F.flatten(
        F.transform(
            "_c",
            lambda a: F.transform(F.filter("_c", lambda b: b[label] > a[label]), lambda b: distance(a, b)),
        )
    )
    out = lists.select(*keys, pairs.alias("_d"))
    least, most = F.array_min("_d"), F.array_max("_d")
    return out.select(*keys, least.alias("min_distance"), most.alias("max_distance"), ratio(most, least).alias("separation"))

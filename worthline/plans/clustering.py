"""The clustering stage: per segment scale, choose K, cluster, rate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from worthline.operators import cluster_rules, kmeans, scale
from worthline.operators.partials import spread
from worthline.functions.scalars import cluster_band, quality_band
from worthline.operators.lookup import lookup_join
from worthline.plans.cluster_models import cluster_report
from worthline.session import written


@dataclass
class ClusteredSegments:
    """Rows on their own scale with label and squared distance, a row per cluster, a row per segment."""

    labelled: DataFrame
    per_cluster: DataFrame
    summary: DataFrame


def cluster_segments(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    segment: str,
    most: int = 10,
    restarts: int = kmeans.RESTARTS,
    min_rows: int = 10,
) -> ClusteredSegments:
    """Cluster every segment on its scaled columns.

    All K and restarts of all segments share the passes of one fit. The elbow decides K; the
    silhouette is reported beside it. Rows with nulls and small segments get label -1. The clusters have
    their size, mean and median of each column, silhouette, spread and quality; the summary lists them and
    tells how far their centres lie apart.
    """
    columns = list(columns)
    params = scale.fit_scaler_by(df.na.drop(subset=columns), columns, [segment])
    scaled = spread(scale.scale_by(df, params, columns, [segment]), key).persist(StorageLevel.MEMORY_AND_DISK)
    models = kmeans.fit_many(scaled, columns, key, range(1, most + 1), segment, restarts)
    spark = df.sparkSession
    sizes = {str(row[0]): row[1] for row in scaled.na.drop(subset=columns).groupBy(segment).count().collect()}
    table = [
        (seg, k, m.inertia)
        for (seg, k), m in models.items()
        if sizes.get(seg, 0) >= min_rows and k <= min(most, sizes[seg] // 5)
    ]
    inertia = spark.createDataFrame(table, "segment string, k int, inertia double")
    elbows = {row["segment"]: row["k"] for row in cluster_rules.elbow_k(inertia, ["segment"]).collect()}
    chosen = {seg: max(2, min(k, most, sizes[seg] // 5)) for seg, k in elbows.items()}
    labelled = kmeans.assign(scaled, columns, {seg: models[seg, k].centroids for seg, k in chosen.items() if (seg, k) in models}, segment)

    rated = kmeans.mean_silhouettes(scaled, columns, {(seg, k): models[seg, k] for seg, k, _ in table}, segment)
    best: dict[str, int] = {}
    for (seg, k), value in sorted(rated.items()):
        if seg not in best or value > rated[seg, best[seg]]:
            best[seg] = k

    samples = kmeans.silhouette_samples(labelled, columns, [segment])
    per_cluster = samples.groupBy(segment, "label").agg(
        F.count("*").alias("n"),
        F.avg("silhouette").alias("silhouette"),
        F.stddev_pop("silhouette").alias("silhouette_std"),
        F.sum("sq_dist").alias("inertia"),
    )
    own_scale = scale.scale_by(labelled, params, columns, [segment], invert=True)
    values, distances = cluster_report(own_scale, segment, columns)
    per_cluster = lookup_join(per_cluster, values.drop("n"), [segment, "label"], "inner")
    per_cluster = written(per_cluster.withColumn("quality", cluster_band("silhouette")), "per_cluster")
    quality = cluster_rules.cluster_quality(per_cluster, [segment])
    described = ["label", "n", *[f"{c}_{m}" for c in columns for m in ("mean", "median")], "silhouette", "inertia", "quality"]
    totals = per_cluster.groupBy(segment).agg(
        F.array_sort(F.collect_list(F.struct(*described))).alias("clusters"),
        F.sum("n").alias("n"),
        F.sum("inertia").alias("inertia"),
        (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette"),
    )
    own_scale, distances = written(own_scale, "labelled"), written(distances, "distances")
    scaled.unpersist()
    picks = spark.createDataFrame(
        [(seg, elbows[seg], best.get(seg)) for seg in sorted(chosen)], f"{segment} string, k_elbow int, k_silhouette int"
    )
    summary = (
        totals.join(quality, segment)
        .join(picks, segment)
        .join(distances, segment)
        .withColumn("band", quality_band("silhouette"))
        .select(segment, "n", "k_elbow", "k_silhouette", "k", "inertia", "silhouette", "band", "good", "fair", "poor", "overall", "min_distance", "max_distance", "separation", "clusters")
    )
    return ClusteredSegments(own_scale, per_cluster, summary)

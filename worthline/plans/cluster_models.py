"""A regression for every cluster of every segment: medians, split, guard, fit, scores and summary in shared passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.operators import cluster_rules, gram, metrics, profile, svr, trees
from worthline.operators.impute import impute_median
from worthline.operators.lookup import lookup_join
from worthline.operators.mapping import label_or_default
from worthline.operators.split import with_split_by
from worthline.session import written

MIN_ROWS, MIN_TEST_ROWS = 10, 2
MODEL = "_model"


@dataclass
class ClusterModels:
    """Every row with its split and prediction (null where its cluster has no model), and a row per fitted cluster."""

    scored: DataFrame
    summary: DataFrame


def model_key(segment: str, label: str) -> Column:
    """One text for segment and cluster; null for rows outside any cluster, which have no model."""
    return F.when(F.col(label) >= 0, F.concat_ws("|", F.col(segment).cast("string"), F.col(label).cast("string")))


def prepare(
    labelled: DataFrame,
    features: Sequence[str],
    key: str,
    segment: str,
    label: str = "label",
    min_rows: int = MIN_ROWS,
    min_test: int = MIN_TEST_ROWS,
    leaky: bool = False,
) -> DataFrame:
    """Rows with model key, split and filled features; the key of a cluster that is too small for a model is null.

    The split follows the size of the cluster, features take the median of the cluster's training rows
    (of all its rows, if ``leaky``).
    """
    keyed = written(with_split_by(labelled.withColumn(MODEL, model_key(segment, label)), key, [MODEL]), "clustered")
    sizes = keyed.groupBy(MODEL).agg(F.count("*").alias("_n"), F.count_if(F.col("split") == "test").alias("_test"))
    large = sizes.filter(F.col(MODEL).isNotNull() & (F.col("_n") >= min_rows) & (F.col("_test") >= min_test)).select(MODEL, F.lit(True).alias("_large"))
    guarded = lookup_join(keyed, large, [MODEL]).withColumn(MODEL, F.when(F.col("_large"), F.col(MODEL))).drop("_large")
    where = None if leaky else F.col("split") == "train"
    return written(impute_median(guarded, list(features), [MODEL], where), "prepared")


def linear_predictions(rows: DataFrame, features: Sequence[str], target: str, name: str = "predicted") -> DataFrame:
    """Least squares per model on its training rows; all models from one pass of moments."""
    train = rows.filter((F.col("split") == "train") & F.col(MODEL).isNotNull())
    table = gram.linear_regression_by(train, list(features), target, MODEL)
    terms = [*features, "(intercept)"]
    wide = table.groupBy(F.col("segment").alias(MODEL)).agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"_b{i}") for i, t in enumerate(terms)])
    joined = lookup_join(rows, wide, [MODEL])
    value = sum((F.col(c) * F.col(f"_b{i}") for i, c in enumerate(features)), F.col(f"_b{len(features)}"))
    return joined.withColumn(name, value).drop(*[f"_b{i}" for i in range(len(terms))])


def fit_clusters(
    labelled: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    segment: str,
    label: str = "label",
    kind: str = "trees",
    params=None,
    trials: list | None = None,
    **options,
) -> ClusterModels:
    """Fit one model per cluster of ``labelled`` and score every row, training rows included.

    ``kind``: ``linear`` (least squares), ``trees`` (boosted; ``params`` as for the trainer) or ``kernel``
    (``params``, or ``trials`` to search). The summary has a row per model: rows, features, metrics of both
    parts, overfit ratio and parameters, best test R2 first.
    """
    features = list(features)
    rows = prepare(labelled, features, key, segment, label, **options)
    known = rows.filter(F.col(MODEL).isNotNull())
    spark = rows.sparkSession
    if kind == "linear":
        scored, said = linear_predictions(rows, features, target), None
    elif kind == "trees":
        used = params or trees.SEGMENT_PARAMS
        models = trees.gbt_by_segment(known, features, target, MODEL, params=used)
        scored, said = trees.score_by_segment(rows, models, MODEL, features), {m: {k: str(v) for k, v in used.items()} for m in models}
    elif kind == "kernel":
        models, prepared, _ = svr.fit_svr(known, features, target, key, MODEL, params=params, trials=trials)
        scored = svr.score_svr(rows, models, prepared, MODEL)
        said = {
            m: {"kernel": f.params.kernel, "C": str(f.params.C), "epsilon": str(f.params.epsilon), "gamma": str(f.params.gamma), "gap": str(f.gap)}
            for m, f in models.items()
        }
    else:
        raise ValueError(f"unknown kind: {kind}")
    summary = metrics.segment_summary(scored.filter(F.col(MODEL).isNotNull()), MODEL, real=target)
    names = known.select(MODEL, F.col(segment).alias("segment"), F.col(label).alias("cluster")).distinct()
    summary = lookup_join(summary, names, [MODEL], "inner").withColumn("n", F.col("train_n") + F.col("test_n"))
    summary = summary.withColumn("n_features", F.lit(len(features)))
    empty = F.lit(None).cast("map<string,string>")
    if said:
        table = spark.createDataFrame(list(said.items()), f"{MODEL} string, parameters map<string,string>")
        summary = lookup_join(summary, table, [MODEL])
    else:
        summary = summary.withColumn("parameters", empty)
    measures = [f"{part}_{m}" for part in ("train", "test") for m in ("n", "r2", "mae", "mse", "rmse", "mape")]
    summary = summary.select("segment", "cluster", "n", "n_features", *measures, "overfit_ratio", "parameters")
    return ClusterModels(scored.drop(MODEL), summary.orderBy(F.desc_nulls_last("test_r2"), "segment", "cluster"))


def cluster_report(
    labelled: DataFrame, segment: str, columns: Sequence[str], label: str = "label", scaled: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Size, mean and median of the columns of each cluster, and per segment the least and greatest distance of centres.

    Distances are those of the mean points of ``scaled`` (of the columns themselves, if None).
    """
    inside = labelled.filter(F.col(label) >= 0)
    kept = ["n", *[f"{c}_{m}" for c in columns for m in ("mean", "median")]]
    clusters = profile.target_profile(inside, list(columns), [segment, label]).select(segment, label, *kept)
    dims = list(scaled or columns)
    centres = inside.groupBy(segment, label).agg(*[F.avg(c).alias(c) for c in dims])
    return clusters, cluster_rules.centroid_pairs(centres, dims, label, [segment])


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """``df`` with the cluster of each key, -1 where it has none."""
    return label_or_default(df, labels.select(key, label), key, label)

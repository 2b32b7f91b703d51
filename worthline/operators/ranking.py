"""Ranks and selections over feature tables (one row per segment and feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_features(df: DataFrame, segment: str = "segment", feature: str = "variable", score: str = "coefficient") -> DataFrame:
    """Rank 1..n by absolute score within the segment."""
    order = Window.partitionBy(segment).orderBy(F.abs(score).desc(), feature)
    return df.withColumns({"importance": F.abs(score), "rank": F.row_number().over(order)})


def top_pct_select(
    ranked: DataFrame,
    pct: float,
    protected: Sequence[str] = (),
    segment: str = "segment",
    feature: str = "variable",
) -> DataFrame:
    """Add ``protected``, ``kept`` and ``select_rank``: of the unprotected features the best ``pct`` %
    (at least one, rounded down) are kept; protected ones always are."""
    out = ranked.withColumn("protected", F.col(feature).isin(list(protected)) if protected else F.lit(False))
    group = Window.partitionBy(segment, "protected")
    place = F.row_number().over(group.orderBy("rank"))
    quota = F.greatest(F.lit(1), F.floor(F.count("*").over(group) * F.lit(pct) / 100))
    return out.withColumns({"select_rank": place, "kept": F.col("protected") | (place <= quota)})


def kept_report(selected: DataFrame, segment: str = "segment", feature: str = "variable") -> DataFrame:
    """Kept features in order: protected first, then by rank."""
    order = Window.partitionBy(segment).orderBy(F.desc("protected"), "select_rank")
    return selected.filter("kept").select(segment, feature, "protected", F.row_number().over(order).alias("rank"))


def eliminated_report(selected: DataFrame, segment: str = "segment", feature: str = "variable") -> DataFrame:
    order = Window.partitionBy(segment).orderBy("select_rank")
    return selected.filter("not kept").select(segment, feature, F.row_number().over(order).alias("elimination_rank"))


def protected_report(selected: DataFrame, segment: str = "segment", feature: str = "variable") -> DataFrame:
    return selected.filter("protected").select(segment, feature)


def frequency_across_segments(selected: DataFrame, segment: str = "segment", feature: str = "variable", depth: int = 5, top: int = 10) -> DataFrame:
    """How often a feature is among the first ``depth`` kept or eliminated ones of a segment.

    The first ``depth`` kept ones include the protected, which are then not counted.
    """
    best = kept_report(selected, segment, feature).filter((F.col("rank") <= depth) & ~F.col("protected"))
    worst = eliminated_report(selected, segment, feature).filter(F.col("elimination_rank") <= depth)

    def counted(df, side):
        counts = df.groupBy(feature).agg(F.count("*").alias("n")).orderBy(F.desc("n"), feature).limit(top)
        return counts.select(F.lit(side).alias("side"), feature, "n")

    return counted(best, "top").unionByName(counted(worst, "bottom"))


def mean_importance(ranked: DataFrame, feature: str = "variable") -> DataFrame:
    return ranked.groupBy(feature).agg(F.avg("importance").alias("mean_importance"), F.count("*").alias("n_segments"))


def top_features(ranked: DataFrame, n: int = 20) -> DataFrame:
    return ranked.filter(F.col("rank") <= n)


def membership_split(ranked: DataFrame, members: DataFrame, feature: str = "variable") -> tuple[DataFrame, DataFrame]:
    """Rows whose feature is in ``members``, and the others."""
    return ranked.join(members, feature, "left_semi"), ranked.join(members, feature, "left_anti")


def running_best(trials: DataFrame, order: str = "trial", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Best score so far along the trials (a table with one row per trial)."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best", F.max(score).over(so_far))

"""Descriptions of a table: counts, distributions, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import NULL_LITERAL, ratio, variation_class
from worthline.operators import quantiles


def one_row_per(columns: Sequence[str], measures: Sequence[str]) -> Column:
    """Array of structs turning the wide row ``<column>__<measure>`` into one row per column."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}__{m}`").alias(m) for m in measures])
            for c in columns
        ]
    )


def per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate row over all columns, unpivoted; ``measures`` maps a name to column -> aggregate."""
    row = df.agg(*[f(c).alias(f"{c}__{m}") for c in columns for m, f in measures.items()])
    return row.select(F.explode(one_row_per(columns, list(measures))).alias("r")).select("r.*")


def describe_numeric(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column."""
    measures = {
        "n": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    aggs = [f(c).alias(f"{c}__{m}") for c in columns for m, f in measures.items()]
    exact = {f"{c}__p{p}": (c, p / 100) for c in columns for p in (25, 50, 75)}
    row = quantiles.aggregate(df.select(*columns), [], aggs, exact, **options)
    return row.select(F.explode(one_row_per(columns, [*measures, "p25", "p50", "p75"])).alias("r")).select("r.*")


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    counts = per_column(df, columns, {"n_missing": lambda c: F.count_if(F.col(c).isNull()), "n": lambda c: F.count("*")})
    return counts.select("variable", "n_missing", (ratio("n_missing", "n") * 100).alias("pct")).orderBy(
        F.desc("pct"), "variable"
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column: sketches in one pass with ``approx``, otherwise exact.

    The exact form first reduces the table to distinct (column, value) pairs, which combine before
    the shuffle, so a value that fills a third of the rows is sent once per task.
    """
    if approx:
        return per_column(df, columns, {"n_distinct": F.approx_count_distinct})
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.*").filter("v is not null").distinct()
    return values.groupBy("variable").agg(F.count("*").alias("n_distinct"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered.limit(top) if top else ordered


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Frequency with percentage; the total is a scalar subquery over the same counts (whose shuffle
    is reused), not a window over one partition."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def target_variation(df: DataFrame, target: str) -> DataFrame:
    stats = df.agg(
        F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"), F.min(target).alias("min"), F.max(target).alias("max")
    )
    stats = stats.withColumn("relative_std", ratio("std", "mean"))
    return stats.withColumn("variation", variation_class("relative_std"))


def target_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean")]
    return quantiles.aggregate(df.select(*keys, *columns), list(keys), aggs, {f"{c}_median": (c, 0.5) for c in columns}, **options)


def group_profile(df: DataFrame, group: str, columns: Sequence[str], **options) -> DataFrame:
    """n and mean, median, sample std, min, max of each column per group."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return quantiles.aggregate(df.select(group, *columns), [group], aggs, {f"{c}_median": (c, 0.5) for c in columns}, **options)


def group_range(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg((F.max(column) - F.min(column)).alias("value_range"))


def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed; copies combine before the shuffle."""
    return df.dropDuplicates()


def dedupe_report(df: DataFrame) -> DataFrame:
    """Rows before, after and removed, from one aggregation by whole row."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.sum("_copies").alias("n_before"),
        F.count("*").alias("n_after"),
        (F.sum("_copies") - F.count("*")).alias("n_removed"),
    )


def count_literal_cells(df: DataFrame, literal: str = NULL_LITERAL) -> DataFrame:
    hits = [F.when(F.col(c).cast("string") == literal, 1).otherwise(0) for c in df.columns]
    return df.agg(
        F.sum(sum(hits[1:], hits[0])).cast("bigint").alias("n_literal"),
        (F.count("*") * len(df.columns)).alias("n_cells"),
    )


def label_coverage(df: DataFrame, label: str = "label") -> DataFrame:
    inside = F.coalesce(F.col(label) >= 0, F.lit(False))
    return df.agg(F.count_if(inside).alias("n_labelled"), F.count_if(~inside).alias("n_unlabelled"))


def best_worst(df: DataFrame, segment: str, score: str) -> DataFrame:
    return df.agg(
        F.max_by(segment, score).alias("best"),
        F.max(score).alias("best_score"),
        F.min_by(segment, score).alias("worst"),
        F.min(score).alias("worst_score"),
    )


def across_segments(df: DataFrame, scores: Sequence[str], ddof: int = 0) -> DataFrame:
    """Mean and spread of each score over the rows of a per-segment table."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    return per_column(df, scores, {"mean": F.avg, "std": spread})

"""Filling of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.operators import quantiles
from worthline.operators.lookup import lookup_join


def impute_median(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    where: Column | None = None,
    **options,
) -> DataFrame:
    """Nulls become the interpolated median of the column, per group of ``keys`` if given.

    ``where`` restricts the rows the medians are taken from, e.g. to training rows.
    """
    source = df.filter(where) if where is not None else df
    middle = quantiles.medians(source, columns, keys, **options)
    if not keys:
        row = middle.first()
        known = {c: row[c] for c in columns if row[c] is not None}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in known.items()})
    renamed = middle.withColumnsRenamed({c: f"_med_{c}" for c in columns})
    joined = lookup_join(df, renamed, keys, "left", null_safe=True)
    filled = joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in columns})
    return filled.select(*df.columns)


def modes(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value per group, the smallest one on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(column))


def impute_mode(df: DataFrame, column: str, keys: Sequence[str] = (), default: str = "0") -> DataFrame:
    """Nulls become the mode; a group without any value gets ``default``."""
    fallback = F.lit(default).cast(dict(df.dtypes)[column])
    if not keys:
        row = modes(df, column).first()
        mode = F.lit(row[0] if row else None).cast(dict(df.dtypes)[column])
        return df.withColumn(column, F.coalesce(F.col(column), mode, fallback))
    table = modes(df, column, keys).withColumnRenamed(column, "_mode")
    joined = lookup_join(df, table, keys, "left", null_safe=True)
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("_mode"), fallback)).select(*df.columns)

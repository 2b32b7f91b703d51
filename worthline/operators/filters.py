"""Row filters and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.operators.lookup import lookup_join


def filter_segment(df: DataFrame, segment: str, value) -> DataFrame:
    return df.filter(F.col(segment) == F.lit(value))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def filter_non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def min_sample_guard(
    df: DataFrame, segment: str, min_rows: int = 10, min_test_rows: int = 0, split: str | None = None
) -> DataFrame:
    """Rows of the segments that are large enough to fit a model on."""
    test = F.count_if(F.col(split) == "test") if split else F.count("*")
    passing = (
        df.groupBy(segment)
        .agg(F.count("*").alias("n"), test.alias("n_test"))
        .filter((F.col("n") >= min_rows) & (F.col("n_test") >= min_test_rows))
        .select(segment)
    )
    return lookup_join(df, passing, [segment], "left_semi")


def assigned_only(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that belong to a cluster; -1 marks the others."""
    return df.filter(F.col(label) >= 0)

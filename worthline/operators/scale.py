"""Standardisation, its inverse, and checks of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import inf_to_null
from worthline.operators.lookup import lookup_join
from worthline.operators.profile import per_column

Params = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: Sequence[str], ddof: int = 0, where: Column | None = None) -> Params:
    """{column: (mean, std)} from one aggregation; null, NaN and infinity ignored.

    A constant or empty column gets scale 1. ``where`` restricts the fit, e.g. to training rows.
    """
    source = df.filter(where) if where is not None else df
    spread = F.stddev_samp if ddof else F.stddev_pop
    aggs = []
    for c in columns:
        clean = inf_to_null(F.col(c).cast("double"))
        aggs += [F.avg(clean).alias(f"m_{c}"), spread(clean).alias(f"s_{c}")]
    row = source.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns(
        {c: (inf_to_null(F.col(c).cast("double")) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items() if c in df.columns}
    )


def unscale(df: DataFrame, params: Params) -> DataFrame:
    """Inverse of ``scale``; columns that are absent are skipped."""
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in params.items() if c in df.columns})


def unscale_from_original(df: DataFrame, original: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """Unscale with parameters recomputed from the unscaled table.

    ``ddof`` 0 undoes ``scale`` exactly; 1 uses the sample deviation. A column whose deviation is
    missing or zero is left as it is.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    known = [c for c in columns if c in df.columns and c in original.columns]
    aggs = []
    for c in known:
        clean = inf_to_null(F.col(c).cast("double"))
        aggs += [F.avg(clean).alias(f"m_{c}"), spread(clean).alias(f"s_{c}")]
    row = original.agg(*aggs).first()
    return unscale(df, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in known if row[f"s_{c}"]})


def fit_scaler_by(df: DataFrame, columns: Sequence[str], keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Parameters per group as a table ``keys, m_<column>, s_<column>``."""
    source = df.filter(where) if where is not None else df
    aggs = []
    for c in columns:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"m_{c}"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"s_{c}")]
    return source.groupBy(*keys).agg(*aggs)


def scale_by(df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str], invert: bool = False) -> DataFrame:
    joined = lookup_join(df, params, keys, "left", null_safe=True)
    if invert:
        out = joined.withColumns({c: F.col(c) * F.col(f"s_{c}") + F.col(f"m_{c}") for c in columns})
    else:
        out = joined.withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns})
    return out.select(*df.columns)


def moments(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """Mean and std per column: near 0 and 1 after scaling, the original ones after unscaling."""
    return per_column(df, columns, {"mean": F.avg, "std": F.stddev_samp if ddof else F.stddev_pop})

"""The headline report: deviation of predictions by any grouping key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from worthline.operators import deviation


def scored_groups(
    scored: DataFrame,
    key: str,
    min_count: int,
    signed: bool = False,
    tolerance: float = deviation.TOLERANCE,
    **options,
) -> DataFrame:
    """Deviation, tolerance filter, then statistics of the groups of ``key``."""
    kept = deviation.filter_tolerance(deviation.add_deviation(scored), tolerance)
    return deviation.group_deviation_stats(kept, key, min_count, signed=signed, **options)

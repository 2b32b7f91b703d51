"""Positions in a global or per-group order without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worthline.operators.lookup import lookup_join
from worthline.session import written


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    name: str = "position",
    start: int = 1,
) -> DataFrame:
    """Add the position of each row by ``order`` (counted anew in every ``within`` group).

    The rows are range-partitioned and sorted in parallel and written once; each partition then
    learns how many rows lie before it from a table with one row per partition. A group larger than
    a task simply spans several partitions. End ``order`` with a unique column for a stable result.
    """
    stamped = df.orderBy(*within, *order).withColumn("_row", F.monotonically_increasing_id())
    stable = written(stamped, "ordered").withColumn("_part", F.shiftrightunsigned("_row", 33).cast("int"))
    sizes = stable.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    numbered = lookup_join(stable, offsets, ["_part"], "inner").withColumn(
        name, F.col("_before") + F.col("_row") - F.col("_first") + F.lit(start)
    )
    numbered = numbered.drop("_row", "_part", "_first", "_before")
    if not within:
        return numbered
    firsts = numbered.groupBy(*within).agg(F.min(name).alias("_group_first"))
    joined = lookup_join(numbered, firsts, within, "inner", null_safe=True)
    return joined.withColumn(name, F.col(name) - F.col("_group_first") + F.lit(start)).drop("_group_first")

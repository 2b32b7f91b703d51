"""Joins of a large table with a lookup table of unknown size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.session import written

BROADCAST_ROWS = 50_000
SALTS = 64
HOT_SHARE = 1 / 500


def checked_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table if it holds at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``left`` with ``table`` on the columns ``on``, kept once, from the left side.

    A table of at most ``max_rows`` rows is broadcast; a longer one is joined by shuffle with its
    hot keys spread (``spread_join``). ``how`` is inner, left, left_semi or left_anti.
    """
    renamed = {name: f"_lk_{name}" for name in on}
    small = checked_small(table, max_rows)
    if small is None:
        return spread_join(left, table, on, how, null_safe)
    right = F.broadcast(small.withColumnsRenamed(renamed))
    return left.join(right, _equal(list(renamed.items()), null_safe), how).drop(*renamed.values())


def spread_join(left: DataFrame, table: DataFrame, on: Sequence[str], how: str, null_safe: bool = False) -> DataFrame:
    """Shuffle join in which the rows of a hot key go to ``SALTS`` partitions instead of one.

    Hot keys hold more than ``HOT_SHARE`` of the rows of ``left``, so there are fewer than
    1/``HOT_SHARE`` of them; only their entries in ``table`` are repeated. ``left`` is written once:
    its rows are numbered in the files, so equal rows spread as well, rows of any type can be
    spread, and a task that is run again gives a row the same salt.
    """
    left = written(left, "spread")
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    keys = counts.filter(F.col("_n") > total * HOT_SHARE)
    hot = checked_small(keys.select(*on, F.lit(SALTS).alias("_salts")), int(1 / HOT_SHARE))
    hot = F.broadcast(hot.withColumnsRenamed({name: f"_hot_{name}" for name in on}))
    marks = _equal([(name, f"_hot_{name}") for name in on], True)
    dropped = [f"_hot_{name}" for name in on]

    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_place")
    big = left.select("*", place).join(hot, marks, "left").drop(*dropped)
    big = big.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.col("_place")).otherwise(F.lit(0)))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    right = table.join(hot, marks, "left").drop(*dropped).withColumn("_lk_salt", copies).drop("_salts")
    renamed = {name: f"_lk_{name}" for name in on}
    condition = _equal(list(renamed.items()), null_safe) & (F.col("_salt") == F.col("_lk_salt"))
    joined = big.drop("_place", "_salts").join(right.withColumnsRenamed(renamed), condition, how)
    return joined.drop("_salt", "_lk_salt", *renamed.values())


def _equal(pairs: list[tuple[str, str]], null_safe: bool):
    tests = [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in pairs]
    return reduce(lambda a, b: a & b, tests)

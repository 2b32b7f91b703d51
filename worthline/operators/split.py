"""Reproducible splits: the part a row falls in depends on its key alone, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.operators.lookup import lookup_join

# Modulus and multipliers of the split hash (also written out in the checking SQL).
MODULUS = 2147483647
MULTIPLIER = 48271
SEED_STEP = 69621
SEED_FACTOR = 1103515245
SEED_OFFSET = 12345


def seed_multiplier(seed: int) -> int:
    """The factor of a seed: another seed gives another order, not the same one shifted."""
    return (seed * SEED_FACTOR + SEED_OFFSET) % MODULUS


def key_hash(key: str, seed: int, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a key, in arithmetic that any SQL engine repeats exactly.

    Keys that are no whole numbers go by the crc32 of their text.
    """
    whole = F.col(key).try_cast("bigint")
    whole = F.when(whole == F.col(key).try_cast("double"), whole)  # 1.2 is not 1
    number = F.coalesce(whole, F.crc32(F.col(key).cast("string").cast("binary")))
    folded = (F.pmod(number, F.lit(MODULUS)) * MULTIPLIER + seed * SEED_STEP) % MODULUS
    return folded * F.lit(seed_multiplier(seed)).cast("bigint") % MODULUS % buckets


def key_hash_sql(key: str, seed: int, buckets: int) -> str:
    """``key_hash`` of a whole non-negative number, written out for the checking SQL."""
    folded = f"((({key} % {MODULUS}) * {MULTIPLIER} + {seed} * {SEED_STEP}) % {MODULUS})"
    return f"(({folded}::bigint * {seed_multiplier(seed)}::bigint) % {MODULUS} % {buckets})"


def with_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Tag each row ``train`` or ``test``."""
    is_train = key_hash(key, seed, 1000) >= int(round(test * 1000))
    return df.withColumn(name, F.when(is_train, "train").otherwise("test"))


def small_set_test_share(n: int) -> float:
    """Share of test rows for a very small table: a quarter at most, about five rows otherwise."""
    return min(0.25, max(0.1, 5 / n))


def with_split_by(df: DataFrame, key: str, within: Sequence[str], seed: int = 42, name: str = "split") -> DataFrame:
    """Tag each row ``train`` or ``test``; the share of test rows of a group of ``within`` follows its size
    (``small_set_test_share``: 25 % up to 20 rows, 10 % from 50 rows on)."""
    sizes = df.groupBy(*within).agg(F.count("*").alias("_rows"))
    joined = lookup_join(df, sizes, list(within), "left", null_safe=True)
    share = F.least(F.lit(0.25), F.greatest(F.lit(0.1), F.lit(5.0) / F.col("_rows")))
    is_train = key_hash(key, seed, 1000) >= F.round(share * 1000)
    return joined.withColumn(name, F.when(is_train, "train").otherwise("test")).select(*df.columns, name)


def with_folds(df: DataFrame, key: str, folds: int = 5, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Repeated splits: one copy of each row per fold, with its part in that fold.

    The number of copies is the number of folds, so the result grows linearly. Multi-model fits do
    not expand rows; they evaluate ``fold_parts`` inside one pass.
    """
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), fold_part(key, i, test, seed).alias("part"))
            for i in range(folds)
        ]
    )
    return df.select("*", F.explode(parts).alias("_f")).select("*", "_f.fold", "_f.part").drop("_f")


def fold_part(key: str, fold: int, test: float = 0.2, seed: int = 42) -> Column:
    cut = int(round(test * 1000))
    return F.when(key_hash(key, seed + 1 + fold, 1000) >= cut, "train").otherwise("test")


def kfold(key: str, folds: int = 5, seed: int = 42) -> Column:
    """The one fold 0..folds-1 in which a row is held out."""
    return key_hash(key, seed + 101, folds)

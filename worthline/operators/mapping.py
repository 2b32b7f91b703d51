"""Category dictionaries: encode text as codes, decode codes, and report coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthline.operators.lookup import BROADCAST_ROWS, checked_small, lookup_join
from worthline.operators.ordering import number_rows


def encode_dictionary(df: DataFrame, columns: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(variable, value, code, total): codes 0..n-1 in sorted order of the distinct non-null values.

    Short dictionaries are numbered by a window per column; a dictionary too long for that is
    numbered by a parallel sort.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()
    small = checked_small(values, max_rows)
    if small is not None:
        order = Window.partitionBy("variable").orderBy("value")
        coded = small.withColumn("code", F.row_number().over(order) - 1)
    else:
        coded = number_rows(values, ["value"], ["variable"], "code", start=0)
        coded = coded.withColumn("code", F.col("code").cast("int"))
    totals = coded.groupBy("variable").agg(F.count("*").alias("total"))
    return lookup_join(coded, totals, ["variable"], "inner")


def label_encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Replace each column by its code; values outside the dictionary and nulls become null."""
    for c in columns:
        part = dictionary.filter(F.col("variable") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        left = df.withColumn(c, F.col(c).cast("string"))
        df = lookup_join(left, part, [c], "left", **options).withColumn(c, F.col("_code")).drop("_code").select(*df.columns)
    return df


def label_decode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Replace codes by their text; codes outside the dictionary become null."""
    for c in columns:
        part = dictionary.filter(F.col("variable") == c).select(F.col("code").alias(c), F.col("value").alias("_text"))
        left = df.withColumn(c, F.col(c).try_cast("int"))
        df = lookup_join(left, part, [c], "left", **options).withColumn(c, F.col("_text")).drop("_text").select(*df.columns)
    return df


def unmapped_codes(df: DataFrame, dictionary: DataFrame, column: str, **options) -> DataFrame:
    """Distinct codes of a column that the dictionary lacks."""
    known = dictionary.filter(F.col("variable") == column).select(F.col("code").alias(column))
    codes = df.filter(F.col(column).isNotNull()).select(F.col(column).try_cast("int").alias(column)).distinct()
    return lookup_join(codes, known, [column], "left_anti", **options)


def decode_coverage(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values per column before and after decoding, and the share translated."""
    from worthline.operators.profile import per_column

    def filled(df, name):
        return per_column(df, columns, {name: F.count})

    joined = filled(before, "n_before").join(filled(after, "n_after"), "variable")
    return joined.withColumn("pct_decoded", F.try_divide(F.col("n_after") * 100.0, F.col("n_before")))


def attach_by_key(df: DataFrame, extra: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Columns of ``extra`` put on the rows of ``df`` with the same unique key, never by row order."""
    return df.join(extra, key, how)


def label_or_default(df: DataFrame, labels: DataFrame, key: str, label: str = "label", default: int = -1) -> DataFrame:
    """The cluster label of each row, ``default`` where the row was not clustered."""
    joined = attach_by_key(df, labels.select(key, label), key)
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def values_not_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))

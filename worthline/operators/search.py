"""Search, filter and order of a scored table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import lower_contains, to_number

COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
}
PAGE_SIZES = [100, 250, 500, 1000]
DEFAULT_TOP = 10


def head_tail(df: DataFrame, first: Sequence[Column], last: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows by one order and the first ``n`` by the opposite one, tagged."""
    head = df.orderBy(*first).limit(n).select(F.lit("head").alias("part"), "*")
    tail = df.orderBy(*last).limit(n).select(F.lit("tail").alias("part"), "*")
    return head.unionByName(tail)


def zero_if_missing(name: str) -> Column:
    return F.coalesce(to_number(name), F.lit(0.0))


def in_value_ranges(ranges: dict[str, tuple[float, float]], unit: float = 1_000_000) -> Column:
    """Each column within its closed range, given in millions; missing counts as zero."""
    tests = [zero_if_missing(c).between(lo * unit, hi * unit) for c, (lo, hi) in ranges.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_set(name: str, chosen: Sequence[str]) -> Column:
    """An empty choice keeps everything."""
    return F.col(name).isin(list(chosen)) if chosen else F.lit(True)


def any_column_contains(names: Sequence[str], text: str) -> Column:
    text = text.strip()
    if not text:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(lower_contains(c, text), F.lit(False)) for c in names])


def numeric_condition(df: DataFrame, text: str, aliases: dict[str, str] | None = None) -> Column | None:
    """``field op number`` as a predicate, or None if the text is not of that form.

    The number is a run of digits. Field names are matched without case, after aliases; an unknown
    field raises.
    """
    match = re.search(r"(\w+)\s*(>=|<=|>|<|=)\s*(\d+)", text)
    if not match:
        return None
    field, op, number = match.groups()
    field = (aliases or {}).get(field.lower(), field)
    names = {c.lower(): c for c in df.columns}
    if field.lower() not in names:
        raise ValueError(f"unknown column in condition: {field}")
    return F.coalesce(COMPARE[op](to_number(names[field.lower()]), F.lit(float(number))), F.lit(False))


def search_cascade(df: DataFrame, text: str, fields: Sequence[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows that match on the first field that matches anywhere, else on a numeric condition.

    Every row is given the first level it matches; the least level overall is a scalar subquery, so
    nothing is shuffled but one number per task.
    """
    tests = [lower_contains(c, text) for c in fields]
    try:
        condition = numeric_condition(df, text, aliases)
    except ValueError:
        condition = None
    if condition is not None:
        tests.append(condition)
    level = F.lit(None).cast("int")
    for i, test in reversed(list(enumerate(tests, start=1))):
        level = F.when(test, F.lit(i)).otherwise(level)
    ranked = df.withColumn("match_level", level).filter("match_level is not null")
    least = ranked.agg(F.min("match_level")).scalar()
    return ranked.filter(F.col("match_level") == least)


def top_n_value(df: DataFrame, by: str, text: str, key: str, ascending: bool = False) -> DataFrame:
    """The N most (or least) valuable rows with a positive value; N is read from the text."""
    digits = re.search(r"\d+", text)
    n = int(digits.group()) if digits and int(digits.group()) else DEFAULT_TOP
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.filter(F.col(by) > 0).orderBy(order, key).limit(n)


#: What a page reads as a number.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def typed_value(df: DataFrame, by: str) -> Column:
    """What a column is sorted by: its numbers (missing and blank ones as zero) if it holds nothing else, else its
    lower-case text.

    The type is decided once, from all values of the column (one aggregate over text columns), because an
    order that compares each pair by its own types has cycles where numbers and words are mixed.
    """
    text = F.col(by).cast("string")
    kind = dict(df.dtypes)[by]
    numeric = kind not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")
    if kind == "string":
        words = (F.trim(text) != "") & ~text.rlike(NUMBER)
        numeric = not df.agg(F.max(F.coalesce(words, F.lit(False)))).first()[0]
    if numeric:
        return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)) if kind == "string" else zero_if_missing(by)
    return F.lower(F.coalesce(text, F.lit("")))


def sort_typed(df: DataFrame, by: str, key: str, ascending: bool = True) -> DataFrame:
    """Order by ``typed_value``, then by the key."""
    value = typed_value(df, by)
    return df.orderBy(value.asc() if ascending else value.desc(), key)


def sort_preset(df: DataFrame, preset: str, columns: dict[str, str], key: str) -> DataFrame:
    """Named orders: value and rating falling, age rising (missing as zero), name rising."""
    by = columns[preset]
    if by not in df.columns:
        raise ValueError(f"unknown column for sort: {by}")
    orders = {
        "value": lambda: zero_if_missing(by).desc(),
        "rating": lambda: zero_if_missing(by).desc(),
        "age": lambda: zero_if_missing(by).asc(),
        "name": lambda: F.coalesce(F.col(by), F.lit("")).asc(),
    }
    return df.orderBy(orders[preset](), key)


def limit_then_sort(df: DataFrame, limit: int | None, first_by: str, then: Sequence[Column]) -> DataFrame:
    """A page of rows in the table's own order, sorted afterwards; None shows all rows."""
    page = df.orderBy(first_by).limit(limit) if limit else df
    return page.orderBy(*then)


def filter_ranges(df: DataFrame, columns: Sequence[str], segment: str, unit: float = 1_000_000, floor: float = 200) -> DataFrame:
    """A row for each segment to offer, in order, beside the upper bound of the value sliders (in millions, at least
    ``floor``). Both come from one aggregation by segment."""
    largest = F.greatest(*[F.coalesce(F.max(zero_if_missing(c)), F.lit(0.0)) for c in columns]) / unit
    by_segment = df.groupBy(segment).agg(largest.alias("_largest"))
    bound = by_segment.agg(F.ceil(F.greatest(F.max("_largest"), F.lit(float(floor))))).scalar()
    return by_segment.filter(F.trim(segment) != "").select(segment, bound.alias("slider_max")).orderBy(segment)

"""Exact interpolated percentiles that stay exact when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worthline.operators.lookup import checked_small, lookup_join
from worthline.session import written

#: Values of a group (over all columns) up to which the built-in aggregate is used.
INLINE_ROWS = 500_000
#: Cells that a range of values is cut into in one pass, and rows of a cell that are told apart by value.
CELLS, FINISH_ROWS = 4096, 500_000


def percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    inline_rows: int = INLINE_ROWS,
    cells: int = CELLS,
    finish_rows: int = FINISH_ROWS,
    stable: bool = False,
) -> DataFrame:
    """One row per group of ``keys``: for each column the array of its percentiles at ``probs``.

    Linear interpolation between order statistics, nulls ignored. ``df`` is read once, into a written
    table of the keys and columns (``stable`` says that it is one already). If no group has more than
    ``inline_rows`` values over all columns the built-in aggregate is used, whose state is a value-count
    map per column held by one task; otherwise the order statistics are found by counts (see ``_by_cells``).
    """
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    if not stable:
        df = written(df, "narrow")
    if _largest_group(df, keys) * len(columns) <= inline_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(*[F.percentile(c, wanted).alias(c) for c in columns])
    return _by_cells(df, list(columns), list(probs), list(keys), cells, finish_rows)


def _largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: counts combine before the shuffle and one number comes back."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """One row per group: the median of each column."""
    table = percentiles(df, columns, [0.5], keys, **options)
    return table.select(*keys, *[F.element_at(c, 1).alias(c) for c in columns])


def percentile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options) -> dict:
    """Whole-table percentiles on the driver: {column: [value per prob]}."""
    row = percentiles(df, columns, probs, **options).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}


#: Flips the order of the bits of a negative double, so that doubles sort as their bits read as whole numbers.
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def ordinals(values: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles; not-a-number comes last, both zeros are equal."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits)


def doubles(places: np.ndarray) -> np.ndarray:
    """The doubles of ``ordinals``."""
    return np.where(places < 0, places ^ _FLIP, places).view(np.float64)


def _converted(df: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """The columns as ordinals (``to`` long) or back (double); the others as they are."""
    schema = T.StructType([T.StructField(f.name, T.LongType() if to == "long" else T.DoubleType()) if f.name in columns else f for f in df.schema])
    function, kind = (ordinals, pa.int64()) if to == "long" else (doubles, pa.float64())

    def run(batches):
        for batch in batches:
            arrays = []
            for name, array in zip(batch.schema.names, batch.columns):
                if name in columns:
                    missing = np.asarray(array.is_null())
                    array = pa.array(function(array.fill_null(0).to_numpy(zero_copy_only=False)), kind, mask=missing)
                arrays.append(array)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def _by_cells(df: DataFrame, columns: list, probs: list, keys: list, cells: int, finish_rows: int) -> DataFrame:
    """Find each wanted rank by counting in ever narrower cells.

    Values are written once as whole numbers of the same order. Every series (group and column) begins as
    one cell from its least to its greatest value. A pass cuts the cells that hold a wanted rank into at
    most about ``cells`` parts of equal width and counts rows, least and greatest value of each part; the
    parts that hold the ranks are the next cells. A cell of one value is solved. One of at most
    ``finish_rows`` rows is left for a last pass, which counts its rows by value. So a task never holds
    more than ``cells`` counts or ``finish_rows`` values of a cell, however many rows there are, and as a
    pass takes ``log2(cells) - 1`` of 64 bits at least, six passes suffice for any data.
    """
    names = [f"_o{i}" for i in range(len(columns))]
    source = written(_converted(df.select(*keys, *[F.col(c).alias(n) for c, n in zip(columns, names)]), names, "long"), "ordinals")
    entries = F.array(*[F.struct(F.lit(i).alias("_col"), F.col(n).alias("_o")) for i, n in enumerate(names)])
    long = source.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*").filter("_o is not null")
    series = [*keys, "_col"]

    state = long.groupBy(*series).agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"), F.count("*").alias("_n"))
    state = state.withColumn("_ranks", _wanted_ranks(probs))
    solved, short = [], []
    while True:
        small = checked_small(state)
        state = written(state, "cells") if small is None else small
        solved.append(state.filter("_lo = _hi"))
        short.append(state.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= finish_rows)))
        state = state.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > finish_rows))
        if state.isEmpty():
            break
        state = _refined(long, state, series, cells)
    for part in solved[1:]:
        solved[0] = solved[0].unionByName(part)
    for part in short[1:]:
        short[0] = short[0].unionByName(part)
    hits = solved[0].select(*series, F.col("_lo").alias("_o"), F.explode("_ranks").alias("_r"))
    if not short[0].isEmpty():
        values = _inside(long, short[0], series).groupBy(*series, "_lo", "_o").agg(F.count("*").alias("_n"))
        hits = hits.unionByName(_located(values, short[0], series, "_o").select(*series, "_o", F.explode("_ranks").alias("_r")))
    ends = hits.groupBy(*series, "_r.p").agg(
        F.max(F.when(F.col("_r.side") == 0, F.col("_o"))).alias("_low"),
        F.max(F.when(F.col("_r.side") == 1, F.col("_o"))).alias("_high"),
        F.max("_r.part").alias("_part"),
    )
    ends = _converted(ends, ["_low", "_high"], "double")
    # as the built-in aggregate does, also with infinite ends
    between = (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
    points = ends.withColumn("_value", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between))
    arrays = points.groupBy(*keys).agg(
        *[
            F.array(*[F.max(F.when((F.col("_col") == i) & (F.col("p") == j), F.col("_value"))) for j in range(len(probs))]).alias(c)
            for i, c in enumerate(columns)
        ]
    )
    arrays = arrays.withColumns({c: F.when(F.exists(c, lambda x: x.isNotNull()), F.col(c)) for c in columns})
    if not keys:
        return arrays
    # a group whose values are all missing still has its row
    return lookup_join(source.select(*keys).distinct(), arrays, keys, "left", null_safe=True)


def _wanted_ranks(probs: Sequence[float]) -> Column:
    """For each prob the two ranks (from 0) among ``_n`` values that enclose it, and the part between them."""
    places = F.array(*[F.struct(F.lit(i).alias("p"), ((F.col("_n") - 1) * F.lit(float(p))).alias("place")) for i, p in enumerate(probs)])

    def end(s, side, rank):
        return F.struct(s["p"].alias("p"), F.lit(side).alias("side"), rank(s["place"]).cast("long").alias("rank"), (s["place"] - F.floor(s["place"])).alias("part"))

    return F.flatten(F.transform(places, lambda s: F.array(end(s, 0, F.floor), end(s, 1, F.ceil))))


def cell_shift(least: Column, greatest: Column, cells: int) -> Column:
    """Bits to drop so that the range has about ``cells`` parts; the range may be wider than a long."""
    width = greatest.cast("double") - least.cast("double") + 1.0
    return F.greatest(F.lit(0), F.ceil(F.log2(width)) - int(np.log2(cells))).cast("int")


def _inside(long: DataFrame, cells: DataFrame, series: list) -> DataFrame:
    """The rows of ``long`` that lie in a cell, with its least value and shift; the cells of a series are few."""
    extra = [c for c in ("_shift",) if c in cells.columns]
    spans = cells.groupBy(*series).agg(F.collect_list(F.struct("_lo", "_hi", *extra)).alias("_spans"))
    joined = lookup_join(long, spans, series, "inner", null_safe=True)
    span = F.filter("_spans", lambda s: (F.col("_o") >= s["_lo"]) & (F.col("_o") <= s["_hi"]))
    rows = joined.select(*series, "_o", F.explode(span).alias("_s"))
    return rows.select(*series, "_o", F.col("_s._lo").alias("_lo"), *[F.col(f"_s.{c}").alias(c) for c in extra])


def _located(parts: DataFrame, cells: DataFrame, series: list, order: str) -> DataFrame:
    """The parts (with ``_n`` rows each) that hold a wanted rank of their cell, with the ranks counted in the part."""
    within = Window.partitionBy(*series, "_lo").orderBy(order)
    counted = parts.withColumn("_upto", F.sum("_n").over(within))
    wanted = cells.select(*series, "_lo", F.col("_ranks").alias("_all"))
    joined = lookup_join(counted, wanted, [*series, "_lo"], "inner", null_safe=True)
    before = F.col("_upto") - F.col("_n")
    held = F.filter("_all", lambda r: (r["rank"] >= before) & (r["rank"] < F.col("_upto")))
    moved = F.transform(held, lambda r: r.withField("rank", r["rank"] - before))
    return joined.withColumn("_ranks", moved).filter(F.size("_ranks") > 0).drop("_all", "_upto")


def _refined(long: DataFrame, state: DataFrame, series: list, cells: int) -> DataFrame:
    """The next, narrower cells."""
    shifted = state.withColumn("_shift", cell_shift(F.col("_lo"), F.col("_hi"), cells))
    rows = _inside(long, shifted, series).withColumn("_part", F.expr("shiftright(_o, _shift)"))
    parts = rows.groupBy(*series, "_lo", "_part").agg(F.min("_o").alias("_least"), F.max("_o").alias("_most"), F.count("*").alias("_n"))
    found = _located(parts, state, series, "_part")
    return found.select(*series, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_n", "_ranks")


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    exact: dict[str, tuple[str, float]],
    inline_rows: int = INLINE_ROWS,
    cells: int = CELLS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Group aggregation ``aggs`` plus exact percentiles ``{alias: (column, prob)}``.

    ``df`` holds only what the aggregation reads; it is computed once, into a written table. One shuffle
    when every group fits a task, otherwise the percentiles come from cells and are joined to the other
    aggregates by group.
    """
    keys = list(keys)
    columns = sorted({c for c, _ in exact.values()})
    df = written(df, "narrow")
    if _largest_group(df, keys) * len(columns) <= inline_rows:
        asked = {c: sorted({float(p) for x, p in exact.values() if x == c}) for c in columns}
        arrays = [
            F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(f"_p_{c}") for c, probs in asked.items()
        ]
        table = df.groupBy(*keys).agg(*aggs, *arrays)
        picked = [F.element_at(f"_p_{c}", asked[c].index(float(p)) + 1).alias(a) for a, (c, p) in exact.items()]
        return table.select("*", *picked).drop(*[f"_p_{c}" for c in columns])
    probs = sorted({float(p) for _, p in exact.values()})
    arrays = percentiles(df, columns, probs, keys, inline_rows, cells, finish_rows, stable=True)
    picked = arrays.select(
        *keys, *[F.element_at(c, probs.index(float(p)) + 1).alias(a) for a, (c, p) in exact.items()]
    )
    if keys:
        return lookup_join(df.groupBy(*keys).agg(*aggs), picked, list(keys), "left", null_safe=True)
    row = picked.first()
    return df.agg(*aggs).select("*", *[F.lit(row[a]).cast("double").alias(a) for a in exact])

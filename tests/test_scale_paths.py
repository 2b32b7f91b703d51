"""The ways taken when a group, dictionary or lookup table is too long for one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from worthline.operators import chartdata, deviation, impute, lookup, mapping, metrics, quantiles
from worthline.operators.ordering import number_rows
from worthline.plans.entities import entities, people


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark, small):
    """One key holds about two thirds of the rows and one value half of those."""
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    key = F.when(F.col("l_linenumber") < 5, F.lit("hot")).when(F.col("l_linenumber") == 5, None).otherwise(F.col("l_returnflag"))
    value = F.when(F.col("l_tax") < 0.04, F.lit(7.0)).when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_extendedprice"))
    return df.select(key.alias("k"), value.alias("v"), "l_quantity", "l_orderkey", "l_linenumber").cache()


@pytest.mark.parametrize("cells, finish", [(4, 1), (64, 50), (4096, 100_000)])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_by_cells_equal_builtin(skewed, keys, cells, finish):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    plain = quantiles.percentiles(skewed, ["v", "l_quantity"], probs, keys)
    counted = quantiles.percentiles(skewed, ["v", "l_quantity"], probs, keys, inline_rows=0, cells=cells, finish_rows=finish)
    one, two = (sorted(t.collect(), key=lambda r: str([r[k] for k in keys])) for t in (plain, counted))
    assert len(one) == len(two)
    for a, b in zip(one, two):
        assert [a[k] for k in keys] == [b[k] for k in keys]
        for c in ("v", "l_quantity"):
            assert a[c] == pytest.approx(b[c], rel=1e-12)


def test_percentiles_of_a_column_without_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0)], "k string, v double, w double")
    for inline in (0, 100):
        got = quantiles.medians(df, ["v", "w"], ["k"], inline_rows=inline).first()
        assert got["v"] is None and got["w"] == 1.5


def test_group_report_does_not_depend_on_the_path(spark, small):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, small)))
    one = deviation.group_deviation_stats(df, "country")
    two = deviation.group_deviation_stats(df, "country", inline_rows=0, cells=64, finish_rows=20)
    assert rows(one) == rows(two.select(*one.columns))
    whole = metrics.within_pct_share(df).first()
    cells = metrics.within_pct_share(df, inline_rows=0).first()
    assert whole["median_pct"] == pytest.approx(cells["median_pct"])


def test_report_does_not_depend_on_partitioning(spark, small):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, small)))
    assert rows(deviation.group_deviation_stats(df.repartition(1), "grp")) == rows(deviation.group_deviation_stats(df.repartition(7), "grp"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_spread_join_equals_broadcast_join(spark, skewed, how, null_safe):
    table = spark.createDataFrame([("hot", 1), ("A", 2), (None, 3), ("unused", 4)], "k string, code int")
    one = lookup.lookup_join(skewed, table, ["k"], how, null_safe=null_safe)
    two = lookup.lookup_join(skewed, table, ["k"], how, max_rows=0, null_safe=null_safe)
    assert one.columns == two.columns
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.count() == two.count()


def test_spread_join_splits_equal_rows_of_a_hot_key(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for name, value in zip(kept, ("-1", "false", "16")):
            spark.conf.set(name, value)
        joined = lookup.spread_join(left, table, ["k"], "inner")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 20_000
    assert len(sizes) > 8 and max(sizes) < 5_000


def test_percentile_routes_agree_on_infinite_and_not_a_number(spark):
    values = [float("-inf"), 1.0, 2.0, 5.0, float("inf"), float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.1, 0.4, 0.6, 0.8, 1.0]
    short, long = (quantiles.percentiles(df, ["v"], probs, inline_rows=n, cells=8, finish_rows=2).first()["v"] for n in (100, 0))
    assert list(map(str, short)) == list(map(str, long))


def test_ordinals_sort_as_the_doubles_and_come_back():
    edge = [float("-inf"), -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 2.5, 1.7e308, float("inf"), float("nan")]
    places = quantiles.ordinals(np.array(edge))
    assert (np.diff(places) > 0).all()
    assert str(quantiles.doubles(places).tolist()) == str(edge)
    assert quantiles.ordinals(np.array([-0.0]))[0] == quantiles.ordinals(np.array([0.0]))[0]


def test_cells_of_a_pass_are_bounded_and_six_passes_suffice(spark):
    """By arithmetic, for any number of rows: the widest range is down to single values after six cuts of 4096."""
    ends = [(-(2**63), 2**63 - 1), (0, 2**63 - 1), (-5, 5), (7, 8), (-(2**62), 2**62 + 12345), (0, 2**53 + 1), (10, 10 + 4095), (10, 10 + 4096)]
    df = spark.createDataFrame(ends, "lo long, hi long")
    for r in df.withColumn("s", quantiles.cell_shift(F.col("lo"), F.col("hi"), quantiles.CELLS)).collect():
        parts = (r["hi"] >> r["s"]) - (r["lo"] >> r["s"]) + 1
        assert parts <= quantiles.CELLS + 2
        assert 2 ** r["s"] <= max(1, 2 * (r["hi"] - r["lo"] + 1) / quantiles.CELLS)
    width, passes = 2**64, 0
    while width > 1:
        width, passes = max(1, 2 * width // quantiles.CELLS), passes + 1
    assert passes <= 6


def test_percentiles_of_values_crowded_at_one_end(spark):
    """Almost all values lie in a sliver of the range, so that one cut cannot part them."""
    crowd = spark.range(3000).select(((F.col("id") % 997) * 1e-9 + 1.0).alias("v"))
    wide = spark.createDataFrame([(-1e300,), (0.0,), (1e300,), (None,)], "v double")
    df = crowd.union(wide)
    probs = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    one = quantiles.percentiles(df, ["v"], probs).first()["v"]
    two = quantiles.percentiles(df, ["v"], probs, inline_rows=0, cells=8, finish_rows=3).first()["v"]
    assert one == pytest.approx(two, rel=1e-14)


def test_the_source_of_a_report_is_read_once(spark, small):
    """Rows that pass a counter on their way are as many as the table has."""
    for options in ({}, {"inline_rows": 0, "cells": 64, "finish_rows": 20}):
        seen = spark.sparkContext.accumulator(0)

        def watch(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        df = deviation.add_deviation(entities(spark, small)).select("country", "value", "predicted", "abs_diff", "rel_diff")
        deviation.group_deviation_stats(df.mapInArrow(watch, df.schema), "country", **options).collect()
        assert seen.value == df.count()


def test_long_dictionary_is_numbered_like_a_short_one(spark, small):
    df = people(spark, small).select("name", "country", "sponsor")
    short = mapping.encode_dictionary(df, ["name", "country", "sponsor"])
    long = mapping.encode_dictionary(df, ["name", "country", "sponsor"], max_rows=10)
    assert rows(short) == rows(long.select(*short.columns))
    encoded = mapping.label_encode(df, short, ["name", "sponsor"])
    spread = mapping.label_encode(df, long, ["name", "sponsor"], max_rows=10)
    assert rows(encoded.na.fill(-1)) == rows(spread.na.fill(-1))


def test_number_rows_counts_every_group_from_one(spark, skewed):
    got = number_rows(skewed, ["l_quantity", "l_orderkey", "l_linenumber"], ["k"])
    check = got.groupBy("k").agg(F.count("*").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("d"))
    for r in check.collect():
        assert (r["lo"], r["hi"], r["d"]) == (1, r["n"], r["n"])
    ordered = [r["l_quantity"] for r in got.filter("k = 'hot'").orderBy("position").collect()]
    assert ordered == sorted(ordered)


def test_operators_take_the_cell_path(spark, small):
    df = entities(spark, small)
    for a, b in (
        (impute.impute_median(df, ["f_qty"], ["segment"]), impute.impute_median(df, ["f_qty"], ["segment"], inline_rows=0)),
        (chartdata.box_stats(df, "raw_value", ["country"]), chartdata.box_stats(df, "raw_value", ["country"], inline_rows=0)),
        (chartdata.qq_points(df, "raw_value", ["segment"]), chartdata.qq_points(df, "raw_value", ["segment"], inline_rows=0)),
    ):
        numbers = [c for c, t in a.dtypes if t == "double"]
        one, two = (t.select(*[F.round(c, 6).alias(c) if c in numbers else c for c in a.columns]) for t in (a, b))
        assert one.exceptAll(two).count() == 0

"""Rules with known outcomes, and awkward values."""

import math

import pytest
from pyspark.sql import functions as F

from worthline.functions import scalars
from worthline.operators import (
    chartdata,
    cluster_rules,
    columns,
    correlate,
    deviation,
    filters,
    impute,
    mapping,
    metrics,
    profile,
    ranking,
    scale,
    search,
    split,
)

# Published inertia for K = 1..10 and the number of clusters chosen.
SERIES = [
    ([894.00, 489.77, 306.79, 207.38, 142.68, 106.31, 85.17, 73.64, 64.56, 57.17], 4),
    ([1342.00, 675.02, 422.94, 292.71, 217.10, 184.97, 154.02, 133.09, 115.65, 103.82], 3),
    ([456.00, 210.79, 105.73, 73.68, 55.09, 43.04, 35.41, 30.77, 25.65, 21.93], 3),
    ([1058.00, 582.44, 348.89, 234.50, 170.49, 134.54, 110.87, 91.65, 80.75, 71.06], 4),
]


@pytest.mark.parametrize("values, expected", SERIES)
def test_elbow_of_published_series(spark, values, expected):
    df = spark.createDataFrame(list(enumerate(values, start=1)), "k int, inertia double")
    assert cluster_rules.elbow_k(df).first()["k"] == expected


def test_elbow_distance_and_groups(spark):
    data = [(str(g), k, v) for g, (values, _) in enumerate(SERIES) for k, v in enumerate(values, start=1)]
    df = spark.createDataFrame(data, "g string, k int, inertia double")
    got = {r["g"]: r["k"] for r in cluster_rules.elbow_k(df, ["g"]).collect()}
    assert got == {str(g): k for g, (_, k) in enumerate(SERIES)}


@pytest.mark.parametrize("points", [[(1, 9.0), (2, 4.0)], [(1, 9.0)]])
def test_elbow_with_few_points_is_three(spark, points):
    df = spark.createDataFrame(points, "k int, inertia double")
    assert cluster_rules.elbow_k(df).first()["k"] == 3


def test_reports_of_tables_without_rows_or_spread(spark):
    none = spark.createDataFrame([], "id long, v double, w double")
    one = spark.createDataFrame([(1, 4.0, 4.0), (2, 4.0, 5.0)], "id long, v double, w double")
    assert deviation.iqr_outliers(none, "v").count() == 0
    assert deviation.quartile_band_error(none, "v", "w").count() == 4
    assert chartdata.density_grid(none, "v").count() == 0
    assert chartdata.density_grid(one, "v").count() == 0
    assert chartdata.histogram(one, "v", 4).agg(F.sum("n")).first()[0] == 2
    assert chartdata.box_stats(one, "v").first()["whisker_high"] == 4.0
    assert profile.describe_numeric(none, ["v"]).first()["n"] == 0
    assert metrics.regression_metrics(none, [], "v", "w").first()["n"] == 0
    assert scale.fit_scaler(none, ["v"]) == {"v": (0.0, 1.0)}


def test_choose_k_clamps(spark):
    df = spark.createDataFrame([(1, 10), (4, 10), (12, 10), (9, 6)], "elbow int, top int")
    got = [r[0] for r in df.select(cluster_rules.choose_k(F.col("elbow"), F.col("top"))).collect()]
    assert got == [2, 4, 10, 6]


@pytest.mark.parametrize("k, good, poor, expected", [(4, 1, 0, "BUENA"), (3, 1, 0, "EXCELENTE"), (4, 2, 0, "EXCELENTE"), (4, 2, 2, "REGULAR"), (4, 0, 3, "POBRE"), (4, 3, 1, "BUENA")])
def test_overall_quality(spark, k, good, poor, expected):
    df = spark.createDataFrame([(k, good, poor)], "k int, good int, poor int")
    assert df.select(scalars.overall_band("good", "poor", "k")).first()[0] == expected


def test_selection_keeps_sixteen_of_forty_two(spark):
    df = spark.createDataFrame([("s", f"v{i:02d}", float(i)) for i in range(42)], "segment string, variable string, coefficient double")
    chosen = ranking.top_pct_select(ranking.rank_features(df), 40)
    assert chosen.filter("kept").count() == 16
    assert ranking.eliminated_report(chosen).count() == 26


def test_selection_always_keeps_protected_and_one_more(spark):
    df = spark.createDataFrame([("s", "a", 5.0), ("s", "b", -9.0), ("s", "p", 0.0)], "segment string, variable string, coefficient double")
    chosen = ranking.top_pct_select(ranking.rank_features(df), 10, ["p"])
    assert {r["variable"] for r in chosen.filter("kept").collect()} == {"b", "p"}
    assert [r["variable"] for r in ranking.kept_report(chosen).orderBy("rank").collect()] == ["p", "b"]


def test_overfit_ratio_modes(spark):
    df = spark.createDataFrame([(0.9375, 0.7564), (0.5, 0.0), (0.5, -0.25), (-0.5, 0.0)], "a double, b double")

    def values(mode):
        return [r[0] for r in df.select(metrics.overfit_ratio("a", "b", mode)).collect()]

    assert values("r2_abs")[0] == pytest.approx(1.239, abs=1e-3)
    assert values("r2_abs")[1:] == [math.inf, 2.0, 1.0]
    assert values("r2")[1:] == [math.inf, math.inf, math.inf]
    assert values("r2_inverse")[2] == -0.5
    assert values("rmse")[1] is None


def test_deviation_of_zero_targets_is_null(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (10.0, 12.5)], "value double, predicted double")
    got = [r["rel_diff"] for r in deviation.add_deviation(df).collect()]
    assert got == [None, -50.0, 25.0]
    assert deviation.filter_tolerance(deviation.add_deviation(df)).count() == 1
    opposite = [r["value_diff_pct"] for r in deviation.add_deviation_real_minus_pred(df).collect()]
    assert opposite == [None, 50.0, -25.0]


def test_awkward_text(spark):
    df = spark.createDataFrame([("jean-luc  PICARD",), ("12.5-3",), ("élan-vital",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.title_case("t")).collect()] == ["Jean Luc Picard", "12.5-3", "Élan Vital", "", None]
    numbers = spark.createDataFrame([("12,456",), ("x",), ("-3,5",)], "t string")
    assert [r[0] for r in numbers.select(scalars.parse_decimal_comma("t")).collect()] == [12.46, None, -3.5]
    cells = spark.createDataFrame([("12,456",), ("la-palma",)], "t string")
    assert [r[0] for r in cells.select(scalars.tidy_cell("t")).collect()] == ["12.46", "La Palma"]


def test_currency_and_percent(spark):
    df = spark.createDataFrame([(None,), (0.0,), (12_345_678.0,), (250_000.0,), (999.5,), (1_000_000.0,)], "v double")
    got = [r[0] for r in df.select(scalars.format_currency("v")).collect()]
    assert got == ["No valorado", "No valorado", "€12.3M", "€250K", "€999.5", "€1.0M"]
    pct = spark.createDataFrame([(12.34567,), (None,), (5.0,), (-0.00001,)], "v double")
    assert [r[0] for r in pct.select(scalars.format_percent("v")).collect()] == ["12.346%", "0%", "5%", "0%"]


def test_infinite_values_are_ignored_by_the_scaler(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (float("inf"), 4.0), (float("nan"), None)], "a double, b double")
    params = scale.fit_scaler(df, ["a", "b"])
    assert params == {"a": (2.0, 1.0), "b": (4.0, 1.0)}
    assert [r["a"] for r in scale.scale(df, params).collect()] == [-1.0, 1.0, None, None]
    back = scale.unscale_from_original(scale.scale(df, params), df, ["a", "b"])
    assert [r["a"] for r in back.collect()][:2] == [1.0, 3.0]


def test_mode_takes_smallest_on_ties_and_default_without_values(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("y", None)], "g string, v string")
    got = {(r["g"], r["v"]) for r in impute.impute_mode(df, "v", ["g"]).collect()}
    assert got == {("x", "b"), ("x", "a"), ("y", "0")}


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert [r["v"] for r in impute.impute_median(df, ["v"]).collect()][-1] == 2.5


def test_guard_drops_small_segments(spark):
    data = [(s, i) for s, n in (("a", 9), ("b", 10), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "s string, i int")
    assert {r["s"] for r in filters.min_sample_guard(df, "s", 10).collect()} == {"b"}


def test_search_levels(spark):
    df = spark.createDataFrame([("Ana", "Real", 91.0), ("Real", "Madrid", 70.0), ("Eva", None, None)], "name string, club string, rating double")
    assert [r["name"] for r in search.search_cascade(df, "real", ["name", "club"]).collect()] == ["Real"]
    assert [r["name"] for r in search.search_cascade(df, "madrid", ["name", "club"]).collect()] == ["Real"]
    assert [r["name"] for r in search.search_cascade(df, "RATING >= 90", ["name", "club"]).collect()] == ["Ana"]
    assert search.search_cascade(df, "nobody", ["name", "club"]).count() == 0
    with pytest.raises(ValueError):
        search.numeric_condition(df, "age > 3")
    with pytest.raises(ValueError):
        search.sort_preset(df, "age", {"age": "age"}, "name")


def test_columns_tolerate_missing_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert columns.reorder_columns(df, ["c", "x"]).columns == ["c", "a", "b"]
    assert columns.drop_columns(df, ["a", "x"]).columns == ["b", "c"]
    assert columns.feature_columns(df, ["A"]) == ["b", "c"]


def test_split_depends_on_the_key_only(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    one = split.with_split(df.repartition(3), "k").filter("split = 'test'")
    two = split.with_split(df.coalesce(1), "k").filter("split = 'test'")
    assert one.exceptAll(two).count() == 0
    negative = split.with_split(spark.range(-20_000, 0).withColumnRenamed("id", "k"), "k")
    assert negative.filter("split = 'test'").count() / 20_000 == pytest.approx(0.2, abs=0.01)
    assert one.count() / 20_000 == pytest.approx(0.2, abs=0.01)
    assert split.small_set_test_share(20) == 0.25
    assert split.small_set_test_share(1000) == 0.1


def test_profile_counts(spark):
    df = spark.createDataFrame([("a", "NULL"), ("a", "NULL"), (None, "x")], "p string, q string")
    assert tuple(profile.count_literal_cells(df).first()) == (2, 6)
    assert tuple(profile.dedupe_report(df).first()) == (3, 2, 1)
    assert {(r[0], r[1]) for r in profile.distinct_counts(df, ["p", "q"]).collect()} == {("p", 1), ("q", 2)}
    assert [tuple(r) for r in profile.value_counts(df, "p").collect()] == [("a", 2)]


def test_codes_outside_the_dictionary_become_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    dictionary = mapping.encode_dictionary(df, ["c"])
    coded = spark.createDataFrame([(0,), (1,), (9,), (None,)], "c int")
    assert [r["c"] for r in mapping.label_decode(coded, dictionary, ["c"]).collect()] == ["a", "b", None, None]
    assert [r["c"] for r in mapping.unmapped_codes(coded, dictionary, "c").collect()] == [9]


def test_correlation_p_value(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    ys = [2.0, 1.0, 4.0, 3.0, 6.0, 5.0]
    df = spark.createDataFrame([(x, y, None, 4.0) for x, y in zip(xs, ys)], "x double, y double, z double, same double")
    (row,) = correlate.pearson_vs_target(df, ["x", "z", "same"], "y").collect()
    (pair,) = correlate.corr_matrix_top(df, ["x", "z", "same"], "y").collect()
    assert pair["r"] == pytest.approx(29 / 35)
    assert row["correlation"] == pytest.approx(29 / 35)
    assert row["p_value"] == pytest.approx(0.0415626822, abs=1e-8)


def test_constant_group_scores(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0), ("a", 5.0, 6.0), ("b", 0.0, 1.0)], "g string, value double, predicted double")
    got = {r["g"]: r for r in metrics.regression_metrics(df, ["g"]).collect()}
    assert got["a"]["r2"] == 0.0 and got["a"]["mae"] == 1.0
    assert got["b"]["r2"] is None and got["b"]["n"] == 1
    mape = {r["g"]: r["mape"] for r in metrics.safe_mape(df, ["g"]).collect()}
    assert mape == {"a": pytest.approx(20.0), "b": None}

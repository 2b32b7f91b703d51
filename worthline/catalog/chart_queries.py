"""Chart data."""

from pyspark.sql import functions as F

from worthline.catalog.cluster_queries import COLUMNS, SILHOUETTE, assigned
from worthline.catalog.profile_queries import MAPE, SCORES, scored
from worthline.catalog.registry import query, r
from worthline.functions.scalars import direction_class
from worthline.operators import chartdata, kmeans, metrics
from worthline.plans.entities import entities

BINS = """l as (select segment, min(err) lo, max(err) hi, count(*) total from t group by segment),
  b as (select segment, least(floor((err - lo) / (hi - lo) * 25), 24)::int bin, count(*) n from t join l using (segment) group by all),
  g as (select segment, bin::int bin, lo, (hi - lo) / 25 w, total from l, range(25) x(bin))"""


@query(
    "histogram",
    f"""with t as (select segment, value - predicted err from entities), {BINS}
    select g.segment, g.bin, round(lo + g.bin * w, 3) + 0.0 low, round(lo + (g.bin + 1) * w, 3) + 0.0 high, coalesce(n, 0) n, round(coalesce(n, 0) / (total * w) * 1e6, 6) + 0.0 density
    from g left join b on g.segment = b.segment and g.bin = b.bin""",
)
def _(spark, folder):
    df = entities(spark, folder).select("segment", (F.col("value") - F.col("predicted")).alias("err"))
    out = chartdata.histogram(df, "err", 25, ["segment"], density=True)
    return out.select("segment", "bin", r("low", 3).alias("low"), r("high", 3).alias("high"), "n", r(F.col("density") * 1e6, 6).alias("density"))


@query(
    "box_stats",
    """with q as (select country, quantile_cont(raw_value, 0.25) q1, quantile_cont(raw_value, 0.5) q2, quantile_cont(raw_value, 0.75) q3 from entities group by country)
    select country, count(*) n, round(avg(raw_value), 3) + 0.0 mean, round(any_value(q1), 3) + 0.0 q1, round(any_value(q2), 3) + 0.0 q2, round(any_value(q3), 3) + 0.0 q3,
      round(least(min(raw_value) filter (raw_value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), any_value(q1)), 3) + 0.0 whisker_low,
      round(greatest(max(raw_value) filter (raw_value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), any_value(q3)), 3) + 0.0 whisker_high,
      count(*) filter (raw_value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) n_outliers
    from entities join q using (country) group by country""",
)
def _(spark, folder):
    out = chartdata.box_stats(entities(spark, folder), "raw_value", ["country"])
    return out.select("country", "n", "n_outliers", *[r(c, 3).alias(c) for c in ("mean", "q1", "q2", "q3", "whisker_low", "whisker_high")])


@query(
    "density_grid",
    """with t as (select abs(value - predicted) err from entities),
    f as (select count(*) n, min(err) lo, max(err) hi, stddev_samp(err) * power(count(*), -0.2) h from t)
    select point::int point, round(lo + point * (hi - lo) / 99, 3) + 0.0 x, round(1e6 * sum(exp(-power((lo + point * (hi - lo) / 99 - err) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 density
    from t, f, range(100) g(point) group by point, lo, hi""",
)
def _(spark, folder):
    df = entities(spark, folder).select(F.abs(F.col("value") - F.col("predicted")).alias("err"))
    out = chartdata.density_grid(df, "err")
    return out.select("point", r("x", 3).alias("x"), r(F.col("density") * 1e6, 6).alias("density"))


NORMAL = ", ".join(f"({i + 1}, {q!r}::double)" for i, q in enumerate(chartdata.normal_quantiles()))


@query(
    "qq_points",
    f"""with t as (select segment, value - predicted res from entities), q as (select * from (values {NORMAL}) x(point, theoretical)),
    o as (select segment, unnest(quantile_cont(res, [{", ".join(str((i + 1) / 100) for i in range(99))}])) observed, unnest(range(1, 100)) point from t group by segment)
    select segment, point::int point, round(theoretical, 6) + 0.0 theoretical, round(round(observed, 8), 3) + 0.0 observed from o join q using (point)""",
)
def _(spark, folder):
    df = entities(spark, folder).select("segment", (F.col("value") - F.col("predicted")).alias("res"))
    out = chartdata.qq_points(df, "res", ["segment"])
    return out.select("segment", "point", r("theoretical", 6).alias("theoretical"), r(F.round("observed", 8), 3).alias("observed"))


@query("identity_bounds", "select segment, round(least(min(value), min(predicted)), 4) + 0.0 low, round(greatest(max(value), max(predicted)), 4) + 0.0 high from entities group by segment")
def _(spark, folder):
    out = chartdata.identity_bounds(entities(spark, folder), keys=["segment"])
    return out.select("segment", r("low").alias("low"), r("high").alias("high"))


@query(
    "cluster_bar_normalised",
    """with m as (select grp, avg(raw_value) / 1e6 main_mean, avg(f_acctbal) other_mean from entities group by grp)
    select grp, round(round(main_mean, 10), 6) + 0.0 main_mean, round(round(other_mean, 8), 4) + 0.0 other_mean, round(other_mean * (select max(main_mean) / max(other_mean) from m), 6) + 0.0 other_scaled from m""",
)
def _(spark, folder):
    out = chartdata.bars_normalised(entities(spark, folder), "grp", "raw_value", "f_acctbal")
    return out.select("grp", r(F.round("main_mean", 10), 6).alias("main_mean"), r(F.round("other_mean", 8)).alias("other_mean"), r("other_scaled", 6).alias("other_scaled"))


_WIDE = ", ".join(f"max({m}) filter (split = '{s}') {s}_{m}" for s in ("train", "test") for m in ("r2", "mae", "mse", "rmse", "mape"))


@query(
    "metric_bars_normalised",
    f"""with {SCORES}, {MAPE}, w as (select country, {_WIDE} from s join m using (country, split) group by country)
    select country, 'r2' metric, round(train_r2, 6) + 0.0 train, round(test_r2, 6) + 0.0 test from w
    union all select country, 'mape', round(train_mape / 100, 6) + 0.0, round(test_mape / 100, 6) + 0.0 from w """
    + " ".join(f"union all select country, '{m}', round(train_{m} / greatest(train_{m}, test_{m}), 6) + 0.0, round(test_{m} / greatest(train_{m}, test_{m}), 6) + 0.0 from w" for m in ("mae", "mse", "rmse")),
)
def _(spark, folder):
    out = chartdata.metric_bars_normalised(metrics.segment_summary(scored(spark, folder), "country"))
    return out.select("country", "metric", r("train", 6).alias("train"), r("test", 6).alias("test"))


@query(
    "cluster_means",
    """select grp, count(*) n, round(round(avg(f_acctbal), 8), 4) + 0.0 x, round(round(avg(raw_value), 8), 4) + 0.0 y, (select min(f_acctbal) from entities) x_min, (select max(f_acctbal) from entities) x_max,
    (select min(raw_value) from entities) y_min, (select max(raw_value) from entities) y_max from entities group by grp""",
)
def _(spark, folder):
    out = chartdata.group_means(entities(spark, folder), "grp", "f_acctbal", "raw_value")
    return out.withColumns({"x": r(F.round("x", 8)), "y": r(F.round("y", 8))})


@query(
    "silhouette_profile",
    f"with {SILHOUETTE} select entity_id, label, row_number() over (partition by label order by round(silhouette, 9), entity_id) place, round(round(silhouette, 9), 6) + 0.0 silhouette from sil",
)
def _(spark, folder):
    samples = kmeans.silhouette_samples(assigned(spark, folder), COLUMNS).withColumn("silhouette", F.round("silhouette", 9))
    return chartdata.silhouette_profile(samples, "entity_id").withColumn("silhouette", r("silhouette", 6))


@query(
    "scatter_sample",
    """select floor(value / 20000.0)::bigint value_bin, floor(predicted / 20000.0)::bigint predicted_bin,
      case when predicted > value then 'higher' when predicted < value then 'lower' else 'neutral' end kind, count(*) n
    from entities where value is not null and predicted is not null group by all""",
)
def _(spark, folder):
    return chartdata.scatter_bins(entities(spark, folder), "value", "predicted", direction_class("predicted", "value"), 20000.0)

"""Deviation of predicted from actual values."""

from pyspark.sql import functions as F

from worthline.catalog.registry import query, r
from worthline.operators import deviation
from worthline.plans.deviation_report import scored_groups
from worthline.plans.entities import entities

DIFF = """d as (select *, predicted - value as abs_diff,
  case when value = 0 then null else (predicted - value) / value * 100 end as rel_diff from entities),
ok as (select * from d where abs(rel_diff) <= 25)"""


@query(
    "add_deviation",
    f"with {DIFF} select entity_id, round(abs_diff, 4) + 0.0 abs_diff, round(rel_diff, 4) + 0.0 rel_diff from d",
)
def _(spark, folder):
    df = deviation.add_deviation(entities(spark, folder))
    return df.select("entity_id", r("abs_diff").alias("abs_diff"), r("rel_diff").alias("rel_diff"))


@query(
    "add_deviation_real_minus_pred",
    """select entity_id, round(value - predicted, 4) + 0.0 value_diff,
    case when value <> 0 then round((value - predicted) / value * 100, 4) + 0.0 end value_diff_pct from entities""",
)
def _(spark, folder):
    text = entities(spark, folder).withColumns({"value": F.col("value").cast("string"), "predicted": F.col("predicted").cast("string")})
    df = deviation.add_deviation_real_minus_pred(text)
    return df.select("entity_id", r("value_diff").alias("value_diff"), r("value_diff_pct").alias("value_diff_pct"))


@query(
    "add_flag_within_tolerance",
    f"with {DIFF} select entity_id, abs(rel_diff) <= 25 as within_tolerance from d",
)
def _(spark, folder):
    df = deviation.add_flag_within_tolerance(deviation.add_deviation(entities(spark, folder)))
    return df.select("entity_id", "within_tolerance")


@query("filter_tolerance", f"with {DIFF} select entity_id, round(rel_diff, 4) + 0.0 rel_diff from ok")
def _(spark, folder):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, folder)))
    return df.select("entity_id", r("rel_diff").alias("rel_diff"))


@query(
    "removed_rows_profile",
    f"""with {DIFF} select count(*) n_before, count(*) filter (abs(rel_diff) > 25) n_removed,
    round(100.0 * count(*) filter (abs(rel_diff) > 25) / count(*), 4) + 0.0 pct_removed,
    round(avg(rel_diff) filter (abs(rel_diff) > 25), 4) + 0.0 mean_rel,
    round(min(rel_diff) filter (abs(rel_diff) > 25), 4) + 0.0 min_rel,
    round(max(rel_diff) filter (abs(rel_diff) > 25), 4) + 0.0 max_rel from d where rel_diff is not null""",
)
def _(spark, folder):
    df = deviation.removed_rows_profile(deviation.add_deviation(entities(spark, folder)))
    return df.select("n_before", "n_removed", *[r(c).alias(c) for c in ("pct_removed", "mean_rel", "min_rel", "max_rel")])


GROUP = """select {key}, n, {rounded}{extra} from (
  select {key}, count(*) n, avg(rel_diff) rel_mean, median(rel_diff) rel_median, stddev_samp(rel_diff) rel_std,
    avg(abs_diff) abs_mean, median(abs_diff) abs_median, avg(value) real_mean, avg(predicted) pred_mean
  from ok where {key} is not null group by {key}) where n >= {k}"""
STATS = ["rel_mean", "rel_median", "rel_std", "abs_mean", "abs_median", "real_mean", "pred_mean"]


def group_sql(key, k, absolute=True):
    rounded = ", ".join(f"round_even(round({c}, 9), 2) + 0.0 as {c}" for c in STATS)
    extra = ", abs(round_even(round(rel_mean, 9), 2)) + 0.0 as rel_abs" if absolute else ""
    return f"with {DIFF} " + GROUP.format(key=key, rounded=rounded, extra=extra, k=k)


@query("group_deviation_stats", group_sql("grp", 3))
def _(spark, folder):
    return scored_groups(entities(spark, folder), "grp", 3)


@query("group_deviation_stats_country", group_sql("country", 5))
def _(spark, folder):
    return scored_groups(entities(spark, folder), "country", 5)


@query("group_deviation_stats_signed", group_sql("sponsor", 3, absolute=False))
def _(spark, folder):
    return scored_groups(entities(spark, folder), "sponsor", 3, signed=True)


@query("having_min_count", f"with {DIFF} select name, count(*) n from ok group by name having count(*) >= 3")
def _(spark, folder):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, folder)))
    return deviation.having_min_count(df, "name", 3)


@query(
    "signed_share",
    f"""with {DIFF} select count(*) n, count(*) filter (abs_diff > 0) n_over, count(*) filter (abs_diff < 0) n_under,
    count(*) filter (abs_diff = 0) n_exact, round(100.0 * count(*) filter (abs_diff > 0) / count(*), 4) + 0.0 pct_over,
    round(100.0 * count(*) filter (abs_diff < 0) / count(*), 4) + 0.0 pct_under,
    round(100.0 * count(*) filter (abs_diff = 0) / count(*), 4) + 0.0 pct_exact from d""",
)
def _(spark, folder):
    df = deviation.signed_share(deviation.add_deviation(entities(spark, folder)))
    return df.select("n", "n_over", "n_under", "n_exact", *[r(c).alias(c) for c in ("pct_over", "pct_under", "pct_exact")])


@query(
    "error_buckets",
    f"""with {DIFF} select from_pct, to_pct, count(*) n from d join (values (0.0::double, 5.0::double), (5.0, 10.0), (10.0, 25.0), (25.0, null)) b(from_pct, to_pct)
    on abs(rel_diff) >= from_pct and (to_pct is null or abs(rel_diff) < to_pct) group by from_pct, to_pct""",
)
def _(spark, folder):
    return deviation.error_buckets(deviation.add_deviation(entities(spark, folder)))


def _summary_columns():
    return [f"{c}_{s}" for c in ("abs_diff", "rel_diff") for s in ("mean", "std", "min", "max", "mae", "median")]


_SUMMARY = ", ".join(
    f"round({f.format(c)}, 3) + 0.0 as {c}_{s}"
    for c in ("abs_diff", "rel_diff")
    for s, f in [("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"), ("mae", "avg(abs({}))"), ("median", "median({})")]
)


@query(
    "deviation_summary",
    f"with {DIFF} select 'before' stage, count(*) n, {_SUMMARY} from d where rel_diff is not null "
    f"union all select 'after' stage, count(*) n, {_SUMMARY} from ok",
)
def _(spark, folder):
    df = deviation.deviation_summary(deviation.add_deviation(entities(spark, folder)))
    return df.select("stage", "n", *[r(c, 3).alias(c) for c in _summary_columns()])


PERCENTS = "(values (10), (25), (50), (75), (90), (95), (99)) p(percent)"


@query(
    "error_percentiles",
    """with q as (select quantile_cont(abs(value - predicted), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) a from entities)
    select unnest([10, 25, 50, 75, 90, 95, 99]) as percent, round(unnest(a), 3) + 0.0 as error from q""",
)
def _(spark, folder):
    df = entities(spark, folder).select(deviation.absolute_error().alias("error"))
    return deviation.error_percentiles(df, ["error"]).select("percent", r("error", 3).alias("error"))


@query(
    "real_vs_pred_percentiles",
    """with q as (select quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) a,
      quantile_cont(predicted, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) b from entities)
    select unnest([10, 25, 50, 75, 90, 95, 99]) as percent, round(unnest(a), 3) + 0.0 as value, round(unnest(b), 3) + 0.0 as predicted from q""",
)
def _(spark, folder):
    df = deviation.error_percentiles(entities(spark, folder), ["value", "predicted"])
    return df.select("percent", r("value", 3).alias("value"), r("predicted", 3).alias("predicted"))


@query(
    "quartile_band_error",
    """with t as (select value, abs(value - predicted) err from entities),
    q as (select min(value) q0, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3, max(value) q4 from t)
    select band, round(avg(err), 3) + 0.0 mean_error from t, q, (values (1), (2), (3), (4)) b(band)
    where value between (case band when 1 then q0 when 2 then q1 when 3 then q2 else q3 end)
                    and (case band when 1 then q1 when 2 then q2 when 3 then q3 else q4 end) group by band""",
)
def _(spark, folder):
    df = entities(spark, folder).select("value", deviation.absolute_error().alias("err"))
    return deviation.quartile_band_error(df, "value", "err").select("band", r("mean_error", 3).alias("mean_error"))


@query(
    "iqr_outliers",
    """with t as (select entity_id, abs(value - predicted) err from entities),
    q as (select quantile_cont(err, 0.25) q1, quantile_cont(err, 0.75) q3 from t)
    select entity_id, round(err, 4) + 0.0 err, err > q3 + 1.5 * (q3 - q1) as is_outlier from t, q""",
)
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", deviation.absolute_error().alias("err"))
    return deviation.iqr_outliers(df, "err").select("entity_id", r("err").alias("err"), "is_outlier")


@query(
    "segment_error",
    """select * from (select country, count(*) n, round(avg(abs(value - predicted)), 3) + 0.0 mean_error from entities
    group by country order by count(*) desc, country limit 8) where n > 5""",
)
def _(spark, folder):
    df = entities(spark, folder).withColumn("err", deviation.absolute_error())
    return deviation.segment_error(df, "country", "err").select("country", "n", r("mean_error", 3).alias("mean_error"))


@query("zero_target_count", "select count(*) filter (value = 0) n_zero, count(*) n from entities")
def _(spark, folder):
    return entities(spark, folder).agg(F.count_if(F.col("value") == 0).alias("n_zero"), F.count("*").alias("n"))


@query(
    "head_tail",
    f"""with {DIFF}, g as (select country, round(avg(rel_diff), 6) + 0.0 rel_mean from ok group by country)
    select * from (select 'head' part, country, rel_mean from g order by rel_mean desc, country limit 10)
    union all select * from (select 'tail' part, country, rel_mean from g order by rel_mean, country limit 10)""",
)
def _(spark, folder):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, folder)))
    groups = df.groupBy("country").agg(r(F.avg("rel_diff"), 6).alias("rel_mean"))
    from worthline.operators.search import head_tail

    return head_tail(groups, [F.desc("rel_mean"), F.asc("country")], [F.asc("rel_mean"), F.asc("country")], 10)


@query(
    "sort_abs_desc",
    f"with {DIFF} select entity_id, round(rel_diff, 6) + 0.0 rel_diff from d where rel_diff is not null order by abs(rel_diff) desc, entity_id",
)
def _(spark, folder):
    df = deviation.add_deviation(entities(spark, folder)).filter("rel_diff is not null")
    ordered = df.orderBy(F.abs("rel_diff").desc(), "entity_id")
    return ordered.select("entity_id", r("rel_diff", 6).alias("rel_diff"))


@query(
    "sink_report_rows",
    f"""with {DIFF} select unnest(['general', 'general', 'general', 'general', 'deviation', 'deviation', 'deviation', 'deviation', 'deviation', 'deviation', 'deviation', 'correlation']) as section,
      unnest(['rows', 'distinct_grp', 'distinct_country', 'distinct_sponsor', 'abs_mean', 'rel_mean', 'abs_std', 'abs_error', 'rel_error', 'pct_over', 'pct_under', 'real_vs_predicted']) as metric,
      round(unnest([count(*)::double, count(distinct grp)::double, count(distinct country)::double, count(distinct sponsor)::double,
        avg(abs_diff), avg(rel_diff), stddev_samp(abs_diff), avg(abs(abs_diff)), avg(abs(rel_diff)),
        100.0::double * count(*) filter (abs_diff > 0) / count(*), 100.0::double * count(*) filter (abs_diff < 0) / count(*), corr(value, predicted)]), 3) + 0.0 as value from ok""",
)
def _(spark, folder):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, folder)))
    return deviation.report_rows(df, ["grp", "country", "sponsor"]).withColumn("value", r("value", 3))

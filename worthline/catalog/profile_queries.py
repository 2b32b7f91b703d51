"""Aggregations, lookups, windows and statistics over the entity table."""

from pyspark.sql import functions as F

from worthline.catalog.registry import query, r
from worthline.catalog.shape_queries import PEOPLE, p
from worthline.functions.scalars import correlation
from worthline.operators import correlate, gram, mapping, metrics, profile, ranking
from worthline.operators.split import key_hash_sql, with_split
from worthline.plans.entities import FEATURES, entities, people, table

NUMBERS = [*FEATURES, "raw_value", "value", "predicted"]


def rows_per_column(columns, measures, source="entities"):
    """SQL that yields one row per column, each with the measures (format strings)."""
    parts = [
        f"select '{c}' as variable, " + ", ".join(f"{m.format(c=c)} as {name}" for name, m in measures.items()) + f" from {source}"
        for c in columns
    ]
    return " union all ".join(parts)


def rounded(measure, places=4):
    return f"round({measure}, {places}) + 0.0"


# --- aggregations --------------------------------------------------------------------------------

DESCRIBE = {
    "n": "count({c})",
    "mean": rounded("avg({c})"),
    "std": rounded("stddev_samp({c})"),
    "min": rounded("min({c})"),
    "max": rounded("max({c})"),
    "p25": rounded("quantile_cont({c}, 0.25)", 3),
    "p50": rounded("quantile_cont({c}, 0.5)", 3),
    "p75": rounded("quantile_cont({c}, 0.75)", 3),
}


DESCRIBED = ["f_qty", "f_lines", "f_acctbal", "raw_value", "value", "predicted"]


@query("describe_numeric", rows_per_column(DESCRIBED, DESCRIBE))
def _(spark, folder):
    df = profile.describe_numeric(entities(spark, folder), DESCRIBED)
    return df.select("variable", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max")], *[r(c, 3).alias(c) for c in ("p25", "p50", "p75")])


@query(
    "missing_profile",
    rows_per_column(["sponsor", "f_qty", "f_disc", "name", "value"], {"n_missing": "count(*) - count({c})", "pct": rounded("100.0 * (count(*) - count({c})) / count(*)")}),
)
def _(spark, folder):
    df = profile.missing_profile(entities(spark, folder), ["sponsor", "f_qty", "f_disc", "name", "value"])
    return df.select("variable", "n_missing", r("pct").alias("pct"))


@query("distinct_counts", rows_per_column(["name", "segment", "grp", "country", "sponsor"], {"n_distinct": "count(distinct {c})"}, f"({PEOPLE})"))
def _(spark, folder):
    return profile.distinct_counts(p(spark, folder), ["name", "segment", "grp", "country", "sponsor"])


@query("value_counts", f"select country, count(*) n from ({PEOPLE}) group by country order by n desc, country limit 10")
def _(spark, folder):
    return profile.value_counts(p(spark, folder), "country", 10)


@query("value_share", f"select sponsor, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 4) + 0.0 pct from ({PEOPLE}) group by sponsor")
def _(spark, folder):
    return profile.value_share(p(spark, folder), "sponsor").select("sponsor", "n", r("pct").alias("pct"))


@query(
    "target_variation",
    """select round(avg(value), 4) + 0.0 mean, round(stddev_pop(value), 4) + 0.0 std, min(value) as min, round(max(value), 4) + 0.0 as max,
    round(stddev_pop(value) / avg(value), 6) + 0.0 relative_std,
    case when stddev_pop(value) / avg(value) > 3 then 'high' when stddev_pop(value) / avg(value) < 0.1 then 'low' else 'normal' end variation from entities""",
)
def _(spark, folder):
    df = profile.target_variation(entities(spark, folder), "value")
    return df.select(r("mean").alias("mean"), r("std").alias("std"), "min", r("max").alias("max"), r("relative_std", 6).alias("relative_std"), "variation")


PROFILE_AGGS = {"mean": "avg({c})", "median": "median({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}
PROFILE_SQL = ", ".join(f"round(round({f.format(c=c)}, 8), 3) + 0.0 as {c}_{m}" for c in ("raw_value", "f_acctbal") for m, f in PROFILE_AGGS.items())


@query("cluster_profile", f"select grp, count(*) n, {PROFILE_SQL} from ({PEOPLE}) group by grp")
def _(spark, folder):
    df = profile.group_profile(p(spark, folder), "grp", ["raw_value", "f_acctbal"])
    return df.select("grp", "n", *[r(F.round(f"{c}_{m}", 8), 3).alias(f"{c}_{m}") for c in ("raw_value", "f_acctbal") for m in PROFILE_AGGS])


@query("cluster_value_range", f"select grp, round(max(raw_value) - min(raw_value), 4) + 0.0 value_range from ({PEOPLE}) group by grp")
def _(spark, folder):
    return profile.group_range(p(spark, folder), "grp", "raw_value").select("grp", r("value_range").alias("value_range"))


TWICE = "(select l_orderkey, l_linenumber, l_returnflag from lineitem)"


@query("dedupe_all_columns", f"select distinct * from {TWICE}")
def _(spark, folder):
    return profile.dedupe(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "dedupe_report",
    f"select (select count(*) from {TWICE}) n_before, (select count(*) from (select distinct * from {TWICE})) n_after, (select count(*) from {TWICE}) - (select count(*) from (select distinct * from {TWICE})) n_removed",
)
def _(spark, folder):
    return profile.dedupe_report(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "count_literal_cells",
    f"select (count(*) filter (sponsor is null))::bigint n_literal, count(*) * 3 n_cells from ({PEOPLE})",
)
def _(spark, folder):
    df = p(spark, folder).select("entity_id", "name", F.coalesce("sponsor", F.lit("NULL")).alias("sponsor"))
    return profile.count_literal_cells(df)


SCORES = """s as (select country, split, count(*) n, 1 - sum((value - predicted)^2) / sum((value - m)^2) r2, sqrt(avg((value - predicted)^2)) rmse,
    avg(abs(value - predicted)) mae, avg((value - predicted)^2) mse
  from (select *, case when h_split < 800 then 'train' else 'test' end split,
        avg(value) over (partition by country, case when h_split < 800 then 'train' else 'test' end) m from entities) group by country, split),
 t as (select country, max(r2) filter (split = 'train') train_r2, max(r2) filter (split = 'test') test_r2, max(rmse) filter (split = 'train') train_rmse,
   max(rmse) filter (split = 'test') test_rmse, max(mae) filter (split = 'test') test_mae from s group by country)"""


def scored(spark, folder):
    df = entities(spark, folder).withColumn("split", F.when(F.col("h_split") < 800, "train").otherwise("test"))
    return df.select("entity_id", "segment", "country", "split", "value", "predicted")


@query(
    "best_worst_segment",
    f"""with {SCORES} select arg_max(country, test_r2) best, round(max(test_r2), 6) + 0.0 best_score, arg_min(country, test_r2) worst, round(min(test_r2), 6) + 0.0 worst_score from t""",
)
def _(spark, folder):
    summary = metrics.segment_summary(scored(spark, folder), "country")
    df = profile.best_worst(summary, "country", "test_r2")
    return df.withColumns({"best_score": r("best_score", 6), "worst_score": r("worst_score", 6)})


@query(
    "across_segment_mean_std",
    f"""with {SCORES} select 'test_r2' as variable, round(avg(test_r2), 6) + 0.0 mean, round(stddev_pop(test_r2), 6) + 0.0 std, round(stddev_samp(test_r2), 6) + 0.0 std_sample from t
    union all select 'test_rmse', round(avg(test_rmse), 3) + 0.0, round(stddev_pop(test_rmse), 3) + 0.0, round(stddev_samp(test_rmse), 3) + 0.0 from t
    union all select 'test_mae', round(avg(test_mae), 3) + 0.0, round(stddev_pop(test_mae), 3) + 0.0, round(stddev_samp(test_mae), 3) + 0.0 from t""",
)
def _(spark, folder):
    summary = metrics.segment_summary(scored(spark, folder), "country")
    names = ["test_r2", "test_rmse", "test_mae"]
    sample = profile.across_segments(summary, names, ddof=1).select("variable", F.col("std").alias("std_sample"))
    df = profile.across_segments(summary, names).join(sample, "variable")

    def places(c):
        return F.when(F.col("variable") == "test_r2", r(c, 6)).otherwise(r(c, 3)).alias(c)

    return df.select("variable", places("mean"), places("std"), places("std_sample"))


@query("label_coverage", "select count(*) filter (o_orderkey % 4 <> 0) n_labelled, count(*) filter (o_orderkey % 4 = 0) n_unlabelled from orders")
def _(spark, folder):
    label = F.when(F.col("o_orderkey") % 8 == 0, -1).when(F.col("o_orderkey") % 4 == 0, None).otherwise(1)
    return profile.label_coverage(table(spark, folder, "orders").select(label.alias("label")))


@query(
    "target_profile",
    """select segment, count(*) n, round(min(value), 3) + 0.0 value_min, round(max(value), 3) + 0.0 value_max, round(avg(value), 3) + 0.0 value_mean, round(median(value), 3) + 0.0 value_median,
      min(f_acctbal) f_acctbal_min, max(f_acctbal) f_acctbal_max, round(avg(f_acctbal), 3) + 0.0 f_acctbal_mean, round(median(f_acctbal), 3) + 0.0 f_acctbal_median
      from entities group by segment""",
)
def _(spark, folder):
    df = profile.target_profile(entities(spark, folder), ["value", "f_acctbal"], ["segment"])
    names = [f"{c}_{m}" for c in ("value", "f_acctbal") for m in ("min", "max", "mean", "median")]
    return df.select("segment", "n", *[r(c, 3).alias(c) for c in names])


@query(
    "method_agreement",
    f"select count(*) filter (n % 4 = m % 4) n_agree, count(*) n from (select name, count(*) n, max(entity_id) m from ({PEOPLE}) group by name)",
)
def _(spark, folder):
    from worthline.operators.cluster_rules import method_agreement

    df = p(spark, folder).groupBy("name").agg((F.count("*") % 4).alias("k_elbow"), (F.max("entity_id") % 4).alias("k_silhouette"))
    return method_agreement(df)


@query(
    "quality_totals",
    f"""with f as (select name, count(*) filter (raw_value > 300000) good, count(*) filter (raw_value between 150000 and 300000) fair, count(*) filter (raw_value < 150000) poor, count(*) k
        from ({PEOPLE}) group by name),
      q as (select *, case when poor = 0 and good >= k // 2 then 'EXCELENTE' when poor <= k // 4 then 'BUENA' when poor <= k // 2 then 'REGULAR' else 'POBRE' end quality from f)
    select quality, count(*) n, sum(good)::bigint n_good, sum(fair)::bigint n_fair, sum(poor)::bigint n_poor, round(100.0 * count(*) / (select count(*) from q), 4) + 0.0 pct from q group by quality""",
)
def _(spark, folder):
    from worthline.operators.cluster_rules import quality_totals

    v = F.col("raw_value")
    df = p(spark, folder).groupBy("name").agg(
        F.count_if(v > 300000).alias("good"), F.count_if(v.between(150000, 300000)).alias("fair"), F.count_if(v < 150000).alias("poor"), F.count("*").alias("k")
    )
    return quality_totals(df).withColumn("pct", r("pct"))


# --- lookups -------------------------------------------------------------------------------------

CODES = """d as (select value, (row_number() over (order by value) - 1)::int code from (select distinct c_mktsegment as value from customer)),
 c as (select c_custkey, case when c_custkey % 10 = 0 then 99 else code end code from customer join d on c_mktsegment = value)"""


def coded_customers(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    dictionary = mapping.encode_dictionary(customers, ["c_mktsegment"])
    coded = mapping.label_encode(customers, dictionary, ["c_mktsegment"])
    return dictionary, coded.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.col("c_mktsegment")))


@query("decode_lookup", f"with {CODES} select c_custkey, value as c_mktsegment from c left join d using (code)")
def _(spark, folder):
    dictionary, coded = coded_customers(spark, folder)
    return mapping.label_decode(coded, dictionary, ["c_mktsegment"])


@query("unmapped_codes", f"with {CODES} select distinct code as c_mktsegment from c where code not in (select code from d)")
def _(spark, folder):
    dictionary, coded = coded_customers(spark, folder)
    return mapping.unmapped_codes(coded, dictionary, "c_mktsegment")


@query("decode_coverage", f"with {CODES} select 'c_mktsegment' as variable, count(code) n_before, count(value) n_after, round(100.0 * count(value) / count(code), 4) + 0.0 pct_decoded from c left join d using (code)")
def _(spark, folder):
    dictionary, coded = coded_customers(spark, folder)
    decoded = mapping.label_decode(coded, dictionary, ["c_mktsegment"])
    return mapping.decode_coverage(coded, decoded, ["c_mktsegment"]).withColumn("pct_decoded", r("pct_decoded"))


@query(
    "attach_labels_by_key",
    "select o_orderkey entity_id, o_totalprice, case when o_orderkey % 4 = 0 then null else (o_orderkey % 3)::int end label from orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("entity_id"), "o_totalprice")
    labels = orders.filter(F.col("entity_id") % 4 != 0).select("entity_id", (F.col("entity_id") % 3).cast("int").alias("label"))
    return mapping.attach_by_key(orders, labels, "entity_id")


@query(
    "recover_full_rows",
    f"""select entity_id, name, country, split from (select *, case when {key_hash_sql('entity_id', 42, 1000)} >= 200 then 'train' else 'test' end split from ({PEOPLE})) where split = 'test'""",
)
def _(spark, folder):
    df = p(spark, folder)
    part = with_split(df.select("entity_id"), "entity_id").filter("split = 'test'")
    return mapping.attach_by_key(df, part, "entity_id", "inner").select("entity_id", "name", "country", "split")


# --- windows over feature tables -----------------------------------------------------------------

IMPORTANCE = "imp as (" + " union all ".join(
    f"select country segment, '{c}' as variable, round(corr({c}, value), 6) + 0.0 coefficient from entities group by country" for c in FEATURES
) + """),
ranked as (select *, abs(coefficient) importance, row_number() over (partition by segment order by abs(coefficient) desc, variable)::int as rank from imp),
sel as (select *, variable = 'f_acctbal' as protected, row_number() over (partition by segment, variable = 'f_acctbal' order by rank)::int select_rank,
   variable = 'f_acctbal' or row_number() over (partition by segment, variable = 'f_acctbal' order by rank)
     <= greatest(1, floor(count(*) over (partition by segment, variable = 'f_acctbal') * 40 / 100)) as kept from ranked)"""


def importance(spark, folder):
    row = entities(spark, folder).groupBy("country").agg(*[correlation(c, "value").alias(f"{c}__coefficient") for c in FEATURES])
    long = row.select(F.col("country").alias("segment"), F.explode(profile.one_row_per(FEATURES, ["coefficient"])).alias("r"))
    return long.select("segment", "r.variable", r("r.coefficient", 6).alias("coefficient"))


def selected(spark, folder):
    return ranking.top_pct_select(ranking.rank_features(importance(spark, folder)), 40, ["f_acctbal"])


@query("rank_features", f"with {IMPORTANCE} select segment, variable, coefficient, importance, rank from ranked")
def _(spark, folder):
    return ranking.rank_features(importance(spark, folder))


@query("top_pct_select", f"with {IMPORTANCE} select segment, variable, protected, select_rank, kept from sel")
def _(spark, folder):
    return selected(spark, folder).select("segment", "variable", "protected", "select_rank", "kept")


@query("top_features_20", f"with {IMPORTANCE} select * from (select variable || '@' || segment as variable, importance, row_number() over (order by importance desc, variable || '@' || segment)::int as rank from ranked) where rank <= 20")
def _(spark, folder):
    df = importance(spark, folder).select(F.lit("all").alias("segment"), F.concat("variable", F.lit("@"), "segment").alias("variable"), "coefficient")
    return ranking.top_features(ranking.rank_features(df), 20).select("variable", "importance", "rank")


@query("membership_split", f"with {IMPORTANCE} select segment, variable, variable in ('f_qty', 'f_disc') as member from ranked")
def _(spark, folder):
    members = spark.createDataFrame([("f_qty",), ("f_disc",)], "variable string")
    inside, outside = ranking.membership_split(importance(spark, folder), members)
    both = inside.withColumn("member", F.lit(True)).unionByName(outside.withColumn("member", F.lit(False)))
    return both.select("segment", "variable", "member")


@query(
    "frequency_across_segments",
    f"""with {IMPORTANCE},
    k as (select segment, variable, protected, row_number() over (partition by segment order by protected desc, select_rank) as rk from sel where kept),
    x as (select segment, variable, row_number() over (partition by segment order by select_rank) as rk from sel where not kept)
    select * from (select 'top' side, variable, count(*) n from k where rk <= 5 and not protected group by variable order by n desc, variable limit 10)
    union all select * from (select 'bottom' side, variable, count(*) n from x where rk <= 5 group by variable order by n desc, variable limit 10)""",
)
def _(spark, folder):
    return ranking.frequency_across_segments(selected(spark, folder))


@query("mean_importance_across_segments", f"with {IMPORTANCE} select variable, round(avg(importance), 5) + 0.0 mean_importance, count(*) n_segments from ranked group by variable")
def _(spark, folder):
    return ranking.mean_importance(ranking.rank_features(importance(spark, folder))).withColumn("mean_importance", r("mean_importance", 5))


@query(
    "selection_reports",
    f"""with {IMPORTANCE}
    select 'kept' report, segment, variable, row_number() over (partition by segment order by protected desc, select_rank)::int as rank from sel where kept
    union all select 'eliminated', segment, variable, row_number() over (partition by segment order by select_rank)::int from sel where not kept
    union all select 'protected', segment, variable, null from sel where protected""",
)
def _(spark, folder):
    chosen = selected(spark, folder)
    kept = ranking.kept_report(chosen).select(F.lit("kept").alias("report"), "segment", "variable", "rank")
    gone = ranking.eliminated_report(chosen).select(F.lit("eliminated").alias("report"), "segment", "variable", F.col("elimination_rank").alias("rank"))
    safe = ranking.protected_report(chosen).select(F.lit("protected").alias("report"), "segment", "variable", F.lit(None).cast("int").alias("rank"))
    return kept.unionByName(gone).unionByName(safe)


@query(
    "cv_history_best",
    """with t as (select grp::bigint trial, case when not isnan(corr(f_qty, value)) then round(corr(f_qty, value), 6) + 0.0 end score from entities group by grp)
    select trial, score, max(score) over (order by trial) best from t""",
)
def _(spark, folder):
    trials = entities(spark, folder).groupBy(F.col("grp").alias("trial")).agg(r(correlation("f_qty", "value"), 6).alias("score"))
    return ranking.running_best(trials)


@query("residual_sequence", "select segment, row_number() over (partition by segment order by predicted, entity_id) place, round(value - predicted, 4) + 0.0 residual from entities")
def _(spark, folder):
    from worthline.operators.ordering import number_rows

    df = entities(spark, folder).select("entity_id", "segment", "predicted", (F.col("value") - F.col("predicted")).alias("residual"))
    return number_rows(df, ["predicted", "entity_id"], ["segment"], "place").select("segment", "place", r("residual").alias("residual"))


# --- statistics and metrics ----------------------------------------------------------------------

FILLED = "f as (select " + ", ".join(f"coalesce({c}, (select median({c}) from entities)) as {c}" for c in [*FEATURES, "raw_value"]) + ", predicted from entities)"


@query("pearson_vs_target", f"with {FILLED} " + rows_per_column([*FEATURES, "raw_value"], {"correlation": rounded("corr({c}, predicted)", 6), "correlation_abs": "abs(round(corr({c}, predicted), 6)) + 0.0"}, "f"))
def _(spark, folder):
    df = correlate.pearson_vs_target(entities(spark, folder), [*FEATURES, "raw_value"], "predicted")
    return df.select("variable", r("correlation", 6).alias("correlation"), r("correlation_abs", 6).alias("correlation_abs"))


@query("pearson_p_value")
def _(spark, folder):
    return correlate.pearson_vs_target(entities(spark, folder), [*FEATURES, "raw_value"], "predicted")


_MATRIX = [*FEATURES, "predicted"]


@query(
    "corr_matrix_top",
    f"with {FILLED} " + " union all ".join(
        f"select '{a}' || '~' || '{b}' pair, round(corr({a}, {b}), 6) + 0.0 as r from f" for i, a in enumerate(sorted(_MATRIX)) for b in sorted(_MATRIX)[:i]
    ),
)
def _(spark, folder):
    df = correlate.corr_matrix_top(entities(spark, folder), FEATURES, "predicted")
    pair = F.concat(F.greatest("row", "column"), F.lit("~"), F.least("row", "column"))
    return df.select(pair.alias("pair"), r("r", 6).alias("r"))


@query("trend_line", "select round(regr_slope(abs(value - predicted), value), 8) + 0.0 slope, round(regr_intercept(abs(value - predicted), value), 3) + 0.0 as intercept from entities")
def _(spark, folder):
    df = entities(spark, folder).select("value", F.abs(F.col("value") - F.col("predicted")).alias("err"))
    return correlate.trend_line(df, "value", "err").select(r("slope", 8).alias("slope"), r("intercept", 3).alias("intercept"))


@query("regression_metrics", f"with {SCORES} select country, split, n, round(r2, 6) + 0.0 r2, round(mae, 3) + 0.0 mae, round(mse, 0) + 0.0 mse, round(rmse, 3) + 0.0 rmse from s")
def _(spark, folder):
    df = metrics.regression_metrics(scored(spark, folder), ["country", "split"])
    return df.select("country", "split", "n", r("r2", 6).alias("r2"), r("mae", 3).alias("mae"), r("mse", 0).alias("mse"), r("rmse", 3).alias("rmse"))


MAPE = """m as (select country, split, avg(abs(value - predicted) / abs(value)) filter (abs(value) > 0.01 * lvl) * 100 mape from (
    select *, avg(abs(value)) over (partition by country, split) lvl from (select *, case when h_split < 800 then 'train' else 'test' end split from entities)) group by country, split)"""


@query("safe_mape", f"with {MAPE} select country, split, round(mape, 6) + 0.0 mape from m")
def _(spark, folder):
    return metrics.safe_mape(scored(spark, folder), ["country", "split"]).withColumn("mape", r("mape", 6))


@query(
    "overfit_ratio",
    f"""with {SCORES} select country, round(case when test_r2 > 0 then train_r2 / test_r2 else abs(train_r2 / test_r2) end, 6) + 0.0 r2_abs,
     round(case when test_r2 > 0 then train_r2 / test_r2 else 'inf'::double end, 6) + 0.0 r2, round(train_rmse / test_rmse, 6) + 0.0 rmse, round(test_r2 / train_r2, 6) + 0.0 r2_inverse from t""",
)
def _(spark, folder):
    df = metrics.segment_summary(scored(spark, folder), "country")
    pairs = {"r2_abs": "r2", "r2": "r2", "rmse": "rmse", "r2_inverse": "r2"}
    return df.select("country", *[r(metrics.overfit_ratio(f"train_{m}", f"test_{m}", mode), 6).alias(mode) for mode, m in pairs.items()])


@query(
    "residual_stats",
    """select segment, round(avg(value - predicted), 3) + 0.0 res_mean, round(stddev_pop(value - predicted), 3) + 0.0 res_std, round(min(value - predicted), 3) + 0.0 res_min,
     round(max(value - predicted), 3) + 0.0 res_max, round(avg(value), 3) + 0.0 real_mean, round(avg(predicted), 3) + 0.0 pred_mean from entities group by segment""",
)
def _(spark, folder):
    df = metrics.residual_stats(entities(spark, folder), ["segment"])
    return df.select("segment", *[r(c, 3).alias(c) for c in df.columns if c != "segment"])


@query(
    "within_pct_share",
    """select round(100.0 * count(*) filter (pct <= 20) / count(*), 4) + 0.0 within_20, round(100.0 * count(*) filter (pct <= 50) / count(*), 4) + 0.0 within_50,
     round(avg(pct), 4) + 0.0 mean_pct, round(median(pct), 4) + 0.0 median_pct from (select abs(value - predicted) / abs(value) * 100 pct from entities where value <> 0)""",
)
def _(spark, folder):
    df = metrics.within_pct_share(entities(spark, folder).select("value", (F.col("predicted")).alias("predicted")))
    return df.select(*[r(c).alias(c) for c in df.columns])


@query(
    "segment_summary",
    f"""with {SCORES}, {MAPE} select country, max(n) filter (split = 'train') train_n, max(n) filter (split = 'test') test_n,
      round(max(r2) filter (split = 'train'), 6) + 0.0 train_r2, round(max(r2) filter (split = 'test'), 6) + 0.0 test_r2, round(max(rmse) filter (split = 'test'), 3) + 0.0 test_rmse,
      round(max(mape) filter (split = 'test'), 5) + 0.0 test_mape, round(case when max(r2) filter (split = 'test') > 0 then max(r2) filter (split = 'train') / max(r2) filter (split = 'test') else abs(max(r2) filter (split = 'train') / max(r2) filter (split = 'test')) end, 6) + 0.0 overfit_ratio
      from s join m using (country, split) group by country""",
)
def _(spark, folder):
    df = metrics.segment_summary(scored(spark, folder), "country")
    return df.select("country", "train_n", "test_n", r("train_r2", 6).alias("train_r2"), r("test_r2", 6).alias("test_r2"), r("test_rmse", 3).alias("test_rmse"), r("test_mape", 5).alias("test_mape"), r("overfit_ratio", 6).alias("overfit_ratio"))


@query(
    "problem_segments",
    f"""with {SCORES}, o as (select country, case when test_r2 > 0 then train_r2 / test_r2 else abs(train_r2 / test_r2) end ratio from t)
    select country, round(ratio, 5) + 0.0 overfit_ratio, round((select avg(ratio) from o), 5) + 0.0 mean_ratio from o where ratio > 1.01""",
)
def _(spark, folder):
    df = metrics.problem_segments(metrics.segment_summary(scored(spark, folder), "country"), "country", limit=1.01)
    return df.select("country", r("overfit_ratio", 5).alias("overfit_ratio"), r("mean_ratio", 5).alias("mean_ratio"))


@query("score_coverage", "select count(*) filter (segment <> 'P') n_scored, count(*) n from entities")
def _(spark, folder):
    df = entities(spark, folder).select(F.when(F.col("segment") != "P", F.col("predicted")).alias("predicted"))
    return metrics.score_coverage(df)

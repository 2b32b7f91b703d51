"""Encoding, scaling, imputation and splitting."""

from pyspark.sql import functions as F

from worthline.catalog.registry import query, r
from worthline.catalog.shape_queries import PEOPLE, p
from worthline.operators import impute, mapping, profile, scale
from worthline.operators.assemble import assemble
from worthline.operators.split import key_hash_sql, with_folds, with_split, with_split_by
from worthline.plans.entities import FEATURES, entities, table

ENCODED = ["segment", "country", "sponsor", "name"]


@query(
    "encode_dictionary",
    "with d as ("
    + " union ".join(f"select '{c}' as variable, {c} as value from ({PEOPLE}) where {c} is not null" for c in ENCODED)
    + """) select variable, value, (row_number() over (partition by variable order by value) - 1)::int code,
      count(*) over (partition by variable) total from d""",
)
def _(spark, folder):
    return mapping.encode_dictionary(p(spark, folder), ENCODED)


@query(
    "label_encode",
    f"""with b as ({PEOPLE}), """
    + ", ".join(f"d_{c} as (select {c}, (row_number() over (order by {c}) - 1)::int code from (select distinct {c} from b where {c} is not null))" for c in ENCODED)
    + " select entity_id, " + ", ".join(f"d_{c}.code as {c}" for c in ENCODED) + " from b "
    + " ".join(f"left join d_{c} on b.{c} = d_{c}.{c}" for c in ENCODED),
)
def _(spark, folder):
    df = p(spark, folder).select("entity_id", *ENCODED)
    return mapping.label_encode(df, mapping.encode_dictionary(df, ENCODED), ENCODED)


@query("label_decode", f"select entity_id, segment, country, sponsor, name from ({PEOPLE})")
def _(spark, folder):
    df = p(spark, folder).select("entity_id", *ENCODED)
    dictionary = mapping.encode_dictionary(df, ENCODED)
    return mapping.label_decode(mapping.label_encode(df, dictionary, ENCODED), dictionary, ENCODED)


SCALED = [*FEATURES, "raw_value"]


def z(c, spread="stddev_pop"):
    return f"({c} - (select avg({c}) from entities)) / (select {spread}({c}) from entities)"


@query("standard_scale", "select entity_id, " + ", ".join(f"round({z(c)}, 5) + 0.0 as {c}" for c in SCALED) + " from entities")
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", *SCALED)
    out = scale.scale(df, scale.fit_scaler(df, SCALED))
    return out.select("entity_id", *[r(c, 5).alias(c) for c in SCALED])


@query("scale_check", " union all ".join(f"select '{c}' as variable, 0.0::double mean, 1.0::double std" for c in SCALED))
def _(spark, folder):
    df = entities(spark, folder).select(*SCALED)
    out = scale.moments(scale.scale(df, scale.fit_scaler(df, SCALED)), SCALED)
    return out.select("variable", r("mean", 6).alias("mean"), r("std", 6).alias("std"))


@query("unscale_with_params", "select entity_id, round(f_qty * 2.5 + 10, 4) + 0.0 f_qty, round(raw_value * 3.0 - 7, 4) + 0.0 raw_value from entities")
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", "f_qty", "raw_value")
    out = scale.unscale(df, {"f_qty": (10.0, 2.5), "raw_value": (-7.0, 3.0), "not_there": (0.0, 1.0)})
    return out.select("entity_id", r("f_qty").alias("f_qty"), r("raw_value").alias("raw_value"))


@query(
    "unscale_from_original",
    "select entity_id, " + ", ".join(f"round({z(c)} * (select stddev_samp({c}) from entities) + (select avg({c}) from entities), 5) + 0.0 as {c}" for c in SCALED) + " from entities",
)
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", *SCALED)
    scaled = scale.scale(df, scale.fit_scaler(df, SCALED))
    out = scale.unscale_from_original(scaled, df, SCALED, ddof=1)
    return out.select("entity_id", *[r(c, 5).alias(c) for c in SCALED])


@query(
    "unscale_check",
    " union all ".join(
        f"select 'before' stage, '{c}' as variable, 0.0::double mean, 1.0::double std union all select 'after', '{c}', round(avg({c}), 4) + 0.0, round(stddev_pop({c}), 4) + 0.0 from entities"
        for c in SCALED
    ),
)
def _(spark, folder):
    df = entities(spark, folder).select(*SCALED)
    scaled = scale.scale(df, scale.fit_scaler(df, SCALED))
    back = scale.unscale_from_original(scaled, df, SCALED)
    both = [scale.moments(t, SCALED).select(F.lit(stage).alias("stage"), "variable", r("mean").alias("mean"), r("std").alias("std")) for stage, t in (("before", scaled), ("after", back))]
    return both[0].unionByName(both[1])


TRAIN = "(select {f}(value) from entities where h_split < 800)"


@query("scale_target", f"select entity_id, round((value - {TRAIN.format(f='avg')}) / {TRAIN.format(f='stddev_pop')}, 6) + 0.0 as value from entities")
def _(spark, folder):
    df = entities(spark, folder)
    params = scale.fit_scaler(df, ["value"], where=F.col("h_split") < 800)
    return scale.scale(df, params).select("entity_id", r("value", 6).alias("value"))


@query("unscale_target", "select entity_id, round(value, 4) + 0.0 as value from entities")
def _(spark, folder):
    df = entities(spark, folder)
    params = scale.fit_scaler(df, ["value"], where=F.col("h_split") < 800)
    return scale.unscale(scale.scale(df, params), params).select("entity_id", r("value").alias("value"))


@query(
    "impute_median",
    """with m as (select segment, median(f_qty) f_qty, median(f_disc) f_disc, median(f_tax) f_tax from entities group by segment)
    select entity_id, coalesce(e.f_qty, m.f_qty) f_qty, round(coalesce(e.f_disc, m.f_disc), 6) + 0.0 f_disc, round(coalesce(e.f_tax, m.f_tax), 6) + 0.0 f_tax from entities e join m using (segment)""",
)
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", "segment", "f_qty", "f_disc", "f_tax")
    out = impute.impute_median(df, ["f_qty", "f_disc", "f_tax"], ["segment"])
    return out.select("entity_id", "f_qty", r("f_disc", 6).alias("f_disc"), r("f_tax", 6).alias("f_tax"))


@query(
    "impute_median_train",
    "select entity_id, coalesce(f_qty, (select median(f_qty) from entities where h_split < 800)) f_qty from entities",
)
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", "h_split", "f_qty")
    return impute.impute_median(df, ["f_qty"], where=F.col("h_split") < 800).select("entity_id", "f_qty")


@query(
    "impute_mode",
    f"""with c as (select country, sponsor, count(*) n from ({PEOPLE}) where sponsor is not null group by country, sponsor),
    m as (select country, first(sponsor order by n desc, sponsor) md from c group by country)
    select entity_id, coalesce(sponsor, md) sponsor from ({PEOPLE}) join m using (country)""",
)
def _(spark, folder):
    df = p(spark, folder).select("entity_id", "country", "sponsor")
    return impute.impute_mode(df, "sponsor", ["country"]).select("entity_id", "sponsor")


def split_sql(seed):
    return f"case when {key_hash_sql('entity_id', seed, 1000)} >= 200 then 'train' else 'test' end"


@query("train_test_split", f"select entity_id, {split_sql(42)} split from ({PEOPLE})")
def _(spark, folder):
    return with_split(p(spark, folder), "entity_id").select("entity_id", "split")


@query(
    "train_test_split_small",
    f"""with n as (select name, round(least(0.25, greatest(0.1, 5.0 / count(*))) * 1000) cut from entities group by name)
    select entity_id, case when {key_hash_sql('entity_id', 42, 1000)} >= cut then 'train' else 'test' end split from entities join n using (name)""",
)
def _(spark, folder):
    return with_split_by(p(spark, folder).select("entity_id", "name"), "entity_id", ["name"]).select("entity_id", "split")


@query("tag_split", f"select entity_id, name, {split_sql(42)} conjunto from ({PEOPLE})")
def _(spark, folder):
    return with_split(p(spark, folder), "entity_id", name="conjunto").select("entity_id", "name", "conjunto")


@query(
    "shuffle_split_cv",
    " union all ".join(f"select entity_id, {i} as fold, {split_sql(43 + i)} part from ({PEOPLE})" for i in range(5)),
)
def _(spark, folder):
    return with_folds(p(spark, folder).select("entity_id"), "entity_id").select("entity_id", "fold", "part")


@query(
    "assemble_features",
    "select entity_id, 3 length, round(f_qty + f_disc + f_acctbal, 6) + 0.0 total from entities where f_qty is not null",
)
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = entities(spark, folder).filter("f_qty is not null")
    out = assemble(df, ["f_qty", "f_disc", "f_acctbal"]).withColumn("a", vector_to_array("features"))
    total = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    return out.select("entity_id", F.size("a").alias("length"), r(total, 6).alias("total"))


@query("pca_2d")
def _(spark, folder):
    from worthline.operators.assemble import pca_2d

    df = entities(spark, folder).select("entity_id", "segment", "f_qty", "f_acctbal", "value").na.drop()
    columns = ["f_qty", "f_acctbal", "value"]
    points, _ = pca_2d(scale.scale(df, scale.fit_scaler(df, columns)), columns)
    return points.select("entity_id", "segment", "pc1", "pc2")


@query(
    "denormalise_lookup",
    """with c as (select c_custkey, (c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer) as scaled from customer)
    select c_custkey, round(scaled * (select stddev_samp(s_acctbal) from supplier) + (select avg(s_acctbal) from supplier), 4) + 0.0 as balance from c""",
)
def _(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"))
    scaled = scale.scale(customers, scale.fit_scaler(customers, ["balance"]))
    out = scale.unscale_from_original(scaled, suppliers, ["balance"], ddof=1)
    return out.select("c_custkey", r("balance").alias("balance"))

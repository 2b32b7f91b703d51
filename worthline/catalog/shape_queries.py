"""Columns, filters, search, order, set operations and scalar functions."""

from pyspark.sql import functions as F

from worthline.catalog.io_queries import SEGMENT_NAMES
from worthline.catalog.registry import query, r
from worthline.functions import scalars
from worthline.operators import columns, filters, mapping, search
from worthline.operators.ordering import number_rows
from worthline.operators.split import key_hash_sql, with_split
from worthline.plans.entities import FEATURES, entities, people, table

PEOPLE = """select o_orderkey entity_id, c_name as name, o_orderstatus segment, o_custkey % 113 grp, n_name country,
 case when o_orderkey % 8 < 5 then null else c_mktsegment end sponsor, c_acctbal f_acctbal, o_totalprice raw_value
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
VALUES = ["entity_id", "name", "segment", "grp", "country", "sponsor", "f_acctbal", "raw_value"]


def p(spark, folder):
    return people(spark, folder).select(*VALUES)


# --- columns -------------------------------------------------------------------------------------


@query("drop_columns_tolerant", f"select entity_id, name, segment, grp, raw_value from ({PEOPLE})")
def _(spark, folder):
    return columns.drop_columns(p(spark, folder), ["country", "sponsor", "f_acctbal", "not_there"])


@query("reorder_columns", f"select raw_value, segment, entity_id, name, grp, country, sponsor, f_acctbal from ({PEOPLE})")
def _(spark, folder):
    return columns.reorder_columns(p(spark, folder), ["raw_value", "segment", "not_there"])


@query(
    "column_presence_report",
    """select * from (values ('o_orderkey', 'existing'), ('o_totalprice', 'existing'), ('height', 'missing'), ('o_custkey', 'extra'),
    ('o_orderstatus', 'extra'), ('o_orderdate', 'extra'), ('o_orderpriority', 'extra')) t(name, status)""",
)
def _(spark, folder):
    return columns.column_presence_report(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice", "height"])


@query(
    "shape_report",
    f"""select 'in' stage, count(*) n_rows, 8 n_columns from ({PEOPLE}) union all
    select 'out', count(*), 7 from ({PEOPLE}) where sponsor is not null""",
)
def _(spark, folder):
    df = p(spark, folder)
    return columns.shape_report({"in": df, "out": df.drop("name").filter("sponsor is not null")})


@query("feature_columns_by_exclusion", f"select segment, grp, f_acctbal from ({PEOPLE})")
def _(spark, folder):
    df = p(spark, folder)
    return df.select(*columns.feature_columns(df, ["NAME", "value", "country", "spons", "entity"]))


@query("drop_exact_exclusions", f"select entity_id, segment, grp, country, f_acctbal, raw_value from ({PEOPLE})")
def _(spark, folder):
    return columns.drop_exact(p(spark, folder), ["name", "sponsor", "val"])


@query("numeric_columns_only", f"select entity_id, grp, f_acctbal, raw_value from ({PEOPLE})")
def _(spark, folder):
    return columns.numeric_only(p(spark, folder))


@query(
    "segment_label_default",
    """select o_orderkey entity_id, case when o_orderkey % 4 = 0 then -1 else (o_orderkey % 3)::int end label from orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("entity_id"))
    labels = orders.filter(F.col("entity_id") % 4 != 0).withColumn("label", (F.col("entity_id") % 3).cast("int"))
    return mapping.label_or_default(orders, labels, "entity_id")


@query(
    "project_kept_features",
    "select entity_id, name, segment, round(f_acctbal, 4) + 0.0 f_acctbal, round(f_qty, 4) + 0.0 f_qty, round(f_disc, 6) + 0.0 f_disc, round(value, 4) + 0.0 as value from entities",
)
def _(spark, folder):
    df = entities(spark, folder).select("entity_id", "name", "segment", *FEATURES, "value")
    kept = columns.kept_features(df, FEATURES, ["f_acctbal"], ["f_qty", "f_disc"], "value")
    return kept.select("entity_id", "name", "segment", *[r(c, 6 if c == "f_disc" else 4).alias(c) for c in ("f_acctbal", "f_qty", "f_disc", "value")])


@query(
    "segment_name_map",
    """select o_orderkey, case o_orderkey % 6 when 0 then 'Centrocampista' when 1 then 'Defensa' when 2 then 'Delantero'
      when 3 then 'Portero' else 'Posición_' || (o_orderkey % 6) end segment_name from orders""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").withColumn("code", (F.col("o_orderkey") % 6).cast("int"))
    return df.select("o_orderkey", columns.segment_name("code", SEGMENT_NAMES).alias("segment_name"))


RADAR = {"F": {"Quantity": "f_qty", "Balance": "f_acctbal"}, "O": {"Discount": "f_disc", "Tax": "f_tax", "Lines": "f_lines"}}
RADAR_DEFAULT = {"Quantity": "f_qty", "Lines": "f_lines", "Balance": "f_acctbal"}


@query(
    "radar_vector",
    """with a as (select entity_id, unnest(case when segment = 'F' then ['Quantity', 'Balance'] when segment = 'O' then ['Discount', 'Tax', 'Lines']
        else ['Quantity', 'Lines', 'Balance'] end) attribute,
      unnest(case when segment = 'F' then [coalesce(f_qty, 0), coalesce(f_acctbal, 0)]
        when segment = 'O' then [coalesce(f_disc, 0), coalesce(f_tax, 0), coalesce(f_lines, 0)::double]
        else [coalesce(f_qty, 0), coalesce(f_lines, 0)::double, coalesce(f_acctbal, 0)] end) as v from entities)
    select entity_id, attribute, round(v, 6) + 0.0 as v, round(greatest(max(v) over (partition by entity_id), 100.0), 4) + 0.0 as scale from a""",
)
def _(spark, folder):
    df = entities(spark, folder).withColumn("radar", columns.radar_vector("segment", RADAR, RADAR_DEFAULT))
    df = df.withColumn("scale", columns.radar_scale("radar"))
    return df.select("entity_id", "scale", F.explode("radar").alias("attribute", "v")).withColumns({"v": r("v", 6), "scale": r("scale")})


@query(
    "detail_card",
    f"""with a as (select entity_id, unnest(case when segment = 'P' then ['Name', 'Sponsor', 'Group'] else ['Name', 'Sponsor', 'Country'] end) as label,
      unnest(case when segment = 'P' then [name, sponsor, grp::varchar] else [name, sponsor, country] end) as v from ({PEOPLE}))
    select entity_id, label, v as value from a where v is not null and v <> ''""",
)
def _(spark, folder):
    base = {"Name": F.col("name"), "Sponsor": F.col("sponsor")}
    card = columns.detail_card("segment", {"p": {**base, "Group": F.col("grp")}}, {**base, "Country": F.col("country")})
    return p(spark, folder).select("entity_id", F.explode(card).alias("c")).select("entity_id", "c.*")


# --- filters -------------------------------------------------------------------------------------


@query("filter_segment", f"select entity_id, segment from ({PEOPLE}) where segment = 'F'")
def _(spark, folder):
    return filters.filter_segment(p(spark, folder), "segment", "F").select("entity_id", "segment")


@query("filter_target_not_null", f"select entity_id, sponsor from ({PEOPLE}) where sponsor is not null")
def _(spark, folder):
    return filters.filter_not_null(p(spark, folder), "sponsor").select("entity_id", "sponsor")


@query("drop_any_null", "select entity_id, sponsor, f_qty from entities where sponsor is not null and f_qty is not null")
def _(spark, folder):
    return filters.drop_any_null(entities(spark, folder).select("entity_id", "sponsor", "f_qty"))


@query("filter_non_empty", f"select entity_id, s from (select entity_id, case when grp % 5 = 0 then '' else sponsor end s from ({PEOPLE})) where s is not null and s <> ''")
def _(spark, folder):
    df = p(spark, folder).select("entity_id", F.when(F.col("grp") % 5 == 0, "").otherwise(F.col("sponsor")).alias("s"))
    return filters.filter_non_empty(df, "s")


@query(
    "min_sample_guard",
    f"""with s as (select *, case when {key_hash_sql('entity_id', 42, 1000)} >= 200 then 'train' else 'test' end split from ({PEOPLE})),
    g as (select name from s group by name having count(*) >= 10 and count(*) filter (split = 'test') >= 2)
    select entity_id, name from s where name in (select name from g)""",
)
def _(spark, folder):
    df = with_split(p(spark, folder), "entity_id")
    return filters.min_sample_guard(df, "name", 10, 2, "split").select("entity_id", "name")


@query("valid_cluster_only", "select o_orderkey, (o_orderkey % 5 - 1)::int as label from orders where o_orderkey % 5 >= 1")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 - 1).cast("int").alias("label"))
    return filters.assigned_only(df)


@query(
    "filter_value_ranges",
    "select entity_id from entities where coalesce(value, 0) between 150000 and 400000 and coalesce(predicted, 0) between 100000 and 350000",
)
def _(spark, folder):
    keep = search.in_value_ranges({"value": (0.15, 0.4), "predicted": (0.1, 0.35)})
    return entities(spark, folder).filter(keep).select("entity_id")


@query("filter_in_set", f"select entity_id, segment from ({PEOPLE}) where segment in ('F', 'P')")
def _(spark, folder):
    df = p(spark, folder)
    return df.filter(search.in_set("segment", ["F", "P"]) & search.in_set("country", [])).select("entity_id", "segment")


@query(
    "filter_text_any_column",
    f"select entity_id from ({PEOPLE}) where lower(name) like '%auto%' or lower(country) like '%auto%' or coalesce(lower(sponsor), '') like '%auto%'",
)
def _(spark, folder):
    return p(spark, folder).filter(search.any_column_contains(["name", "country", "sponsor"], " Auto ")).select("entity_id")


@query("filter_numeric_expr", f"select entity_id, raw_value from ({PEOPLE}) where raw_value >= 250000")
def _(spark, folder):
    df = p(spark, folder)
    return df.filter(search.numeric_condition(df, "valor >= 250000", {"valor": "raw_value"})).select("entity_id", "raw_value")


CASCADE = f"""with l as (select *, case when lower(name) like '%{{q}}%' then 1 when lower(country) like '%{{q}}%' then 2
  when lower(segment) like '%{{q}}%' then 3 {{last}} end match_level from ({PEOPLE}))
select entity_id, match_level from l where match_level = (select min(match_level) from l)"""


@query("search_cascade", CASCADE.format(q="nation_1", last=""))
def _(spark, folder):
    return search.search_cascade(p(spark, folder), "Nation_1", ["name", "country", "segment"]).select("entity_id", "match_level")


@query("search_cascade_numeric", CASCADE.format(q="f_acctbal > 9000", last="when f_acctbal > 9000 then 4"))
def _(spark, folder):
    df = search.search_cascade(p(spark, folder), "F_AcctBal > 9000", ["name", "country", "segment"])
    return df.select("entity_id", "match_level")


@query(
    "ranges_for_filters",
    """select distinct segment, (select ceil(greatest(max(value), max(predicted), 0.2 * 100000) / 100000)::bigint from entities) slider_max from entities""",
)
def _(spark, folder):
    return search.filter_ranges(entities(spark, folder), ["value", "predicted"], "segment", unit=100_000, floor=0.2)


# --- order and limit -----------------------------------------------------------------------------

# Phrases of the search page.
MOST_VALUABLE, LEAST_VALUABLE = "top 25 más valiosos", "menos valiosos"


@query("top_n_value", f"select entity_id, f_acctbal from ({PEOPLE}) where f_acctbal > 0 order by f_acctbal desc, entity_id limit 25")
def _(spark, folder):
    return search.top_n_value(p(spark, folder), "f_acctbal", MOST_VALUABLE, "entity_id").select("entity_id", "f_acctbal")


@query("bottom_n_value", f"select entity_id, f_acctbal from ({PEOPLE}) where f_acctbal > 0 order by f_acctbal, entity_id limit 10")
def _(spark, folder):
    return search.top_n_value(p(spark, folder), "f_acctbal", LEAST_VALUABLE, "entity_id", ascending=True).select("entity_id", "f_acctbal")


@query("sort_typed", f"select entity_id, sponsor from ({PEOPLE}) order by lower(coalesce(sponsor, '')), entity_id")
def _(spark, folder):
    return search.sort_typed(p(spark, folder), "sponsor", "entity_id").select("entity_id", "sponsor")


@query(
    "sort_typed_text",
    f"""select entity_id, place from (
      select entity_id, row_number() over (order by try_cast(v as double) desc, entity_id) place from (select entity_id, cast(floor(raw_value)::bigint as varchar) v from ({PEOPLE})))""",
)
def _(spark, folder):
    """Numbers held as text: the place of every row."""
    df = p(spark, folder).select("entity_id", F.floor("raw_value").cast("bigint").cast("string").alias("v"))
    return number_rows(df, [search.typed_value(df, "v").desc(), "entity_id"], name="place").select("entity_id", "place")


@query("sort_preset", f"select entity_id, raw_value from ({PEOPLE}) order by raw_value desc, entity_id")
def _(spark, folder):
    return search.sort_preset(p(spark, folder), "value", {"value": "raw_value"}, "entity_id").select("entity_id", "raw_value")


@query(
    "limit_then_sort",
    f"select entity_id, raw_value from (select * from ({PEOPLE}) order by entity_id limit 250) order by raw_value desc, entity_id",
)
def _(spark, folder):
    df = search.limit_then_sort(p(spark, folder), 250, "entity_id", [F.desc("raw_value"), F.asc("entity_id")])
    return df.select("entity_id", "raw_value")


# --- set operations ------------------------------------------------------------------------------


@query(
    "union_train_test",
    f"""select entity_id, case when {key_hash_sql('entity_id', 42, 1000)} >= 200 then 'train' else 'test' end split from ({PEOPLE})""",
)
def _(spark, folder):
    df = with_split(p(spark, folder).select("entity_id"), "entity_id")
    return df.filter("split = 'train'").unionByName(df.filter("split = 'test'"))


@query(
    "union_segment_reports",
    f"""select segment, country, count(*) n, round(avg(raw_value), 4) + 0.0 mean_value from ({PEOPLE}) group by segment, country""",
)
def _(spark, folder):
    groups = p(spark, folder).groupBy("segment", "country")
    return groups.agg(F.count("*").alias("n"), r(F.avg("raw_value")).alias("mean_value"))


@query(
    "set_difference_values",
    "select distinct o_custkey as k from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return mapping.values_not_in(orders, orders.filter("o_orderstatus = 'P'"), "k")


# --- scalar functions ----------------------------------------------------------------------------

TEXT = f"""select entity_id, case entity_id % 5 when 0 then null when 1 then '' when 2 then '   ' when 3 then 'NaN' else name end t from ({PEOPLE})"""


@query("blank_to_null_literal", f"select entity_id, case when t is null or trim(t) = '' or t = 'NaN' then 'NULL' else t end t from ({TEXT})")
def _(spark, folder):
    k = F.col("entity_id") % 5
    t = F.when(k == 0, None).when(k == 1, "").when(k == 2, "   ").when(k == 3, "NaN").otherwise(F.col("name"))
    return p(spark, folder).select("entity_id", scalars.blank_to_literal(t).alias("t"))


@query("inf_to_null", f"select entity_id, case when entity_id % 4 < 3 then null else raw_value end as v from ({PEOPLE})")
def _(spark, folder):
    k = F.col("entity_id") % 4
    inf = float("inf")
    v = F.when(k == 0, F.lit(inf)).when(k == 1, F.lit(-inf)).when(k == 2, F.lit(float("nan"))).otherwise(F.col("raw_value"))
    return p(spark, folder).select("entity_id", scalars.inf_to_null(v).alias("v"))


@query("to_number", f"select entity_id, try_cast(case when entity_id % 3 = 0 then name else raw_value::varchar end as double) as v from ({PEOPLE})")
def _(spark, folder):
    text = F.when(F.col("entity_id") % 3 == 0, F.col("name")).otherwise(F.col("raw_value").cast("string"))
    return p(spark, folder).select("entity_id", scalars.to_number(text).alias("v"))


COMMA = f"select entity_id, case when entity_id % 4 = 0 then name else (entity_id % 1000)::varchar || ',' || (entity_id % 10)::varchar end t from ({PEOPLE})"


@query("parse_decimal_comma", f"select entity_id, round(try_cast(replace(t, ',', '.') as double), 2) + 0.0 as v from ({COMMA})")
def _(spark, folder):
    text = F.concat((F.col("entity_id") % 1000).cast("string"), F.lit(","), (F.col("entity_id") % 10).cast("string"))
    text = F.when(F.col("entity_id") % 4 == 0, F.col("name")).otherwise(text)
    return p(spark, folder).select("entity_id", scalars.parse_decimal_comma(text).alias("v"))


@query("round_two", f"select entity_id, round_even(round(raw_value * 1.01::double / 7, 9), 2) + 0.0 as v from ({PEOPLE})")
def _(spark, folder):
    return p(spark, folder).select("entity_id", scalars.rounded(F.col("raw_value") * 1.01 / 7).alias("v"))


TITLE = f"""select entity_id, case entity_id % 4 when 0 then lower(coalesce(sponsor, 'la-palma')) || '-de--' || upper(segment) when 1 then '12-3,4.5'
  when 2 then '  ' || lower(country) || ' x' else upper(name) end t from ({PEOPLE})"""


@query(
    "title_case_hyphen",
    f"""select entity_id, case when regexp_matches(regexp_replace(t, '[.,-]', '', 'g'), '^[0-9]+$') then t
     else array_to_string(list_transform(string_split(trim(regexp_replace(replace(t, '-', ' '), '\\s+', ' ', 'g')), ' '),
       lambda w: upper(w[1:1]) || lower(w[2:])), ' ') end t from ({TITLE})""",
)
def _(spark, folder):
    k = F.col("entity_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lower(F.coalesce("sponsor", F.lit("la-palma"))), F.lit("-de--"), F.upper("segment")))
        .when(k == 1, "12-3,4.5")
        .when(k == 2, F.concat(F.lit("  "), F.lower("country"), F.lit(" x")))
        .otherwise(F.upper("name"))
    )
    return p(spark, folder).select("entity_id", scalars.title_case(text).alias("t"))


@query("capitalise_from_filename", f"select entity_id, upper(segment) || lower(country) as n from ({PEOPLE})")
def _(spark, folder):
    path = F.concat(F.lit("/data/07_db_"), F.lower("segment"), F.upper("country"), F.lit(".csv"))
    return p(spark, folder).select("entity_id", scalars.name_from_file(path, "07_db_").alias("n"))


MONEY = f"select entity_id, case entity_id % 5 when 0 then null when 1 then 0.0::double when 2 then raw_value * 17 when 3 then f_acctbal else raw_value end m from ({PEOPLE})"


@query(
    "format_currency",
    f"""select entity_id, case when m is null or m = 0 then 'No valorado'
      when m >= 1000000 then '€' || (floor(floor(m / 100000 + 0.5) / 10)::bigint)::varchar || '.' || (floor(m / 100000 + 0.5)::bigint % 10)::varchar || 'M'
      when m >= 1000 then '€' || (floor(m / 1000 + 0.5)::bigint)::varchar || 'K'
      else '€' || regexp_replace(regexp_replace(format('{{:.3f}}', m), '0+$', ''), '\\.$', '') end t from ({MONEY})""",
)
def _(spark, folder):
    k = F.col("entity_id") % 5
    m = F.when(k == 0, None).when(k == 1, F.lit(0.0)).when(k == 2, F.col("raw_value") * 17).when(k == 3, F.col("f_acctbal")).otherwise(F.col("raw_value"))
    return p(spark, folder).select("entity_id", scalars.format_currency(m).alias("t"))


@query(
    "format_percent",
    f"""select entity_id, regexp_replace(regexp_replace(format('{{:.3f}}', round(coalesce(x, 0), 3)), '0+$', ''), '\\.$', '') || '%' t
    from (select entity_id, case when entity_id % 3 = 0 then null else (entity_id % 4001 - 2000) / 16.0::double end x from ({PEOPLE}))""",
)
def _(spark, folder):
    x = F.when(F.col("entity_id") % 3 != 0, (F.col("entity_id") % 4001 - 2000) / F.lit(16.0))
    return p(spark, folder).select("entity_id", scalars.format_percent(x).alias("t"))


@query(
    "truncate_text",
    "select doc_id, case when length(text) > 25 then substring(text, 1, 25) || '...' else coalesce(text, '') end t from documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", scalars.truncate_text("text", 25).alias("t"))


@query("direction_class", "select entity_id, case when predicted > value then 'higher' when predicted < value then 'lower' else 'neutral' end c from entities")
def _(spark, folder):
    return entities(spark, folder).select("entity_id", scalars.direction_class("predicted", "value").alias("c"))


@query("default_text", f"select entity_id, coalesce(sponsor, 'N/A') s from ({PEOPLE})")
def _(spark, folder):
    return p(spark, folder).select("entity_id", scalars.default_text("sponsor").alias("s"))


@query("lower_contains", "select doc_id, contains(lower(text), 'the') hit from documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", scalars.lower_contains("text", "THE").alias("hit"))


@query("extract_number", f"select entity_id, try_cast(regexp_extract(case when entity_id % 3 = 0 then 'none' else name || ' 7' end, '[0-9]+') as bigint) as n from ({PEOPLE})")
def _(spark, folder):
    text = F.when(F.col("entity_id") % 3 == 0, "none").otherwise(F.concat("name", F.lit(" 7")))
    return p(spark, folder).select("entity_id", scalars.extract_number(text).alias("n"))


@query(
    "quality_band",
    f"""select entity_id, case when s >= 0.7 then 'EXCELENTE' when s >= 0.5 then 'BUENA' when s >= 0.25 then 'REGULAR' else 'POBRE' end quality,
     case when s >= 0.5 then 'BUENA' when s >= 0.25 then 'REGULAR' else 'POBRE' end cluster_quality
     from (select entity_id, (entity_id % 200 - 100) / 100.0::double s from ({PEOPLE}))""",
)
def _(spark, folder):
    s = (F.col("entity_id") % 200 - 100) / F.lit(100.0)
    return p(spark, folder).select("entity_id", scalars.quality_band(s).alias("quality"), scalars.cluster_band(s).alias("cluster_quality"))


@query(
    "overfit_band",
    f"""select entity_id, case when v > 3 then 'severe' when v > 2 then 'moderate' else 'acceptable' end band
     from (select entity_id, (entity_id % 50) / 10.0::double as v from ({PEOPLE}))""",
)
def _(spark, folder):
    return p(spark, folder).select("entity_id", scalars.overfit_band((F.col("entity_id") % 50) / F.lit(10.0)).alias("band"))


@query(
    "recommendation_band",
    f"""select entity_id, case when x < 0.5 then 'low' when x > 0.8 then 'excellent' else 'acceptable' end fit,
      case when x * 3 > 2 then 'regularise' else 'low overfit' end overfit,
      case when x * 30 < 10 then 'very low' when x * 30 < 20 then 'acceptable' else 'high' end error
     from (select entity_id, (entity_id % 100) / 100.0::double x from ({PEOPLE}))""",
)
def _(spark, folder):
    x = (F.col("entity_id") % 100) / F.lit(100.0)
    return p(spark, folder).select(
        "entity_id",
        scalars.fit_recommendation(x).alias("fit"),
        scalars.overfit_recommendation(x * 3).alias("overfit"),
        scalars.mape_recommendation(x * 30).alias("error"),
    )

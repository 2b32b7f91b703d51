"""Sources and sinks: every query writes tables derived from the inputs and reads them back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from worthline.catalog.registry import query
from worthline.operators.mapping import encode_dictionary
from worthline.plans.entities import people, table
from worthline.session import fresh_path
from worthline.sources import readers, writers


@query("scan_csv", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = fresh_path(spark, "scan_csv")
    writers.write_csv(df, path, sep=";")
    return readers.read_csv(spark, path, df.schema, sep=";")


@query(
    "scan_csv_null_tokens",
    """select o_orderkey id, case when o_orderkey % 7 < 6 then null else o_totalprice end price,
    case when o_orderkey % 5 = 0 then null else o_orderpriority end priority from orders""",
)
def _(spark, folder):
    id7 = F.col("o_orderkey") % 7
    df = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(id7 == 0, " ").when(id7 == 1, "null").when(id7 == 2, "NULL").when(id7 == 3, "nan").when(id7 == 4, "NaN")
        .when(id7 == 5, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "NULL").otherwise(F.col("o_orderpriority")).alias("priority"),
    )
    path = fresh_path(spark, "null_tokens")
    writers.write_csv(df, path)
    schema = StructType.fromDDL("id bigint, price double, priority string")
    return readers.read_csv_null_tokens(spark, path, schema)


@query(
    "scan_folder_union",
    """select o_orderkey, o_totalprice, o_orderstatus, null::varchar o_orderpriority from orders where o_orderkey % 3 = 0
    union all select o_orderkey, o_totalprice, null, o_orderpriority from orders where o_orderkey % 3 = 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    path = fresh_path(spark, "folder_union")
    third = F.col("o_orderkey") % 3
    writers.write_csv(orders.filter(third == 0).select("o_orderkey", "o_totalprice", "o_orderstatus"), f"{path}/a.csv")
    writers.write_csv(orders.filter(third == 1).select("o_orderkey", "o_totalprice", "o_orderpriority"), f"{path}/b.csv")
    writers.write_csv(orders.filter(third == 2).select("o_orderkey", "o_orderpriority"), f"{path}/c.csv")
    types = {"o_orderkey": "bigint", "o_totalprice": "double"}
    return readers.read_folder_union(spark, path, ["o_orderkey", "o_totalprice"], types=types)


@query("scan_folder_exclude", "select o_orderkey, o_totalprice from orders where o_orderkey % 3 <> 2")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    path = fresh_path(spark, "folder_exclude")
    for i, name in enumerate(["first.csv", "second.csv", "left_out.csv"]):
        writers.write_csv(df.filter(F.col("o_orderkey") % 3 == i), f"{path}/{name}")
    return readers.read_folder_excluding(spark, path, df.schema, ["left_out.csv"])


@query("scan_text_name_filter", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderkey % 11 <> 0")
def _(spark, folder):
    name = F.when(F.col("entity_id") % 22 == 0, "  ").when(F.col("entity_id") % 11 == 0, None).otherwise(F.col("name"))
    df = people(spark, folder).select(F.col("entity_id").alias("o_orderkey"), name.alias("c_name"))
    path = fresh_path(spark, "named_rows")
    writers.write_csv(df, path)
    return readers.read_named_rows(spark, path, df.schema, "c_name")


DICTIONARY = """with d as (select distinct 'c_mktsegment' variable, c_mktsegment as value from customer
  union all select distinct 'c_name', c_name from customer)
select variable, value, (row_number() over (partition by variable order by value) - 1)::int code,
  count(*) over (partition by variable) total from d"""


@query("scan_json_dict", DICTIONARY)
def _(spark, folder):
    path = fresh_path(spark, "dictionary")
    writers.write_dictionary(encode_dictionary(table(spark, folder, "customer"), ["c_mktsegment", "c_name"]), path)
    return readers.read_dictionary(spark, path)


@query(
    "sink_json_dict",
    """with d as (select distinct o_orderpriority as value from orders)
    select 'o_orderpriority' variable, value, (row_number() over (order by value) - 1)::int code, count(*) over () total from d""",
)
def _(spark, folder):
    path = fresh_path(spark, "dictionary")
    writers.write_dictionary(encode_dictionary(table(spark, folder, "orders"), ["o_orderpriority"]), path)
    return readers.read_dictionary(spark, path)


@query("sink_csv", "select c_custkey, c_name, c_acctbal from customer")
def _(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = fresh_path(spark, "sink_csv")
    writers.write_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@query(
    "sink_csv_null_literal",
    """select o_orderkey entity_id, coalesce(case when o_orderkey % 8 < 5 then null else c_mktsegment end, 'NULL') sponsor
    from orders join customer on o_custkey = c_custkey""",
)
def _(spark, folder):
    path = fresh_path(spark, "null_literal")
    writers.write_csv_null_literal(people(spark, folder).select("entity_id", "sponsor"), path)
    return readers.read_csv(spark, path, "entity_id bigint, sponsor string")


# Codes and names of the four segments.
SEGMENT_NAMES = {0: "Centrocampista", 1: "Defensa", 2: "Delantero", 3: "Portero"}


@query(
    "sink_partition_by_segment",
    """select o_orderkey, o_totalprice, case o_orderkey % 6 when 0 then 'Centrocampista' when 1 then 'Defensa' when 2 then 'Delantero'
      when 3 then 'Portero' else 'Posición_' || (o_orderkey % 6) end segment_name from orders""",
)
def _(spark, folder):
    path = fresh_path(spark, "by_segment")
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 6).cast("int").alias("code"))
    writers.write_by_segment(df, path, "code", SEGMENT_NAMES)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "segment_name")

"""The scored entity table that the registered queries analyse, derived from the star-schema tables.

One row per order: identity and grouping columns, four line statistics (null where the order has no
lines), a target with known coefficients and a prediction that deviates from it by up to 50 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthline.operators.split import MODULUS, MULTIPLIER, SEED_STEP

FEATURES = ["f_qty", "f_disc", "f_tax", "f_lines", "f_acctbal"]

ENTITIES_SQL = """
li as (
  select l_orderkey k, sum(l_quantity) f_qty, avg(l_discount) f_disc, avg(l_tax) f_tax, count(*) f_lines
  from lineitem group by l_orderkey),
e as (
  select o_orderkey entity_id, c_name name, o_orderstatus segment, o_custkey % 113 grp, n_name country,
         case when o_orderkey % 8 < 5 then null else c_mktsegment end sponsor,
         f_qty, f_disc, f_tax, f_lines, c_acctbal f_acctbal, o_totalprice raw_value,
         ((o_orderkey % 2147483647) * 48271 + 7 * 69621) % 2147483647 % 1000 h_split,
         ((o_orderkey % 2147483647) * 48271 + 9 * 69621) % 2147483647 % 20001 - 10000 noise
  from orders join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey left join li on k = o_orderkey),
v as (
  select *, case when entity_id % 500 = 0 then 0.0
                 else 100000 + 2000 * coalesce(f_qty, 0) + 300000 * coalesce(f_disc, 0)
                      - 150000 * coalesce(f_tax, 0) + 5 * f_acctbal + noise end as value
  from e),
entities as (
  select *, value * (1 + ((entity_id * 7919) % 101 - 50) / 100.0) predicted from v)
"""


def stepped(key: str, step: int, buckets: int):
    """A column of pseudo-random whole numbers that the checking SQL repeats."""
    return (F.pmod(F.col(key), F.lit(MODULUS)) * MULTIPLIER + step * SEED_STEP) % MODULUS % buckets


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Identity, grouping and account columns only: no pass over the line table."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entity_id"),
        F.col("c_name").alias("name"),
        F.col("o_orderstatus").alias("segment"),
        (F.col("o_custkey") % 113).alias("grp"),
        F.col("n_name").alias("country"),
        F.when(F.col("o_orderkey") % 8 < 5, None).otherwise(F.col("c_mktsegment")).alias("sponsor"),
        F.col("c_acctbal").alias("f_acctbal"),
        F.col("o_totalprice").alias("raw_value"),
        stepped("o_orderkey", 7, 1000).alias("h_split"),
        (stepped("o_orderkey", 9, 20001) - 10000).alias("noise"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The full entity table with line statistics, target and prediction."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.sum("l_quantity").alias("f_qty"),
            F.avg("l_discount").alias("f_disc"),
            F.avg("l_tax").alias("f_tax"),
            F.count("*").alias("f_lines"),
        )
    )
    joined = people(spark, folder).join(lines, F.col("entity_id") == F.col("k"), "left")

    def known(name):
        return F.coalesce(F.col(name), F.lit(0))

    value = F.when(F.col("entity_id") % 500 == 0, F.lit(0.0)).otherwise(
        100000
        + 2000 * known("f_qty")
        + 300000 * known("f_disc")
        - 150000 * known("f_tax")
        + 5 * F.col("f_acctbal")
        + F.col("noise")
    )
    factor = 1 + ((F.col("entity_id") * 7919) % 101 - 50) / F.lit(100.0)
    order = ["entity_id", "name", "segment", "grp", "country", "sponsor", *FEATURES, "raw_value", "h_split", "noise"]
    return joined.select(*order, value.alias("value")).withColumn("predicted", F.col("value") * factor)

"""Writers. They write in parallel, one file per task, without a shuffle of their own; only the category dictionary is one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import NULL_LITERAL
from worthline.operators.columns import segment_name


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv_null_literal(df: DataFrame, path: str, literal: str = NULL_LITERAL) -> None:
    df.write.csv(path, header=True, nullValue=literal, escape='"')


def write_by_segment(df: DataFrame, path: str, code: str, names: dict[int, str], name: str = "segment_name") -> None:
    """One folder per segment; a segment without rows has none. Readers prune by folder."""
    df.withColumn(name, segment_name(code, names)).write.partitionBy(name).parquet(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """The category dictionary as one JSON document, indented by two, variables by name and values by code.

    Its lines are built in parallel, and one task sorts (on disk, if need be) and streams them; no row
    holds more than one category.
    """
    text = F.expr("substring(to_json(array(value)), 2, length(to_json(array(value))) - 2)")
    comma = F.when(F.col("code") < F.col("total") - 1, ",").otherwise("")
    name = F.expr("substring(to_json(array(variable)), 2, length(to_json(array(variable))) - 2)")

    def line(section, text_):
        return F.struct(F.lit(section).alias("section"), text_.alias("line"))

    values = dictionary.select(
        "variable",
        "code",
        F.explode(F.array(line(1, F.concat(F.lit("      "), text, F.lit(": "), F.col("code").cast("string"), comma)), line(3, F.concat(F.lit("      "), text, comma)))).alias("_l"),
    )
    heads = dictionary.groupBy("variable").agg(F.first("total").alias("total"))
    last = heads.agg(F.max("variable")).scalar()
    frame = heads.select(
        "variable",
        F.lit(-1).cast("long").alias("code"),
        F.explode(
            F.array(
                line(0, F.concat(F.lit("  "), name, F.lit(': {\n    "mapeo": {'))),
                line(2, F.lit('    },\n    "valores_originales": [')),
                line(4, F.concat(F.lit('    ],\n    "total_categorias": '), F.col("total").cast("string"), F.lit("\n  }"), F.when(F.col("variable") == last, "").otherwise(","))),
            )
        ).alias("_l"),
    )
    ends = dictionary.sparkSession.createDataFrame([(False, -1, "{"), (True, 5, "}")], "last boolean, section int, line string")
    lines = frame.unionByName(values.withColumn("code", F.col("code").cast("long"))).select(F.lit(None).cast("boolean").alias("end"), "variable", "_l.section", "code", "_l.line")
    outer = ends.select(F.col("last").alias("end"), F.lit("").alias("variable"), "section", F.lit(-1).cast("long").alias("code"), "line")
    place = F.when(~F.col("end"), 0).when(F.col("end"), 2).otherwise(1)
    whole = lines.unionByName(outer).withColumn("_place", place).repartition(1)
    whole.sortWithinPartitions("_place", "variable", "section", "code").select("line").write.text(path)

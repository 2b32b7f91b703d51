"""Readers of delimited text and of category dictionaries."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from worthline.functions.scalars import NULL_TOKENS, null_tokens_to_null

# Field names of the category dictionary documents.
DICTIONARY_SCHEMA = "map<string, struct<mapeo: map<string, int>, valores_originales: array<string>, total_categorias: int>>"


def read_csv(spark: SparkSession, path: str, schema, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header and a declared schema: one pass, no inference."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, escape='"')


def read_csv_null_tokens(
    spark: SparkSession, path: str, schema: StructType, tokens: Sequence[str] = NULL_TOKENS, sep: str = ","
) -> DataFrame:
    """As ``read_csv`` where any of several tokens means null; text that is no number becomes null."""
    as_text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = read_csv(spark, path, as_text, sep)
    return raw.select(
        *[null_tokens_to_null(f.name, tokens).try_cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    )


def read_folder_union(
    spark: SparkSession, folder: str, required: Sequence[str], sep: str = ",", types: dict[str, str] | None = None
) -> DataFrame:
    """Every CSV in a folder whose header has the required columns, with the union of columns.

    A table is a file or a folder of part files. One job learns all headers; tables with the same header
    are then read by one scan. A file without a line is no table.
    """
    top = folder.rstrip("/").split(":")[-1]
    first: dict[str, tuple] = {}
    for path, line in sorted(first_lines(spark, folder).items()):
        first.setdefault(path if _parent(path).endswith(top) else _parent(path), tuple(next(csv.reader([line], delimiter=sep))))
    headers: dict[tuple, list[str]] = {}
    for path, names in first.items():
        headers.setdefault(names, []).append(path)
    tables = []
    for names, paths in headers.items():
        if set(required) <= set(names):
            schema = StructType([StructField(c, StringType()) for c in names])
            table = spark.read.schema(schema).csv(paths, header=True, sep=sep, escape='"')
            tables.append(table.select(*[F.col(f"`{c}`").try_cast((types or {}).get(c, "string")).alias(c) for c in names]))
    if not tables:
        raise ValueError(f"no file under {folder} has the columns {list(required)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_lines(spark: SparkSession, folder: str) -> dict[str, str]:
    """{file: first line that is not blank} of every CSV file below ``folder``, by one job.

    Each task is given one stretch of one file, and stops after its first lines, or at once if the stretch is
    not the first of its file: what is read grows with the number of files and not with their size.
    """
    settings = {"spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "1g"}
    kept = {name: spark.conf.get(name) for name in settings}
    schema = "path string, start long, value string"

    def head(batches):
        for batch in batches:
            if batch["start"][0].as_py() != 0:
                return
            for i, line in enumerate(batch["value"].to_pylist()):
                if line.strip():
                    yield batch.slice(i, 1)
                    return

    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
        return {r["path"]: r["value"] for r in lines.mapInArrow(head, schema).collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def _parent(path: str) -> str:
    return path.rsplit("/", 1)[0]


def read_folder_excluding(spark: SparkSession, folder: str, schema, excluded: Sequence[str]) -> DataFrame:
    """Every CSV table in a folder except the named ones; whole files are skipped.

    A table is a file or a folder of part files, so either name can be excluded. Only ``*.csv`` is read.
    """
    parts = F.split("_metadata.file_path", "/")
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    everything = reader.csv(folder, header=True, escape='"')
    names = list(excluded)
    left_out = F.element_at(parts, -1).isin(names) | F.element_at(parts, -2).isin(names)
    return everything.filter(~left_out)


def read_named_rows(spark: SparkSession, path: str, schema, name: str) -> DataFrame:
    """Rows whose name is not blank; empty lines are skipped by the reader."""
    return read_csv(spark, path, schema).filter(F.trim(name) != "")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(variable, value, code, total) of a category dictionary written as JSON.

    A file holds one document, on one line or indented, or one document on each line. Text that is
    neither raises.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    by_line = F.transform(lines, lambda x: F.from_json(x, DICTIONARY_SCHEMA))
    documents = F.when(F.forall(by_line, lambda x: x.isNotNull()), by_line).otherwise(F.array(F.from_json("value", DICTIONARY_SCHEMA)))
    parsed = whole.select(F.explode(documents).alias("d"))
    parsed = parsed.select(F.when(F.col("d").isNull(), F.raise_error(F.lit("no category dictionary"))).otherwise(F.col("d")).alias("d"))
    columns = parsed.select(F.explode("d").alias("variable", "entry"))
    return columns.select(
        "variable", F.explode("entry.mapeo").alias("value", "code"), F.col("entry.total_categorias").alias("total")
    )

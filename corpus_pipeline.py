"""The corpus pipeline: language, near copies, personal data, mixing, tokens; each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthline.llm.languages import fit_languages, keep_known
from worthline.llm.mixing import mixed_documents
from worthline.llm.near_copies import near_classes, one_of_each
from worthline.llm.personal import fit_personal, redact
from worthline.llm.token_codec import round_trip
from worthline.session import written

#: SQL cannot state the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null lang is filled in. Texts that are null or hold no letter go."""
    return keep_known(docs, fit_languages(docs), lang="lang")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id."""
    return one_of_each(docs, near_classes(docs))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the name of its kind."""
    return redact(docs, fit_personal(docs), length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of a mix of the sources by the square roots of their sizes; columns of any name stay."""
    return mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    source = docs.select("doc_id", "text")
    coded = round_trip(source, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("near_copies", keep_one_of_each),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, writing each stage's rows before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

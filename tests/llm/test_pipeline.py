"""The corpus pipeline against plain versions of its stages, on the smallest tables with planted cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from worthline.llm import personal


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The documents with nulls, a text without letters, an exact copy and repeated rows added."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    row = docs.orderBy("doc_id").first()
    added = spark.createDataFrame(
        [
            (900001, None, "en", "src0", 0),
            (900002, "12 -- 34", "en", "src0", 8),
            (900003, row["text"], None, None, len(row["text"])),
            (900004, "write to mail x.y@z.com about a thing that is not the other thing", "en", "src1", 64),
            (900004, "write to mail x.y@z.com about a thing that is not the other thing", "en", "src1", 64),
        ],
        docs.schema,
    )
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.unionByName(added).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}

    known = corpus_pipeline.keep_known_language(spark, docs, folder)
    assert known.columns == columns
    kept = {r["doc_id"] for r in known.collect()}
    assert kept == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    assert known.filter("lang is null").count() == 0

    single = corpus_pipeline.keep_one_of_each(spark, known, folder)
    assert single.columns == columns
    rows = single.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 900003 not in ids and 900004 in ids
    words = [tuple(re.findall(r"[^\W_]+", r["text"].lower())) for r in rows]
    assert len(set(words)) == len(words)

    hidden = corpus_pipeline.hide_personal_data(spark, single, folder)
    assert hidden.columns == columns
    texts = {r["doc_id"]: r for r in hidden.collect()}
    assert set(texts) == set(ids)
    assert "<EMAIL>" in texts[900004]["text"]
    for r in texts.values():
        assert personal.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not personal.base_spans(before[r["doc_id"]]["text"]) and "<" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]["text"]

    mixed = corpus_pipeline.mix_sources(spark, hidden, folder)
    assert mixed.columns == columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(ids)

    coded = {r["doc_id"]: r for r in corpus_pipeline.encode_texts(spark, mixed, folder).collect()}
    assert set(coded) == set(ids)
    for i, r in texts.items():
        assert coded[i]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert len(coded[i]["ids"]) == 4 * coded[i]["n_tokens"]


def test_run_equals_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == out.select("doc_id").distinct().count() > 0
    assert out.filter(F.col("decoded_sha256").isNull()).count() == 0

"""Reading the files users have, independent folds, samples of any size, intermediates."""

import json

import pytest
from pyspark.sql import functions as F

from worthline import session
from worthline.operators import metrics, split
from worthline.operators.partials import hashed_samples, in_sample
from worthline.sources import readers


def test_plain_files_are_excluded(spark, tmp_path):
    for name in ("a.csv", "b.csv", "left_out.csv"):
        (tmp_path / name).write_text(f"k,v\n{name},1\n")
    (tmp_path / "note.txt").write_text("k,v\nnote,1\n")
    rows = readers.read_folder_excluding(spark, str(tmp_path), "k string, v int", ["left_out.csv"]).collect()
    assert sorted(r["k"] for r in rows) == ["a.csv", "b.csv"]


def test_indented_and_single_line_dictionaries(spark, tmp_path):
    entry = {"mapeo": {"x": 0, "y": 1}, "valores_originales": ["x", "y"], "total_categorias": 2}
    (tmp_path / "indented.json").write_text(json.dumps({"one": entry, "two": entry}, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({name: entry}) for name in ("three", "four")))
    rows = readers.read_dictionary(spark, str(tmp_path)).collect()
    assert sorted((r["variable"], r["value"], r["code"]) for r in rows) == sorted((n, v, c) for n in ("one", "two", "three", "four") for v, c in (("x", 0), ("y", 1)))
    (tmp_path / "broken.json").write_text("{ not a dictionary")
    with pytest.raises(Exception):
        readers.read_dictionary(spark, str(tmp_path)).collect()


def test_folds_are_independent_of_the_split_and_of_each_other(spark):
    keys = spark.range(1, 60_001).withColumnRenamed("id", "k")
    tagged = split.with_split(keys, "k")
    for fold in range(5):
        tagged = tagged.withColumn(f"f{fold}", (split.fold_part("k", fold) == "test").cast("int"))
    train = tagged.filter("split = 'train'")
    shares = train.agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(5)]).first()
    assert all(abs(share - 0.2) < 0.01 for share in shares)
    both = train.agg(*[F.avg(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"p{i}{j}") for i in range(5) for j in range(i)]).first()
    assert all(abs(share - 0.04) < 0.01 for share in both)


def test_text_keys_split_too(spark):
    keys = spark.range(4000).select(F.concat(F.lit("key-"), "id").alias("k"))
    share = split.with_split(keys, "k").filter("split = 'test'").count() / 4000
    assert 0.15 < share < 0.25


def test_sample_share_at_any_size(spark):
    for n in (10**3, 10**9, 10**12):
        rows = spark.range(200_000).withColumn("_n", F.lit(n))
        expected = 200_000 * min(1.0, 256 / n * 10**6)
        got = rows.filter(in_sample("id", 1, 256 * 10**6)).count()
        assert abs(got - expected) <= 6 * max(expected, 1) ** 0.5
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.concat(F.lit("s"), F.col("id") % 25).alias("_seg"))
    assert {len(v) for v in hashed_samples(rows, ["x"], "id", 10).values()} == {2}


def test_null_segment_stays_in_the_summary(spark):
    rows = [(s, part, float(i), float(i) + i % 3) for s in ("a", None) for part in ("train", "test") for i in range(1, 9)]
    scored = spark.createDataFrame(rows, "segment string, split string, value double, predicted double")
    assert {r["segment"] for r in metrics.segment_summary(scored, "segment").collect()} == {"a", None}


class Context:
    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master):
        self.sparkContext = Context(master)
        self.conf = {}


def test_intermediates_need_a_shared_folder_on_a_cluster():
    assert session.work_dir(Session("local[4]")).startswith("/")
    with pytest.raises(ValueError):
        session.work_dir(Session("spark://host:7077"))

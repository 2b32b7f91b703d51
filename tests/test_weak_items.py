"""Dictionary documents, tails of the t distribution, typed order, report rows without copied rows."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from worthline.operators import deviation, mapping, search
from worthline.operators.correlate import t_tail
from worthline.operators.split import key_hash, small_set_test_share, with_split_by
from worthline.plans.entities import entities
from worthline.session import scratch, work_dir
from worthline.sources import readers, writers


def test_a_dictionary_of_fifty_thousand_values_is_one_document(spark, tmp_path):
    odd = ['quote " and \\ slash', "línea\nnueva", "tab\t", "日本", ""]
    df = spark.range(50_000).select(F.format_string("v%05d", "id").alias("big"), F.when(F.col("id") < 3, F.element_at(F.array(*map(F.lit, odd)), (F.col("id") + 1).cast("int"))).alias("odd"))
    dictionary = mapping.encode_dictionary(df, ["big", "odd"])
    writers.write_dictionary(dictionary, str(tmp_path / "d"))
    (part,) = [f for f in (tmp_path / "d").iterdir() if f.name.startswith("part-")]
    want = {}
    for name, values in (("big", sorted(f"v{i:05d}" for i in range(50_000))), ("odd", sorted(odd[:3]))):
        want[name] = {"mapeo": {v: i for i, v in enumerate(values)}, "valores_originales": values, "total_categorias": len(values)}
    assert part.read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    again = readers.read_dictionary(spark, str(tmp_path / "d"))
    assert again.exceptAll(dictionary.select(*again.columns)).count() == 0 and again.count() == 50_003


def test_an_empty_dictionary_is_an_empty_document(spark, tmp_path):
    dictionary = spark.createDataFrame([], "variable string, value string, code int, total long")
    writers.write_dictionary(dictionary, str(tmp_path / "d"))
    (part,) = [f for f in (tmp_path / "d").iterdir() if f.name.startswith("part-")]
    assert json.loads(part.read_text()) == {}


def place_of(t, degrees):
    return t / math.sqrt(degrees + t * t)


@pytest.mark.parametrize("t", [0.0, 0.01, 0.5, 1.0, 2.5, 6.0, 30.0])
def test_tail_in_closed_form(t):
    exact = {
        1: 1 - 2 / math.pi * math.atan(t),
        2: 1 - t / math.sqrt(2 + t * t),
        3: 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + (t / math.sqrt(3)) / (1 + t * t / 3)),
        4: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)),
    }
    for degrees, p in exact.items():
        assert t_tail(place_of(t, degrees), degrees + 2) == pytest.approx(p, abs=1e-9)
        assert t_tail(-place_of(t, degrees), degrees + 2) == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("degrees", [5, 37, 400, 9_998, 10_002, 150_000, 10**9])
@pytest.mark.parametrize("t", [0.3, 1.96, 5.0])
def test_tail_by_integration(degrees, t):
    log_front = math.lgamma((degrees + 1) / 2) - math.lgamma(degrees / 2) - 0.5 * math.log(degrees * math.pi)
    if degrees > 1e6:  # the difference of the two is lost to rounding there
        log_front = -0.5 * math.log(2 * math.pi)
    # from t to infinity, with x = t / u
    u = (np.arange(400_000) + 0.5) / 400_000
    x = t / u
    p = 2 * float((np.exp(log_front - (degrees + 1) / 2 * np.log1p(x * x / degrees)) * t / (u * u)).mean())
    assert t_tail(place_of(t, degrees), degrees + 2) == pytest.approx(p, abs=1e-9)


def test_tail_at_the_ends():
    assert t_tail(0.4, 2) == 1.0 and t_tail(1.0, 10) == 0.0 and t_tail(0.0, 10) == 1.0


def test_order_by_what_a_column_holds(spark):
    def order(values, ascending=True):
        df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
        return [r["v"] for r in search.sort_typed(df, "v", "k", ascending).collect()]

    assert order(["10", "9", "-1.5", None, " 2 ", "", "1e3"]) == ["-1.5", None, "", " 2 ", "9", "10", "1e3"]
    assert order(["10", "9", "x", None]) == [None, "10", "9", "x"]
    assert order(["b", "A", "c"], ascending=False) == ["c", "b", "A"]
    assert order(["1d", "2", "10"]) == ["10", "1d", "2"]
    assert order([None, None]) == [None, None]


def test_report_rows_copy_no_rows(spark, small):
    df = deviation.filter_tolerance(deviation.add_deviation(entities(spark, small)))
    df = df.withColumn("none", F.lit(None).cast("string"))
    report = deviation.report_rows(df, ["grp", "country", "none"])
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r["metric"]: r["value"] for r in report.collect()}
    want = df.agg(F.count_distinct("grp").alias("grp"), F.count_distinct("country").alias("country")).first()
    assert (got["distinct_grp"], got["distinct_country"], got["distinct_none"]) == (want["grp"], want["country"], 0)


def test_share_of_test_rows_follows_the_size_of_the_group(spark):
    sizes = {"a": 8, "b": 30, "c": 4000}
    df = spark.createDataFrame([(i, g) for g, n in sizes.items() for i in range(n)], "id long, g string")
    got = {(r["g"], r["split"]): r["count"] for r in with_split_by(df, "id", ["g"]).groupBy("g", "split").count().collect()}
    assert sum(got.values()) == sum(sizes.values())
    assert got["c", "test"] / 4000 == pytest.approx(small_set_test_share(4000), abs=0.02)
    assert with_split_by(df, "id", ["g"]).exceptAll(with_split_by(df.repartition(7), "id", ["g"])).count() == 0


def entries(folder):
    """What lies in the work folder, but for Spark's own folder for checkpoints."""
    return {f.name for f in folder.iterdir() if f.is_dir() and not f.name.count("-") == 4}


@pytest.mark.parametrize("name", ["group_deviation_stats", "describe_numeric", "residual_sequence", "sink_json_dict"])
def test_what_a_query_wrote_is_removed(spark, small, name):
    folder = Path(work_dir(spark).removeprefix("file:"))
    before = entries(folder)
    with scratch(spark):
        rows = queries()[name](spark, small).collect()
        assert rows and entries(folder) > before
    assert entries(folder) == before
    with scratch(spark):
        assert len(queries()[name](spark, small).collect()) == len(rows)


def test_headers_of_two_hundred_files_take_one_job(spark, tmp_path):
    for i in range(200):
        names = ["k", "v"] if i % 3 else ["v", "k", "extra"]
        rows = "\n".join(",".join(f"{c}{i}" if c == "k" else str(i) for c in names) for _ in range(3))
        (tmp_path / f"t{i}.csv").write_text("\n" * (i % 2) + ",".join(names) + "\n" + rows + "\n")
    (tmp_path / "other.csv").write_text('"k, with comma",x\n1,2\n')
    (tmp_path / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "first lines")
    lines = readers.first_lines(spark, str(tmp_path))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) == 1
    spark.sparkContext.setJobGroup("rest", "")
    assert len(lines) == 201 and sorted(set(lines.values())) == ['"k, with comma",x', "k,v", "v,k,extra"]
    df = readers.read_folder_union(spark, str(tmp_path), ["k", "v"], types={"v": "int"})
    assert df.count() == 600 and set(df.columns) == {"k", "v", "extra"}
    assert df.agg(F.sum("v")).first()[0] == 3 * sum(range(200))
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "1g"


def test_fractional_keys_have_their_own_buckets(spark):
    df = spark.range(2000).select((F.col("id") / 8).alias("x"))
    spread = df.select(key_hash("x", 42, 1000).alias("b"), F.floor("x").alias("w")).groupBy("w").agg(F.count_distinct("b").alias("n"))
    assert spread.filter("n < 4").count() == 0
    whole = spark.range(50).select(F.col("id"), F.col("id").cast("double").alias("x"))
    assert whole.filter(key_hash("id", 1, 100) != key_hash("x", 1, 100)).count() == 0

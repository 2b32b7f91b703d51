"""Fits against brute force, other implementations and targets with known coefficients."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from worthline.operators import gram, kmeans, lasso, metrics, scale, svr, trees
from worthline.operators.assemble import assemble, pca_2d
from worthline.operators.split import with_split
from worthline.plans import cluster_models
from worthline.plans.clustering import cluster_segments
from worthline.plans.selection import select_features


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clear groups in two segments, and one row with a null."""
    rng = np.random.default_rng(0)
    centres = [(0.0, 0.0), (8.0, 8.0), (0.0, 9.0)]
    data = []
    for i in range(360):
        cx, cy = centres[i % 3]
        data.append((i, "A" if i < 240 else "B", cx + float(rng.normal(0, 0.6)), cy + float(rng.normal(0, 0.6))))
    data.append((360, "A", None, 1.0))
    return spark.createDataFrame(data, "id long, s string, x double, y double").cache()


@pytest.fixture(scope="module")
def linear(spark):
    """y = 3 a - 2 b + 5 with noise, c unrelated; segment B has the opposite sign."""
    rng = np.random.default_rng(1)
    data = []
    for i in range(1200):
        a, b, c = (float(v) for v in rng.normal(size=3))
        sign = 1 if i % 2 else -1
        data.append((i, "A" if i % 2 else "B", a, b, c, sign * (3 * a - 2 * b) + 5 + float(rng.normal(0, 0.1))))
    df = spark.createDataFrame(data, "id long, s string, a double, b double, c double, y double")
    return with_split(df, "id").cache()


def pairs(df, *columns):
    return np.array([[float(v) for v in r] for r in df.select(*columns).collect()])


def brute_silhouette(x, labels, squared):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    if not squared:
        d = np.sqrt(d)
    out = np.zeros(len(x))
    for i in range(len(x)):
        same = labels == labels[i]
        if same.sum() == 1:
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {labels[i]})
        out[i] = (b - a) / max(a, b)
    return out


def test_silhouette_equals_brute_force(blobs):
    labelled = kmeans.assign(blobs, ["x", "y"], [[0, 0], [8, 8], [0, 9], [50, 50]])
    labelled = labelled.withColumn("label", F.when(F.col("id") == 3, 3).otherwise(F.col("label")))
    got = pairs(kmeans.silhouette_samples(labelled, ["x", "y"]).orderBy("id"), "x", "y", "label", "silhouette")
    assert len(got) == 360
    assert got[:, 3] == pytest.approx(brute_silhouette(got[:, :2], got[:, 2], True), abs=1e-9)
    assert got[3, 3] == 0.0


def test_silhouette_equals_the_evaluator(blobs):
    labelled = kmeans.assign(blobs.na.drop(), ["x", "y"], [[0, 0], [8, 8], [0, 9]])
    ours = kmeans.silhouette_samples(labelled, ["x", "y"]).agg(F.avg("silhouette")).first()[0]
    vectors = assemble(labelled, ["x", "y"]).withColumn("prediction", F.col("label"))
    assert ours == pytest.approx(ClusteringEvaluator().evaluate(vectors), abs=1e-9)


MODEL_COLUMNS = {"id", "s", "label", "x", "y", "split", "predicted"}


def test_kmeans_seeds_come_from_all_rows(spark):
    """A cluster of 12 rows in 6,000, which a small sample would miss, gets its centre, and the fit says that it settled."""
    far = F.when(F.col("id") % 500 == 7, F.lit(100.0)).otherwise(F.lit(0.0))
    df = spark.range(6000).select("id", (far + (F.col("id") % 13) / 13.0).alias("x"), (far + (F.col("id") % 7) / 7.0).alias("y"))
    for parts in (1, 7):
        fit = kmeans.fit_many(df.repartition(parts), ["x", "y"], "id", [2], restarts=2)["all", 2]
        assert fit.converged and 0 < fit.steps < kmeans.MAX_STEPS
        assert fit.centroids[1] == pytest.approx([100.4, 100.4], abs=0.3)


def test_kmeans_of_fewer_distinct_points_than_clusters(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).cast("double").alias("x"))
    fits = kmeans.fit_many(df, ["x"], "id", [1, 2, 3])
    assert ("all", 3) not in fits
    assert fits["all", 2].inertia == 0 and fits["all", 2].centroids.ravel().tolist() == [0.0, 1.0]


def test_kmeans_is_as_good_as_the_library(blobs):
    ours = kmeans.fit_many(blobs, ["x", "y"], "id", [1, 3, 5])
    vectors = assemble(blobs.na.drop(), ["x", "y"])
    best = min(KMeans(k=3, seed=s).fit(vectors).summary.trainingCost for s in range(3))
    assert ours["all", 3].inertia <= best * 1.001
    assert ours["all", 5].inertia < ours["all", 3].inertia < ours["all", 1].inertia
    labelled = kmeans.assign(blobs, ["x", "y"], ours["all", 3].centroids)
    total = kmeans.inertia(labelled).agg(F.sum("inertia")).first()[0]
    assert total == pytest.approx(ours["all", 3].inertia, rel=1e-9)
    assert labelled.filter("label = -1").count() == 1


def test_clustering_stage(blobs):
    done = cluster_segments(blobs, ["x", "y"], "id", "s", most=6, restarts=3)
    rows = {r["s"]: r for r in done.summary.collect()}
    assert {s: r["n"] for s, r in rows.items()} == {"A": 240, "B": 120}
    assert all(r["k_silhouette"] == 3 for r in rows.values())
    assert done.labelled.count() == 361
    assert done.labelled.filter("label = -1").count() == 1


def test_moments_subtract_and_join(linear):
    df = linear.withColumn("f", (F.col("id") % 3).cast("int"))
    parts = gram.moments_by(df, ["a", "b", "y"], None, "f")
    (whole,) = gram.moments_by(df, ["a", "b", "y"]).values()
    rest = whole - parts["all", 0]
    again = parts["all", 1] + parts["all", 2]
    assert rest.n == again.n
    assert rest.mean == pytest.approx(again.mean)
    assert rest.cross == pytest.approx(again.cross, rel=1e-9, abs=1e-9)


def test_least_squares_equals_numpy(linear):
    got = {(r["segment"], r["term"]): r["coefficient"] for r in gram.linear_regression_by(linear, ["a", "b", "c"], "y", "s").collect()}
    for s in "AB":
        m = pairs(linear.filter(F.col("s") == s), "a", "b", "c", "y")
        x = np.column_stack([m[:, :3], np.ones(len(m))])
        want = np.linalg.lstsq(x, m[:, 3], rcond=None)[0]
        assert [got[s, t] for t in ("a", "b", "c", "(intercept)")] == pytest.approx(want, abs=1e-8)


def test_moments_survive_a_large_offset(spark):
    df = spark.createDataFrame([(1e9 + i, 2e9 + 3.0 * i) for i in range(100)], "x double, y double")
    (m,) = gram.moments_by(df, ["x", "y"]).values()
    coefficient, _ = gram.least_squares(m)
    assert coefficient[0] == pytest.approx(3.0, rel=1e-9)


def test_lasso_equals_the_library_at_one_penalty(linear):
    train = linear.filter("s = 'A'")
    alpha = 0.3
    fit = lasso.lasso_cv(train, ["a", "b", "c"], "y", "id", alphas=np.array([alpha]))["all"]
    scaled = scale.scale(train, scale.fit_scaler(train, ["a", "b", "c"]))
    model = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=alpha, standardization=False, tol=1e-12, maxIter=500)
    want = model.fit(assemble(scaled, ["a", "b", "c"])).coefficients.toArray()
    assert fit.coefficients == pytest.approx(want, abs=1e-5)
    assert fit.coefficients[2] == 0.0


def test_lasso_prefers_a_small_penalty_on_clean_data(linear):
    fits = lasso.lasso_cv(linear, ["a", "b", "c"], "y", "id", "s", split="split")
    assert set(fits) == {"A", "B"}
    for fit in fits.values():
        assert fit.alpha < 0.1 and fit.train_r2 > 0.99 and fit.test_r2 > 0.99
    # features are scaled, so the coefficient is the slope times the spread of the segment's training rows
    spread = {r["s"]: r["d"] for r in linear.filter("split = 'train'").groupBy("s").agg(F.stddev_pop("a").alias("d")).collect()}
    for name, slope in (("A", 3), ("B", -3)):
        assert fits[name].coefficients[0] == pytest.approx(slope * spread[name], abs=0.05)


def test_selection_stage(linear):
    holes = linear.drop("split").withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    done = select_features(holes, ["a", "b", "c"], "y", "id", "s", protected=["c"], pct=50)
    kept = {(r["segment"], r["variable"]) for r in done.selected.filter("kept").collect()}
    assert kept == {(s, v) for s in "AB" for v in "ac"}
    assert done.selected.filter("kept and not protected").count() == 2


def test_support_vectors_recover_coefficients_despite_outliers(linear):
    spoiled = linear.withColumn("y", F.when(F.col("id") % 25 == 0, F.col("y") + 500).otherwise(F.col("y")))
    models, prepared, _ = svr.fit_svr(spoiled, ["a", "b", "c"], "y", "id", "s", params=svr.Params(kernel="linear", C=10.0, epsilon=0.001))
    scored = svr.score_svr(linear, models, prepared, "s")
    score = {(r["s"], r["split"]): r["r2"] for r in metrics.regression_metrics(scored.withColumnRenamed("y", "value"), ["s", "split"]).collect()}
    assert min(score.values()) > 0.98


def test_support_vector_objective_equals_direct_minimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    y = 1.5 * x + rng.standard_t(2, size=80) * 0.3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    params = svr.Params(kernel="linear", C=1.0, epsilon=0.2)
    models, prepared, _ = svr.fit_svr(df, ["x"], "y", "id", split=None, params=params, steps=60)
    z, t = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()

    def objective(w, b):
        return 0.5 * w * w + params.C * np.maximum(np.abs(t - w * z - b) - params.epsilon, 0).sum()

    w, b = models["all"].weights
    grid = min(objective(i, j) for i in np.linspace(w - 0.3, w + 0.3, 121) for j in np.linspace(b - 0.3, b + 0.3, 121))
    assert objective(w, b) <= grid * 1.0005


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
def test_models_carry_a_certificate(spark, linear, kernel):
    """The bound is below every objective, and the gap is small for each segment."""
    params = svr.Params(kernel=kernel, C=5.0, epsilon=0.1, gamma=0.1)
    models, prepared, _ = svr.fit_svr(linear, ["a", "b", "c"], "y", "id", "s", params=params)
    assert set(models) == {"A", "B"}
    train = linear.filter("split = 'train'")
    for seg, m in models.items():
        assert 0 <= m.gap <= svr.GAP and 0 < m.steps < 100
        rows = scale.scale(train.filter(F.col("s") == seg), prepared.inputs)
        data = pairs(rows, "a", "b", "c", "y")
        z, y = m.map(data[:, :3]), (data[:, 3] - m.y_mean) / m.y_std
        zero = params.C * np.maximum(np.abs(y) - params.epsilon, 0).sum()
        bound = m.objective - m.gap * zero
        rng = np.random.default_rng(1)
        for size in (0.0, 0.01, 0.1):
            w = m.weights + size * rng.normal(size=len(m.weights))
            value = 0.5 * w[:-1] @ w[:-1] + params.C * np.maximum(np.abs(y - z @ w) - params.epsilon, 0).sum()
            assert value >= bound - 1e-9 * zero
            if size == 0:
                assert value == pytest.approx(m.objective, rel=1e-9)


def test_search_goes_on_with_the_better_half(spark, linear):
    trials = [svr.Params(10.0 ** (i - 3), "rbf", 0.1, 0.05) for i in range(6)]
    prepared = svr.Prepared(linear, ["a", "b", "c"], "y", "id", "s", "split")
    scores = svr.search(prepared, trials)
    prepared.rows.unpersist()
    for seg in "AB":
        own = {t: (score, steps) for s, t, score, steps in scores if s == seg}
        assert len(own) == 6
        furthest = sorted(own, key=lambda t: -own[t][1])[:2]
        assert svr.best_trial(scores, seg) in furthest
        assert own[svr.best_trial(scores, seg)][0] == max(own[t][0] for t in furthest)


def test_kernel_search_and_importance(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, size=(600, 2))
    y = np.sin(2 * x[:, 0]) * 10
    df = with_split(spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, x double, z double, value double"), "id")
    trials = [svr.Params(kernel="linear"), svr.Params(kernel="rbf", C=50.0, epsilon=0.02, gamma=1.0)]
    models, prepared, scores = svr.fit_svr(df, ["x", "z"], "value", "id", trials=trials)
    assert models["all"].params.kernel == "rbf"
    assert scores[1][2] > 0.8 > scores[0][2]
    scored = svr.score_svr(df, models, prepared, None)
    assert metrics.regression_metrics(scored.filter("split = 'test'"), []).first()["r2"] > 0.9
    assert models["all"].gap <= svr.GAP
    table = {r["variable"]: r["coefficient"] for r in svr.svr_importance(df, models, prepared, "value", None, "id").collect()}
    assert table["x"] > 10 * abs(table["z"])
    # the shuffle follows the keys, not the partitions
    for parts in (1, 7):
        again = {r["variable"]: r["coefficient"] for r in svr.svr_importance(df.repartition(parts), models, prepared, "value", None, "id").collect()}
        assert again == pytest.approx(table, rel=1e-9)


def test_scores_are_null_without_model_or_input(linear):
    odd = linear.withColumn("s", F.when(F.col("id") < 4, "Z").otherwise(F.col("s"))).withColumn("a", F.when(F.col("id") != 9, F.col("a")))
    models, prepared, _ = svr.fit_svr(odd.filter("id > 9"), ["a", "b"], "y", "id", "s", params=svr.Params(kernel="rbf"), steps=2, landmarks=8)
    scored = svr.score_svr(odd, models, prepared, "s")
    assert {r["id"] for r in scored.filter("predicted is null").collect()} == {0, 1, 2, 3, 9}
    assert scored.count() == odd.count()


def test_trees_per_segment(linear):
    few = dict(trees.SEGMENT_PARAMS, maxIter=15)
    odd = linear.withColumn("s", F.when(F.col("id") < 4, "Z").otherwise(F.col("s")))
    models = trees.gbt_by_segment(odd, ["a", "b", "c"], "y", "s", params=few)
    assert set(models) == {"A", "B"}
    scored = trees.score_by_segment(odd, models, "s", ["a", "b", "c"])
    assert scored.count() == odd.count()
    assert scored.filter("predicted is null").count() == 4
    table = metrics.segment_summary(scored, "s", real="y")
    assert min(r["test_r2"] for r in table.filter("s <> 'Z'").collect()) > 0.5
    top = {s: max(m.importance(), key=lambda v: v[1])[0] for s, m in models.items()}
    assert top == {"A": "a", "B": "a"}


def test_packed_forests_score_as_the_trainer_does(linear):
    few = dict(trees.SEGMENT_PARAMS, maxIter=12)
    models = trees.gbt_by_segment(linear, ["a", "b", "c"], "y", "s", params=few)
    packed = {r["id"]: r["predicted"] for r in trees.score_by_segment(linear, models, "s", ["a", "b", "c"]).collect()}
    for s, model in models.items():
        for r in model.transform(assemble(linear.filter(F.col("s") == s), ["a", "b", "c"])).collect():
            assert packed[r["id"]] == pytest.approx(r["predicted"], rel=1e-9, abs=1e-9)


def test_five_hundred_segments_are_scored_in_one_scan(spark, tmp_path):
    """Stumps made by hand: segment i splits x at i and answers -i or i."""
    stump = lambda i: trees.Forest(
        np.array([0, -1, -1], dtype=np.int32), np.array([float(i), 0.0, 0.0]), np.array([1, 1, 2], dtype=np.int32), np.array([2, 1, 2], dtype=np.int32),
        np.array([0.0, -float(i), float(i)]), np.array([0], dtype=np.int32), np.array([1.0]), 0.5, 2.0,
    )
    df = spark.range(5000).select((F.col("id") % 501).cast("string").alias("s"), (F.col("id") % 997).cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    scored = trees.score_by_segment(df, {str(i): stump(i) for i in range(500)}, "s", ["x"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    for r in scored.collect():
        i = int(r["s"])
        assert r["predicted"] == (None if i == 500 else 0.5 + 2.0 * (-i if r["x"] <= i else i))


@pytest.mark.parametrize("kind", ["linear", "trees", "kernel"])
def test_models_of_clusters(spark, kind):
    """Two segments with clusters of 400, 400, 9 and 300 rows: the small one and the rows outside have no prediction."""
    rng = np.random.default_rng(8)
    rows = []
    for segment, label, n, slope in (("A", 0, 400, 2.0), ("A", 1, 400, -2.0), ("B", 0, 9, 1.0), ("B", 1, 300, 5.0), ("B", -1, 20, 1.0)):
        for x, e in zip(rng.uniform(0, 10, n), rng.normal(size=n) * 0.05):
            rows.append((len(rows), segment, label, None if len(rows) % 50 == 3 else float(x), slope * float(x) + 30 + float(e)))
    df = spark.createDataFrame(rows, "id long, s string, label int, x double, y double")
    options = {"trees": {"params": dict(trees.SEGMENT_PARAMS, maxIter=20)}, "kernel": {"params": svr.Params(kernel="linear", C=10.0, epsilon=0.01)}}.get(kind, {})
    done = cluster_models.fit_clusters(df, ["x"], "y", "id", "s", kind=kind, **options)
    scored = done.scored.collect()
    assert len(scored) == len(rows) and MODEL_COLUMNS <= set(done.scored.columns)
    for r in scored:
        assert (r["predicted"] is None) == (r["label"] == -1 or (r["s"], r["label"]) == ("B", 0))
    summary = {(r["segment"], r["cluster"]): r for r in done.summary.collect()}
    assert set(summary) == {("A", 0), ("A", 1), ("B", 1)}
    for key, n in ((("A", 0), 400), (("A", 1), 400), (("B", 1), 300)):
        r = summary[key]
        assert r["n"] == n and r["n_features"] == 1 and 0.05 < r["test_n"] / n < 0.16
        assert r["test_r2"] > (0.5 if kind == "trees" else 0.85)
        assert (r["parameters"] is None) == (kind == "linear")
    nothing = cluster_models.fit_clusters(df.filter("label < 0"), ["x"], "y", "id", "s", kind="linear")
    assert nothing.scored.filter("predicted is not null").count() == 0 and nothing.summary.count() == 0


def test_cluster_report_and_summary_agree(blobs):
    df = blobs.na.drop().withColumn("s", F.lit("one"))
    done = cluster_segments(df, ["x", "y"], "id", "s", most=4, restarts=2)
    row = done.summary.first()
    assert row["min_distance"] <= row["max_distance"] and row["separation"] >= 1
    by_label = {r["label"]: r for r in done.labelled.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.median("y").alias("y")).collect()}
    assert [c["label"] for c in row["clusters"]] == sorted(by_label)
    for c in row["clusters"]:
        want = by_label[c["label"]]
        assert (c["n"], c["x_mean"], c["y_median"]) == pytest.approx((want["n"], want["x"], want["y"]))


def test_projection_keeps_variance(blobs):
    df = blobs.na.drop()
    points, explained = pca_2d(df, ["x", "y"])
    assert sum(explained) == pytest.approx(1.0)
    got = pairs(points, "pc1", "pc2")
    assert got[:, 0].var() > got[:, 1].var()

"""Passes of fits over blocks of rows, against plain sums over all rows."""

import numpy as np
from pyspark.sql import functions as F

from worthline.operators import kmeans, svr
from worthline.operators.partials import BLOCK_ROWS, Blocks, spread


def rows_of(spark):
    rng = np.random.default_rng(3)
    n = 3 * BLOCK_ROWS + 17
    x, seg = rng.normal(size=(n, 2)), np.where(rng.random(n) < 0.7, "a", "b")
    df = spark.createDataFrame([(str(s), i, float(a), float(b)) for i, (s, (a, b)) in enumerate(zip(seg, x))], "_seg string, id long, x double, y double")
    return df, x, seg


def test_blocks_hold_every_row_once_in_small_matrices_of_one_segment(spark):
    df, x, seg = rows_of(spark)
    blocks = Blocks(df.repartition(3), ["x", "y"])
    for direct in (1, 10**9):  # added up by the driver, and by a shuffle
        sums = blocks.sums(lambda s, rows: [((s,), np.array([len(rows), *rows.sum(axis=0)]))], direct)
        assert set(sums) == {("a",), ("b",)}
        for s in "ab":
            np.testing.assert_allclose(sums[s,], [(seg == s).sum(), *x[seg == s].sum(axis=0)], atol=1e-9)
    assert max(len(rows) for _, rows in blocks.rdd.collect()) <= BLOCK_ROWS
    blocks.unpersist()
    assert Blocks(df.filter("false"), ["x"]).sums(lambda s, rows: [((s,), np.ones(1))], 1) == {}


def test_the_tasks_of_a_pass_follow_the_cores_and_not_the_planned_partitions(spark):
    planned = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        assert spread(spark.range(1000), "id").rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", planned)


def test_step_sums_of_all_jobs_of_a_map_are_those_of_each_job_alone():
    rng = np.random.default_rng(5)
    z, y, folds = rng.normal(size=(300, 5)), rng.normal(size=300), rng.integers(0, 4, 300)
    params = [svr.Params(epsilon=0.1), svr.Params(epsilon=0.3), svr.Params(epsilon=0.2)]
    weights = [(rng.normal(size=5), rng.normal(size=5)), (rng.normal(size=5), None), (rng.normal(size=5), rng.normal(size=5))]
    jobs = [(("all", t, fold), p, w) for t, (fold, p, w) in enumerate(zip((0, 1, -1), params, weights))]
    got = dict(svr.step_sums(z, y, folds, svr.Group.of(jobs)))
    errors = dict(svr.fold_errors(z, y, folds, svr.Group.of(jobs)))
    for key, p, (now, last) in jobs:
        inside = np.ones(300, dtype=bool) if key[2] < 0 else (folds >> key[2] & 1) > 0
        zi, yi = z[inside], y[inside]
        residual = yi - zi @ now
        above, below = (0.5 / np.maximum(abs(residual + s * p.epsilon), svr.SHARPNESS) for s in (-1, 1))
        gram = (zi * (above + below)[:, None]).T @ zi
        right = zi.T @ (above * (yi - p.epsilon) + below * (yi + p.epsilon))
        duals = np.zeros(len(yi))
        if last is not None:
            before = yi - zi @ last
            duals = sum(0.5 * (residual + s * p.epsilon) / np.maximum(abs(before + s * p.epsilon), svr.SHARPNESS) for s in (-1, 1)).clip(-1, 1)
        up, down = duals.clip(min=0), duals.clip(max=0)
        loss = np.maximum(abs(residual) - p.epsilon, 0).sum()
        wanted = np.concatenate([gram[np.triu_indices(5)], right, [loss], zi.T @ up, zi.T @ down, [yi @ up, yi @ down]])
        np.testing.assert_allclose(got[key], wanted, rtol=1e-9, atol=1e-9)
        out = ~inside
        np.testing.assert_allclose(errors[key], [out.sum(), y[out].sum(), (y[out] ** 2).sum(), ((y - z @ now)[out] ** 2).sum()], atol=1e-9)


def test_passes_of_kmeans_are_the_same_over_blocks_and_tables(spark):
    df, x, seg = rows_of(spark)
    models = {("a", 3, 0): x[:3], ("b", 2, 0): x[5:7], ("b", 2, 1): np.zeros((2, 2))}
    blocks = Blocks(df.repartition(3), ["x", "y"])
    ours, plain = kmeans.lloyd_sums(blocks, ["x", "y"], models), kmeans.lloyd_sums(df, ["x", "y"], models)
    blocks.unpersist()
    for key, centroids in models.items():
        own = x[seg == key[0]]
        far = kmeans.squared_distances(own, centroids)
        label = far.argmin(axis=1)
        wanted = [[(label == c).sum(), far[label == c, c].sum(), *own[label == c].sum(axis=0)] for c in range(key[1])]
        np.testing.assert_allclose(ours[key], wanted, atol=1e-9)
        np.testing.assert_allclose(plain[key], wanted, atol=1e-9)
    assert df.agg(F.count("*")).first()[0] == len(x)


def test_every_trial_of_a_search_is_fitted_to_the_end_on_every_fold(spark):
    """The score of each trial, the worst as well, is that of models that were solved on every fold."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 2))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    trials = [svr.Params(10.0 ** (i - 2), "rbf", 0.1, 0.2) for i in range(5)]
    prepared = svr.Prepared(df, ["a", "b"], "y", "id", None, None)
    scores = svr.search(prepared, trials)
    points = prepared.landmarks("all", svr.LANDMARKS)
    jobs = {("all", t, fold): (svr.KernelMap(p, points), p) for t, p in enumerate(trials) for fold in range(svr.FOLDS)}
    solved = svr.fit_models(prepared, jobs)
    rows = np.concatenate([block for _, block in prepared.rows.rdd.collect()])
    prepared.rows.unpersist()
    mean, std = prepared.targets["all"]
    target, bits = (rows[:, 2] - mean) / std, rows[:, 3].astype(int)
    assert sorted((seg, t) for seg, t, _, _ in scores) == [("all", t) for t in range(5)]
    for _, t, score, _ in scores:
        wanted = []
        for fold in range(svr.FOLDS):
            out = bits >> fold & 1 == 0
            guess = jobs["all", t, fold][0](rows[out, :2]) @ solved["all", t, fold].weights
            wanted.append(1 - ((target[out] - guess) ** 2).sum() / ((target[out] - target[out].mean()) ** 2).sum())
        np.testing.assert_allclose(score, np.mean(wanted), rtol=1e-6)
    assert svr.best_trial(scores, "all") == max(range(5), key=lambda t: scores[t][2])

"""K-means over many segments, cluster counts and restarts in shared passes, and its diagnostics.

All models of a fit are advanced by the same pass: each task assigns its rows to the centroids of
every model and sends per-cluster sums, so a sweep over K, restarts and segments costs the scans of
its slowest model. Only centroids (models x K x dims numbers) live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from worthline.functions.scalars import ratio
from worthline.operators.lookup import lookup_join
from worthline.operators.partials import Blocks, Shared, collect_sums, keyed, matrix, spread, sum_by_key

RESTARTS = 10
#: Steps at most, and the squared shift of the centres, as a share of the mean variance, at which a model has settled.
MAX_STEPS = 300
TOLERANCE = 1e-4
#: Rounds of seeding, and candidates of a round for each cluster of the largest K.
SEED_ROUNDS, OVERSAMPLING = 4, 2


@dataclass
class Clustering:
    """Centroids of the best restart, the sum of squared distances to them, and how the steps ended."""

    centroids: np.ndarray
    inertia: float
    steps: int
    converged: bool


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) without expanding the square, so that close points keep their digits."""
    out = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):
        out += (x[:, j : j + 1] - centroids[:, j]) ** 2
    return out


def candidates(points: DataFrame, columns: list[str], key: str, most: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{segment: (candidate centres, rows nearest to each)}: oversampled seeding (Bahmani et al. 2012) over all rows.

    The first round takes rows of each segment evenly, each later round takes rows with a chance in
    proportion to the squared distance from the candidates so far, so that ``OVERSAMPLING`` times
    ``most`` are added. A row draws its lot from a hash of its key: the least lots of each task, then of
    the segment, win, and only they are sent. At last every row counts for its nearest candidate.
    """
    wanted = OVERSAMPLING * most
    found: dict[str, np.ndarray] = {}
    schema = f"_seg string, _lot double, {', '.join(f'{c} double' for c in columns)}"
    for number in range(SEED_ROUNDS):
        shared = Shared(points.sparkSession, found)
        lot = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed * 100 + number)), 11).cast("double") + 0.5) / float(2**53)

        def draw(batches, first=number == 0, shared=shared):
            held = None
            for batch in batches:
                if not first:
                    far = np.zeros(len(batch))
                    for seg, at in batch.groupby("_seg", sort=False).indices.items():
                        if seg in shared.value:
                            far[at] = squared_distances(matrix(batch.iloc[at], columns), shared.value[seg]).min(axis=1)
                    batch = batch[far > 0].assign(_lot=-np.log(batch["_lot"].to_numpy()[far > 0]) / far[far > 0])
                held = batch if held is None else pd.concat([held, batch])
                held = held.sort_values("_lot").groupby("_seg", sort=False).head(wanted)
            if held is not None and len(held):
                yield held

        drawn = points.select("_seg", lot.alias("_lot"), *columns).mapInPandas(draw, schema)
        order = Window.partitionBy("_seg").orderBy("_lot", *columns)
        rows = drawn.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= wanted).toPandas()
        shared.unpersist()
        for seg, part in rows.sort_values(["_seg", "_place"]).groupby("_seg"):
            new = matrix(part, columns)
            found[seg] = np.unique(np.concatenate([found[seg], new]) if seg in found else new, axis=0)
    sums = lloyd_sums(points, columns, {(seg, len(c), 0): c for seg, c in found.items()})
    return {seg: (c, sums[seg, len(c), 0][:, 0]) for seg, c in found.items()}


def starting_points(sample: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Careful seeding (Arthur and Vassilvitskii 2007) on the weighted candidates, improved on them by a few steps."""
    chosen = [sample[rng.choice(len(sample), p=weight / weight.sum())]]
    for _ in range(k - 1):
        far = squared_distances(sample, np.array(chosen)).min(axis=1) * weight
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum())])
    centroids = np.array(chosen)
    for _ in range(50):
        label = squared_distances(sample, centroids).argmin(axis=1)
        counts = np.bincount(label, weights=weight, minlength=k)
        sums = np.stack([np.bincount(label, weights=c * weight, minlength=k) for c in sample.T], axis=1)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        if np.allclose(new, centroids, rtol=0, atol=1e-6):
            break
        centroids = new
    return centroids


def fit_many(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    ks: Sequence[int],
    segment: str | None = None,
    restarts: int = RESTARTS,
    seed: int = 42,
    max_steps: int = MAX_STEPS,
) -> dict[tuple[str, int], Clustering]:
    """{(segment, K): best clustering} for every segment and every K; rows with nulls left out.

    A model takes steps until its centres have settled (``converged``), and leaves the shared passes then.
    A K above the number of distinct points has no model.
    """
    columns = list(columns)
    points = keyed(df, segment).select("_seg", key, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    held = df.storageLevel.useMemory
    if not held:
        points = spread(points, key).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = Blocks(points, columns)
    try:
        spreads = points.groupBy("_seg").agg(*[F.var_pop(c).alias(c) for c in columns]).collect()
        variance = {row["_seg"]: float(np.mean([row[c] for c in columns])) for row in spreads}
        models: dict[tuple[str, int, int], np.ndarray] = {}
        for seg, (sample, weight) in sorted(candidates(points, columns, key, max(ks), seed).items()):
            some = weight > 0
            sample, weight = sample[some], weight[some]
            for k in ks:
                seen = set()
                for restart in range(1 if k == 1 else restarts):
                    if k > len(sample):
                        continue
                    start = starting_points(sample, weight, k, np.random.default_rng([seed, k, restart]))
                    shape = np.round(start[np.lexsort(start.T[::-1])], 4).tobytes()
                    if shape not in seen:
                        seen.add(shape)
                        models[seg, k, restart] = start
        inertia, steps = dict.fromkeys(models, np.inf), dict.fromkeys(models, 0)
        paths = {model: Path() for model in models}
        active = set(models)
        for _ in range(max_steps):
            if not active:
                break
            sums = lloyd_sums(blocks, columns, {m: models[m] for m in active})
            for model in list(active):
                old, table = models[model], sums[model]
                new = moved(table, old)
                inertia[model] = float(table[:, 1].sum())
                steps[model] += 1
                if ((new - old) ** 2).sum() <= TOLERANCE * variance[model[0]]:
                    active.discard(model)  # the centres that the inertia was counted for stay
                else:
                    models[model] = paths[model].next(old, new, inertia[model])
        if active:
            for model, table in lloyd_sums(blocks, columns, {m: models[m] for m in active}).items():
                inertia[model] = float(table[:, 1].sum())
        best: dict[tuple[str, int], Clustering] = {}
        for model, centroids in models.items():
            seg, k, _ = model
            if (seg, k) not in best or inertia[model] < best[seg, k].inertia:
                order = np.lexsort(centroids.T[::-1])
                best[seg, k] = Clustering(centroids[order], inertia[model], steps[model], model not in active)
        return best
    finally:
        blocks.unpersist()
        if not held:
            points.unpersist()


class Path:
    """The last steps of a model, from which the next centres are extrapolated (Anderson 1965).

    A step that raised the inertia is taken back: the plain update of the centres before goes on instead.
    """

    MEMORY = 4

    def __init__(self):
        self.olds: list[np.ndarray] = []
        self.news: list[np.ndarray] = []
        self.least = np.inf

    def next(self, old: np.ndarray, new: np.ndarray, inertia: float) -> np.ndarray:
        """The centres to try after ``old``, whose update is ``new`` and whose inertia is known."""
        if inertia > self.least and self.news:
            plain = self.news[-1]
            self.olds, self.news, self.least = [], [], np.inf
            return plain.reshape(old.shape)
        self.least = inertia
        self.olds, self.news = [*self.olds, old.ravel()][-self.MEMORY :], [*self.news, new.ravel()][-self.MEMORY :]
        if len(self.olds) < 2:
            return new
        gaps = np.stack(self.news) - np.stack(self.olds)
        share = np.linalg.lstsq((gaps[1:] - gaps[:-1]).T, gaps[-1], rcond=1e-6)[0]
        return (self.news[-1] - share @ np.diff(np.stack(self.news), axis=0)).reshape(old.shape)


def moved(table: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The mean points of the sums of a pass; a cluster without rows keeps its centre."""
    counts = table[:, 0]
    return np.where(counts[:, None] > 0, table[:, 2:] / np.maximum(counts, 1)[:, None], centroids)


def steps_from(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], steps: int) -> DataFrame:
    """(label, n, columns, inertia) after ``steps`` updates from given centroids: the mean points, and the rows and
    squared distance counted in the last pass."""
    columns = list(columns)
    points = df.select(F.lit("all").alias("_seg"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    now = np.asarray(centroids, dtype=float)
    table = np.zeros((len(now), len(columns) + 2))
    for _ in range(steps):
        sums = lloyd_sums(points, columns, {("all", len(now), 0): now})
        table = sums.get(("all", len(now), 0), np.zeros_like(table))
        now = moved(table, now)
    rows = [(i, int(table[i, 0]), *map(float, now[i]), float(table[i, 1])) for i in range(len(now))]
    return df.sparkSession.createDataFrame(rows, f"label int, n long, {', '.join(f'`{c}` double' for c in columns)}, inertia double")


def lloyd_sums(points: DataFrame | Blocks, columns: list[str], models: dict) -> dict:
    """One pass: per model and cluster [rows, squared distance, sums of the columns].

    ``points`` is a table with ``_seg`` or its rows as ``Blocks`` of the columns, for fits that take many passes.
    """
    by_segment: dict[str, list] = {}
    for model, centroids in models.items():
        by_segment.setdefault(model[0], []).append((model, centroids))
    shared = Shared(points.sparkSession, by_segment)

    def sums(seg, x):
        rows = np.stack([np.ones(len(x)), np.zeros(len(x)), *x.T])
        for (_, k, restart), centroids in shared.value.get(seg, ()):
            label, rows[1] = nearest_centroid(x, centroids)
            yield (seg, k, restart), np.stack([np.bincount(label, weights=row, minlength=k) for row in rows], axis=1).ravel()

    def of_batch(batch):
        for seg, part in batch.groupby("_seg", sort=False):
            yield from sums(seg, matrix(part, columns))

    if isinstance(points, Blocks):
        table = points.sums(sums, sum(len(c) for c in models.values()) * (len(columns) + 2))
    else:
        table = collect_sums(sum_by_key(points.select("_seg", *columns), "_seg string, k int, restart int", of_batch))
    out = {key: v.reshape(key[1], len(columns) + 2) for key, v in table.items()}
    shared.unpersist()
    return out


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest centroids of each row, and the squared distance to it."""
    columns = np.ascontiguousarray(x.T)
    label, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for number, centre in enumerate(centroids):
        far = sum((column - value) ** 2 for column, value in zip(columns, centre))
        closer = far < least
        label[closer] = number
        np.minimum(least, far, out=least)
    return label, least


def mean_silhouettes(
    df: DataFrame, columns: Sequence[str], models: dict[tuple[str, int], Clustering], segment: str | None = None
) -> dict[tuple[str, int], float]:
    """{(segment, K): mean silhouette} of fitted clusterings with K >= 2, in two passes for all of them.

    Squared Euclidean, as ``silhouette_samples``: the first pass gives size, mean and spread of every
    cluster, the second adds up the values of the rows.
    """
    columns = list(columns)
    points = keyed(df, segment).select("_seg", *columns).na.drop()
    centroids = {(seg, k, 0): m.centroids for (seg, k), m in models.items() if k >= 2}
    shapes = {}
    for (seg, k, _), table in lloyd_sums(points, columns, centroids).items():
        n = table[:, 0]
        mean = table[:, 2:] / np.maximum(n, 1)[:, None]
        shift = ((mean - centroids[seg, k, 0]) ** 2).sum(axis=1)
        spread_of = table[:, 1] / np.maximum(n, 1) - shift
        shapes.setdefault(seg, []).append((k, centroids[seg, k, 0], n, mean, spread_of))
    shared = Shared(points.sparkSession, shapes)

    def sums(batch):
        for seg, part in batch.groupby("_seg", sort=False):
            x = matrix(part, columns)
            at = np.arange(len(x))
            for k, centres, n, mean, spread_of in shared.value.get(seg, ()):
                label = squared_distances(x, centres).argmin(axis=1)
                far = np.where(n > 0, squared_distances(x, mean) + spread_of, np.inf)
                own = n[label]
                a = far[at, label] * own / np.maximum(own - 1, 1)
                far[at, label] = np.inf
                b = far.min(axis=1)
                top = np.maximum(a, b)
                value = np.where((own > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0)
                yield (seg, k), np.array([len(x), value.sum()])

    totals = collect_sums(sum_by_key(points, "_seg string, k int", sums))
    shared.unpersist()
    return {key: float(total / n) for key, (n, total) in totals.items()}


def nearest(columns: Sequence[str], centroids: Sequence[Sequence[float]]) -> Column:
    """struct(sq_dist, label) of the nearest centroid as one expression: no join with the centroids."""
    options = []
    for label, centre in enumerate(centroids):
        squared = sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0))
        options.append(F.struct(squared.alias("sq_dist"), F.lit(label).alias("label")))
    return F.array_min(F.array(*options))


def assign(
    df: DataFrame,
    columns: Sequence[str],
    centroids: Sequence[Sequence[float]] | dict[str, Sequence[Sequence[float]]],
    segment: str | None = None,
) -> DataFrame:
    """Add ``label`` and ``sq_dist``; -1 and null for rows with nulls or in a segment without a model.

    Centroids of segments are a table that is joined, so the plan does not grow with the segments.
    """
    if segment is None:
        out = df.withColumn("_best", nearest(columns, centroids))
    else:
        rows = [(seg, [[float(v) for v in point] for point in points]) for seg, points in centroids.items()]
        table = df.sparkSession.createDataFrame(rows, "_of string, _centres array<array<double>>")

        def distance(centre, label):
            squared = sum(((F.col(c) - centre[j]) * (F.col(c) - centre[j]) for j, c in enumerate(columns)), F.lit(0.0))
            return F.struct(squared.alias("sq_dist"), label.alias("label"))

        joined = lookup_join(df.withColumn("_of", F.col(segment).cast("string")), table, ["_of"])
        out = joined.withColumn("_best", F.array_min(F.transform("_centres", distance))).drop("_of", "_centres")
    known = F.col("_best.sq_dist").isNotNull()
    return out.withColumns(
        {"label": F.when(known, F.col("_best.label")).otherwise(F.lit(-1)), "sq_dist": F.col("_best.sq_dist")}
    ).drop("_best")


def step(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """One update from given centroids: the new mean point of each label."""
    labelled = assign(df, columns, centroids).filter("label >= 0")
    return labelled.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def inertia(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total and mean squared distance per label (and group)."""
    return labelled.filter("label >= 0").groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.sum("sq_dist").alias("inertia"), F.avg("sq_dist").alias("inertia_per_point")
    )


def inertia_by_k(df: DataFrame, columns: Sequence[str], options: dict[int, Sequence[Sequence[float]]]) -> DataFrame:
    """(k, inertia) for several given sets of centroids in one pass."""
    row = df.agg(*[F.sum(nearest(columns, centroids)["sq_dist"]).alias(f"k{k}") for k, centroids in options.items()])
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("inertia")) for k in options])
    return row.select(F.explode(lines).alias("r")).select("r.*")


def silhouette_samples(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Silhouette of every row on squared Euclidean distance, in time linear in the rows.

    The mean squared distance of a point to a cluster follows from the cluster's row count, sums
    and sum of squares, so each row meets k numbers instead of all other rows. A row alone in its
    cluster gets 0.
    """
    rows = labelled.filter("label >= 0")
    sums = rows.groupBy(*keys, "label").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns]
    )
    spread = sum((F.col(f"v_{c}") for c in columns), F.lit(0.0))
    entry = F.struct("label", "n", spread.alias("spread"), *[f"m_{c}" for c in columns])
    lists = sums.groupBy(*keys).agg(F.collect_list(entry).alias("_clusters"))
    if keys:
        joined = lookup_join(rows, lists, list(keys), "inner", null_safe=True)
    else:
        joined = rows.withColumn("_clusters", lists.scalar())

    def mean_distance(s):
        return s["spread"] + sum(((F.col(c) - s[f"m_{c}"]) * (F.col(c) - s[f"m_{c}"]) for c in columns), F.lit(0.0))

    own = F.element_at(F.filter("_clusters", lambda s: s["label"] == F.col("label")), 1)
    others = F.filter("_clusters", lambda s: s["label"] != F.col("label"))
    joined = joined.withColumn("_own", own).withColumns(
        {
            "_a": mean_distance(F.col("_own")) * ratio("_own.n", F.col("_own.n") - 1),
            "_b": F.array_min(F.transform(others, mean_distance)),
        }
    )
    value = F.when(F.col("_own.n") > 1, ratio(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))).otherwise(F.lit(0.0))
    return joined.withColumn("silhouette", F.when(F.col("_b").isNotNull(), F.coalesce(value, F.lit(0.0)))).drop(
        "_clusters", "_own", "_a", "_b"
    )


def silhouette_by_cluster(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return samples.groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"), F.stddev_pop("silhouette").alias("silhouette_std")
    )


def silhouette_by_k(
    df: DataFrame, columns: Sequence[str], options: dict[int, Sequence[Sequence[float]]]
) -> DataFrame:
    """(k, silhouette) of several given sets of centroids: one labelled copy of the rows per K."""
    copies = F.array(
        *[F.struct(F.lit(k).alias("k"), nearest(columns, points)["label"].alias("label")) for k, points in options.items()]
    )
    labelled = df.select(*columns, F.explode(copies).alias("_l")).select(*columns, "_l.k", "_l.label")
    return silhouette_samples(labelled, columns, ["k"]).groupBy("k").agg(F.avg("silhouette").alias("silhouette"))


def best_k(by_k: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The K with the highest mean silhouette, the smallest on ties."""
    return by_k.groupBy(*keys).agg(
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"), F.max("silhouette").alias("silhouette")
    )

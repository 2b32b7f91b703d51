"""Clustering: deterministic parts from given centroids, and complete fits."""

from pyspark.sql import functions as F

from worthline.catalog.registry import query, r
from worthline.catalog.shape_queries import p
from worthline.operators import cluster_rules, kmeans, svr
from worthline.operators.split import key_hash_sql
from worthline.plans import cluster_models
from worthline.plans.clustering import cluster_segments
from worthline.plans.entities import entities
from worthline.session import written

# Two columns on a common scale; fixed centroids on the diagonal, K of them spread over -2 .. 2.
Z = """z as (select entity_id, segment, raw_value, f_acctbal, (raw_value - 250000) / 145000 x, (f_acctbal - 4500) / 3200 y from entities)"""
COLUMNS = ["x", "y"]


def centre(k, i):
    return -2 + 4 * (i + 0.5) / k


def diagonal(k):
    return [[centre(k, i), centre(k, i)] for i in range(k)]


def points(spark, folder):
    return p(spark, folder).select(
        "entity_id", "segment", "raw_value", "f_acctbal", ((F.col("raw_value") - 250000) / 145000).alias("x"), ((F.col("f_acctbal") - 4500) / 3200).alias("y")
    )


def centres_sql(k):
    return f"c{k} as (select i as label, -2 + 4 * (i + 0.5) / {k} as c from range({k}) t(i))"


ASSIGNED = f"""{Z}, {centres_sql(4)},
 d as (select z.*, label, (x - c)^2 + (y - c)^2 sq_dist from z, c4),
 a as (select entity_id, segment, raw_value, f_acctbal, any_value(x) x, any_value(y) y, arg_min(label, sq_dist)::int as label, min(sq_dist) sq_dist from d group by entity_id, segment, raw_value, f_acctbal)"""


def assigned(spark, folder):
    return kmeans.assign(points(spark, folder), COLUMNS, diagonal(4))


@query("kmeans_assign", f"with {ASSIGNED} select entity_id, label, round(sq_dist, 6) + 0.0 sq_dist from a")
def _(spark, folder):
    return assigned(spark, folder).select("entity_id", "label", r("sq_dist", 6).alias("sq_dist"))


@query("kmeans_step", f"with {ASSIGNED} select label, count(*) n, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y from a group by label")
def _(spark, folder):
    df = kmeans.step(points(spark, folder), COLUMNS, diagonal(4))
    return df.select("label", "n", r("x", 6).alias("x"), r("y", 6).alias("y"))


# Three updates unrolled: each assigns every row to the centres of the one before.
STEPS = f"""{Z}, {centres_sql(4)}, k0 as (select label, c as cx, c as cy from c4), """ + ", ".join(
    f"""s{i} as (select z.x, z.y, arg_min(label, (x - cx)^2 + (y - cy)^2)::int as label, min((x - cx)^2 + (y - cy)^2) d from z, k{i - 1} group by entity_id, x, y),
 k{i} as (select label, count(*) n, avg(x) cx, avg(y) cy, sum(d) inertia from s{i} group by label)"""
    for i in (1, 2, 3)
)


@query("kmeans_lloyd_steps", f"with {STEPS} select label, n, round(cx, 6) + 0.0 x, round(cy, 6) + 0.0 y, round(inertia, 3) + 0.0 inertia from k3")
def _(spark, folder):
    df = kmeans.steps_from(points(spark, folder), COLUMNS, diagonal(4), 3)
    return df.select("label", "n", r("x", 6).alias("x"), r("y", 6).alias("y"), r("inertia", 3).alias("inertia"))


@query(
    "inertia",
    f"with {ASSIGNED} select label, count(*) n, round(sum(sq_dist), 4) + 0.0 inertia, round(avg(sq_dist), 6) + 0.0 inertia_per_point from a group by label",
)
def _(spark, folder):
    df = kmeans.inertia(assigned(spark, folder))
    return df.select("label", "n", r("inertia").alias("inertia"), r("inertia_per_point", 6).alias("inertia_per_point"))


INERTIA = f"""{Z}, c as (select k, i as label, -2 + 4 * (i + 0.5) / k as c from range(1, 11) t(k), range(10) u(i) where i < k),
 n as (select entity_id, k, min((x - c)^2 + (y - c)^2) d from z, c group by entity_id, k),
 inertia as (select k::int k, sum(d) inertia from n group by k)"""


def inertia_table(spark, folder):
    return kmeans.inertia_by_k(points(spark, folder), COLUMNS, {k: diagonal(k) for k in range(1, 11)})


@query("inertia_by_k", f"with {INERTIA} select k, round(inertia, 4) + 0.0 inertia from inertia")
def _(spark, folder):
    return inertia_table(spark, folder).select("k", r("inertia").alias("inertia"))


@query(
    "second_difference",
    f"""with {INERTIA} select k, round(lead(inertia, 1) over (order by k) - inertia, 3) + 0.0 diff1,
    round(lead(inertia, 2) over (order by k) - 2 * lead(inertia, 1) over (order by k) + inertia, 3) + 0.0 diff2 from inertia""",
)
def _(spark, folder):
    df = cluster_rules.second_difference(inertia_table(spark, folder))
    return df.select("k", r("diff1", 3).alias("diff1"), r("diff2", 3).alias("diff2"))


ELBOW = f"""{INERTIA}, ends as (select min(k) x1, max(k) x2, arg_min(inertia, k) y1, arg_max(inertia, k) y2 from inertia),
 l as (select k, abs((y2 - y1) * k - (x2 - x1) * inertia + x2 * y1 - y2 * x1) / sqrt((y2 - y1)^2 + (x2 - x1)^2) distance,
   lead(inertia, 2) over (order by k) - 2 * lead(inertia, 1) over (order by k) + inertia d2 from inertia, ends),
 b as (select arg_max(k, distance) k_line, max(distance) distance, arg_max(k, d2) filter (d2 is not null) + 2 k_bend from l),
 elbow as (select case when abs(k_line - k_bend) > 1 then least(k_line, k_bend) else k_line end::int k, distance from b)"""


@query("elbow_k", f"with {ELBOW} select k, round(distance, 4) + 0.0 distance from elbow")
def _(spark, folder):
    return cluster_rules.elbow_k(inertia_table(spark, folder)).select("k", r("distance").alias("distance"))


@query("choose_k", f"with {ELBOW} select least(greatest(k, 2), least(10, floor((select count(*) from orders) / 5)))::int k from elbow")
def _(spark, folder):
    elbow = cluster_rules.elbow_k(inertia_table(spark, folder))
    n = points(spark, folder).agg(F.count("*")).scalar()
    return elbow.select(cluster_rules.choose_k(F.col("k"), cluster_rules.largest_k(n)).cast("int").alias("k"))


SILHOUETTE = f"""{ASSIGNED}, g as (select label, count(*) n, avg(x) mx, avg(y) my, var_pop(x) + var_pop(y) sp from a group by label),
 md as (select a.entity_id, a.label, g.label other, g.n, g.sp + (a.x - g.mx)^2 + (a.y - g.my)^2 d from a, g),
 ab as (select entity_id, label, max(d * n / (n - 1)) filter (other = label and n > 1) a, min(d) filter (other <> label) b from md group by entity_id, label),
 sil as (select entity_id, label, (b - a) / greatest(a, b) silhouette from ab)"""


@query("silhouette_samples", f"with {SILHOUETTE} select entity_id, label, round(silhouette, 6) + 0.0 silhouette from sil")
def _(spark, folder):
    df = kmeans.silhouette_samples(assigned(spark, folder), COLUMNS)
    return df.select("entity_id", "label", r("silhouette", 6).alias("silhouette"))


@query(
    "silhouette_by_cluster",
    f"with {SILHOUETTE} select label, count(*) n, round(avg(silhouette), 6) + 0.0 silhouette, round(stddev_pop(silhouette), 6) + 0.0 silhouette_std from sil group by label",
)
def _(spark, folder):
    df = kmeans.silhouette_by_cluster(kmeans.silhouette_samples(assigned(spark, folder), COLUMNS))
    return df.select("label", "n", r("silhouette", 6).alias("silhouette"), r("silhouette_std", 6).alias("silhouette_std"))


BY_K = f"""{Z}, c as (select k, i as label, -2 + 4 * (i + 0.5) / k as c from range(2, 7) t(k), range(6) u(i) where i < k),
 a as (select entity_id, k, any_value(x) x, any_value(y) y, arg_min(label, (x - c)^2 + (y - c)^2) as label from z, c group by entity_id, k),
 g as (select k, label, count(*) n, avg(x) mx, avg(y) my, var_pop(x) + var_pop(y) sp from a group by k, label),
 md as (select a.entity_id, a.k, a.label, g.label other, g.n, g.sp + (a.x - g.mx)^2 + (a.y - g.my)^2 d from a join g on a.k = g.k),
 ab as (select entity_id, k, label, max(d * n / (n - 1)) filter (other = label and n > 1) a, min(d) filter (other <> label) b from md group by entity_id, k, label),
 byk as (select k::int k, avg((b - a) / greatest(a, b)) silhouette from ab group by k)"""


@query("silhouette_by_k", f"with {BY_K} select k, round(silhouette, 6) + 0.0 silhouette from byk")
def _(spark, folder):
    df = kmeans.silhouette_by_k(points(spark, folder), COLUMNS, {k: diagonal(k) for k in range(2, 7)})
    return df.select("k", r("silhouette", 6).alias("silhouette"))


@query("best_k", f"with {BY_K} select arg_max(k, silhouette) k, round(max(silhouette), 6) + 0.0 silhouette from byk")
def _(spark, folder):
    df = kmeans.best_k(kmeans.silhouette_by_k(points(spark, folder), COLUMNS, {k: diagonal(k) for k in range(2, 7)}))
    return df.select("k", r("silhouette", 6).alias("silhouette"))


@query(
    "cluster_quality",
    f"""with {SILHOUETTE}, q as (select label, avg(silhouette) s from sil group by label),
    n as (select count(*) k, count(*) filter (s >= 0.5) good, count(*) filter (s >= 0.25 and s < 0.5) fair, count(*) filter (s < 0.25) poor from q)
    select *, case when poor = 0 and good >= k // 2 then 'EXCELENTE' when poor <= k // 4 then 'BUENA' when poor <= k // 2 then 'REGULAR' else 'POBRE' end overall from n""",
)
def _(spark, folder):
    per_cluster = kmeans.silhouette_by_cluster(kmeans.silhouette_samples(assigned(spark, folder), COLUMNS))
    return cluster_rules.cluster_quality(per_cluster)


@query(
    "centroid_pairs",
    """with g as (select segment, grp % 6 grp, avg((raw_value - 250000) / 145000) x, avg((f_acctbal - 4500) / 3200) y from entities group by segment, grp % 6),
    d as (select a.segment, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) d from g a join g b on a.segment = b.segment and a.grp < b.grp)
    select segment, round(min(d), 6) + 0.0 min_distance, round(max(d), 6) + 0.0 max_distance, round(max(d) / min(d), 4) + 0.0 separation from d group by segment""",
)
def _(spark, folder):
    df = p(spark, folder).select("segment", (F.col("grp") % 6).alias("label"), ((F.col("raw_value") - 250000) / 145000).alias("x"), ((F.col("f_acctbal") - 4500) / 3200).alias("y"))
    centroids = df.groupBy("segment", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    out = cluster_rules.centroid_pairs(centroids, ["x", "y"], keys=["segment"])
    return out.select("segment", r("min_distance", 6).alias("min_distance"), r("max_distance", 6).alias("max_distance"), r("separation").alias("separation"))


@query(
    "cluster_report",
    f"""with {ASSIGNED}, g as (select segment, label, count(*) n, round(avg(raw_value), 3) + 0.0 raw_value_mean, round(median(raw_value), 3) + 0.0 raw_value_median,
      round(avg(f_acctbal), 3) + 0.0 f_acctbal_mean, round(median(f_acctbal), 3) + 0.0 f_acctbal_median, avg(x) x, avg(y) y from a group by segment, label),
    far as (select a.segment, sqrt((a.x - b.x)^2 + (a.y - b.y)^2) d from g a join g b on a.segment = b.segment and a.label < b.label),
    m as (select segment, round(min(d), 5) + 0.0 min_distance, round(max(d), 5) + 0.0 max_distance, round(max(d) / min(d), 4) + 0.0 separation from far group by segment)
    select g.* exclude (x, y), m.* exclude (segment) from g join m using (segment)""",
)
def _(spark, folder):
    clusters, distances = cluster_models.cluster_report(assigned(spark, folder), "segment", ["raw_value", "f_acctbal"], scaled=COLUMNS)
    means = [f"{c}_{m}" for c in ("raw_value", "f_acctbal") for m in ("mean", "median")]
    far = [r("min_distance", 5).alias("min_distance"), r("max_distance", 5).alias("max_distance"), r("separation").alias("separation")]
    return clusters.join(distances, "segment").select("segment", "label", "n", *[r(c, 3).alias(c) for c in means], *far)


# A cluster's split follows its size; its medians come from its training rows; least squares on one feature.
CLUSTER_MODELS = f"""{ASSIGNED}, l as (select a.entity_id, a.segment, a.label, e.f_qty, e.value from a join entities e using (entity_id)),
 n as (select segment, label, count(*) n, round(least(0.25, greatest(0.1, 5.0 / count(*))) * 1000) cut from l group by segment, label),
 sp as (select l.*, n.n, case when {key_hash_sql("entity_id", 42, 1000)} >= cut then 'train' else 'test' end split from l join n using (segment, label)),
 md as (select segment, label, median(f_qty) q from sp where split = 'train' group by segment, label),
 f as (select sp.* exclude (f_qty), coalesce(f_qty, q) f_qty from sp join md using (segment, label)),
 m as (select segment, label, regr_slope(value, f_qty) b, regr_intercept(value, f_qty) a from f where split = 'train' group by segment, label),
 guard as (select segment, label from sp group by segment, label having count(*) >= 10 and count(*) filter (split = 'test') >= 2),
 s as (select f.*, a + b * f_qty guess from f join guard using (segment, label) join m using (segment, label))"""


def fixed_clusters(spark, folder):
    lines = entities(spark, folder).select("entity_id", "f_qty", "value")
    return assigned(spark, folder).select("entity_id", "segment", "label").join(lines, "entity_id")


@query("cluster_models_scores", f"with {CLUSTER_MODELS} select l.entity_id, l.segment, l.label, round(guess, 3) + 0.0 guess from l left join s on s.entity_id = l.entity_id")
def _(spark, folder):
    done = cluster_models.fit_clusters(fixed_clusters(spark, folder), ["f_qty"], "value", "entity_id", "segment", kind="linear")
    return done.scored.select("entity_id", "segment", "label", r("predicted", 3).alias("guess"))


@query(
    "cluster_models_summary",
    f"""with {CLUSTER_MODELS}, t as (select segment, label, split, count(*) n, 1 - avg((value - guess)^2) / var_pop(value) r2, avg(abs(value - guess)) mae from s group by segment, label, split)
    select segment, label as cluster, sum(n)::bigint n, 1 n_features, sum(n) filter (split = 'test')::bigint test_n, round(max(r2) filter (split = 'train'), 6) + 0.0 train_r2,
      round(max(r2) filter (split = 'test'), 6) + 0.0 test_r2, round(max(mae) filter (split = 'test'), 3) + 0.0 test_mae from t group by segment, label""",
)
def _(spark, folder):
    done = cluster_models.fit_clusters(fixed_clusters(spark, folder), ["f_qty"], "value", "entity_id", "segment", kind="linear")
    return done.summary.select("segment", "cluster", "n", "n_features", "test_n", r("train_r2", 6).alias("train_r2"), r("test_r2", 6).alias("test_r2"), r("test_mae", 3).alias("test_mae"))


def found_clusters(spark, folder):
    """Entities with the clusters of a complete fit."""
    columns = ["entity_id", "segment", "value", "f_acctbal", "f_qty", "f_disc", "f_tax", "f_lines", "raw_value"]
    df = written(entities(spark, folder).select(*[F.col(c).cast("double").alias(c) if c[:2] == "f_" else c for c in columns]), "clustering")
    labels = cluster_segments(df, ["value", "f_acctbal"], "entity_id", "segment", most=5, restarts=3).labelled
    return cluster_models.attach_labels(df, labels, "entity_id")


@query("cluster_models_trees")
def _(spark, folder):
    inputs = ["f_qty", "f_disc", "f_tax", "f_lines", "raw_value"]
    return cluster_models.fit_clusters(found_clusters(spark, folder), inputs, "value", "entity_id", "segment", kind="trees").summary.drop("parameters")


@query("cluster_models_kernel")
def _(spark, folder):
    inputs = ["f_qty", "f_disc", "f_tax", "f_lines", "raw_value"]
    params = svr.Params(kernel="rbf", C=10.0, epsilon=0.05, gamma=0.05)
    return cluster_models.fit_clusters(found_clusters(spark, folder), inputs, "value", "entity_id", "segment", kind="kernel", params=params).summary.drop("parameters")


@query("kmeans_fit")
def _(spark, folder):
    df = points(spark, folder)
    models = kmeans.fit_many(df, COLUMNS, "entity_id", [4], "segment")
    labelled = kmeans.assign(df, COLUMNS, {seg: m.centroids for (seg, _), m in models.items()}, "segment")
    return kmeans.inertia(labelled, ["segment"])


@query("clustering_summary")
def _(spark, folder):
    df = written(entities(spark, folder).select("entity_id", "segment", "value", "f_acctbal"), "clustering")
    return cluster_segments(df, ["value", "f_acctbal"], "entity_id", "segment").summary

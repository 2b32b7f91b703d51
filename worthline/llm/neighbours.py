"""Approximate nearest neighbours by adaptive dimension scan over an inverted file (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthline.llm.common import hash_share
from worthline.operators.partials import Shared
from worthline.session import written

#: Vectors that the list centres are fitted on, and steps of the fit.
FIT_ROWS, FIT_STEPS = 8192, 8
#: Lists per square root of the number of vectors, and the most lists (they are sent to every task).
LISTS_PER_ROOT, MOST_LISTS = 2.0, 16384
#: Share of the lists that each query probes. On vectors without clusters (the given tables are nearly so)
#: this share of the lists holds 97 % of the neighbours; clustered vectors need far fewer.
PROBED = 0.6
#: A query probes further lists until they hold this many vectors for each neighbour asked for, or all.
LEAST_SCANNED = 20
#: Columns read at a time, and how sure a test must be to abandon a candidate.
BLOCK, SURENESS = 16, 2.1
#: Vectors that one group of a task holds: short lists are put together, long ones are split.
CHUNK = 4096
#: Queries that meet a group in one task.
QUERY_CHUNK = 8192


@dataclass
class Lists:
    """Centres in the rotated space, the rotation, and the norm that all vectors are padded to."""

    centres: np.ndarray
    rotation: np.ndarray
    norm: float

    def rotated(self, vectors: np.ndarray, pad: bool) -> np.ndarray:
        """Vectors with one more component, rotated.

        The component brings every stored vector to the same norm, so that the nearest by distance is
        the one with the largest inner product; for a query it is zero.
        """
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0.0)) if pad else np.zeros(len(vectors))
        return np.column_stack([vectors, rest]) @ self.rotation


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and holds no null or non-finite component."""
    source = df.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return source.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).filter(
        F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)
    )


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def fit_lists(vectors: DataFrame, seed: int = 11) -> Lists | None:
    """Centres by K-means over a sample of about ``FIT_ROWS`` vectors, chosen by a hash of the vector.

    The number of lists follows the square root of the number of vectors.
    """
    facts = vectors.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")
    ).first()
    if not facts["n"]:
        return None
    sample = vectors.filter(hash_share("vector") * float(facts["n"]) < float(FIT_ROWS)).select("vector").collect()
    random = np.random.default_rng(seed)
    width = facts["width"] + 1
    rotation, _ = np.linalg.qr(random.standard_normal((width, width)))
    lists = Lists(np.zeros((1, width)), rotation, float(np.sqrt(facts["square"])))
    points = np.unique(lists.rotated(_stack([r["vector"] for r in sample]), True), axis=0) if sample else np.zeros((1, width))
    k = int(min(max(1, round(LISTS_PER_ROOT * facts["n"] ** 0.5)), MOST_LISTS, len(points)))
    centres = points[random.permutation(len(points))[:k]]
    for _ in range(FIT_STEPS):
        home = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        sizes = np.bincount(home, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    lists.centres = centres
    return lists


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres**2).sum(axis=1)
    return np.concatenate(
        [np.argmin(squares - 2 * points[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(points), 1024)]
    )


class Columns:
    """Stored vectors in blocks of columns, with the squared norm of each part."""

    def __init__(self, stored: np.ndarray):
        self.width = stored.shape[1]
        self.blocks = [(i, min(i + BLOCK, self.width)) for i in range(0, self.width, BLOCK)]
        self.parts = [np.ascontiguousarray(stored[:, a:b]) for a, b in self.blocks]
        self.squares = [(c**2).sum(axis=1) for c in self.parts]

    def added(self, block: int, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What a block of columns adds to the squared distances of some vectors."""
        a, b = self.blocks[block]
        return self.squares[block][places] - 2.0 * (self.parts[block][places] @ q[a:b]) + q[a:b] @ q[a:b]


def scan(columns: Columns, q: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """At least the ``k`` nearest to ``q`` among ``places`` (nearest list first), by adaptive dimension scan.

    The first few are read whole and give a distance to beat. The others are summed block by block;
    after each block a candidate is abandoned if the lower confidence limit of its whole distance,
    estimated from the columns read so far, lies above the distance of the ``k``-th best known. By the
    rotation the columns read are a random sample of all directions.
    """
    first = max(4 * k, 64)
    head, alive = places[:first], places[first:]
    begun = sum(columns.added(i, head, q) for i in range(len(columns.blocks)))
    if not len(alive):
        return head
    bar = np.partition(begun, k - 1)[k - 1]
    partial = np.zeros(len(alive))
    for i, (_, b) in enumerate(columns.blocks):
        partial += columns.added(i, alive, q)
        if b < columns.width:
            keep = partial <= bar * (b / columns.width) * (1.0 + SURENESS / np.sqrt(b)) ** 2
            alive, partial = alive[keep], partial[keep]
    distances = np.concatenate([begun, partial])
    bar = np.partition(distances, k - 1)[k - 1]
    # a margin for rounding: the exact scores decide
    return np.concatenate([head, alive])[distances <= bar + 1e-9 * (1.0 + abs(bar))]


def groups_of(sizes: dict[int, int], n_lists: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first group and its number of groups, so that no group holds much over ``chunk`` vectors."""
    first, count = np.zeros(n_lists, dtype=np.int32), np.ones(n_lists, dtype=np.int32)
    group, room = 0, chunk
    for i in range(n_lists):
        n = sizes.get(i, 0)
        if n > room:
            group, room = group + 1, chunk
        if n > chunk:
            count[i] = -(-n // chunk)
        first[i] = group
        group += int(count[i]) - 1
        room -= n
        if count[i] > 1:
            group, room = group + 1, chunk
    return first, count


def nearest(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", probed: float = PROBED) -> DataFrame:
    """The ``k`` stored vectors with the largest inner product to each query, nearest first.

    Returns query_id, rank (from 1), vec_id, score (the inner product of the original vectors in
    double precision); ties go to the smaller vec_id. ``is_query`` is a condition on ``vec_id``.
    Queries find every row but their own; all candidates if fewer than ``k``. Null, zero and
    non-finite vectors take no part; vectors of another length than the longest take no part either;
    rows with a null key take no part. An empty table gives an empty result.

    Equal vectors are stored once, with their ``k + 1`` smallest ids: no other copy can be among the
    first ``k`` of any query, as all copies tie. Lists are packed into groups of about ``CHUNK``
    vectors, long ones split over several, and each query goes once to every group that holds a list
    it probes, so no group is too long for a task; with very many queries a group is
    met by ``QUERY_CHUNK`` of them at a time.
    """
    spark = df.sparkSession
    vectors = usable(df, key, vector).filter(F.col("vec_id").isNotNull())
    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if width is None:
        return spark.createDataFrame([], empty)
    vectors = vectors.filter(F.size("vector") == width)
    lists = fit_lists(vectors)
    shared = Shared(spark, lists)
    n_lists = len(lists.centres)

    copies = Window.partitionBy("vector").orderBy("vec_id")
    ids = F.sort_array(F.collect_list("vec_id")).alias("ids")
    distinct = vectors.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).groupBy("vector").agg(ids)

    def place(batches):
        own = shared.value
        for batch in batches:
            if len(batch):
                points = own.rotated(_stack(batch["vector"]), True)
                yield batch.assign(list=_nearest(points, own.centres).astype(np.int32), turned=list(points))

    stored = distinct.mapInPandas(place, f"vector array<double>, ids array<{kind}>, list int, turned array<double>")
    stored = written(stored, "stored")
    # at most MOST_LISTS numbers
    sizes = {r["list"]: r["n"] for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    first_group, n_groups = groups_of(sizes, n_lists, CHUNK)
    layout = F.broadcast(
        spark.createDataFrame([(i, int(first_group[i]), int(n_groups[i])) for i in range(n_lists)], "list int, first int, chunks int")
    )
    group = (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("chunks"))).cast("int").alias("group")
    turns = max(1, -(-vectors.filter(is_query).count() // QUERY_CHUNK))
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    stored = stored.join(layout, "list").select(group, "list", "vector", "ids", "turned").select("*", turn)
    n_probed = max(1, int(np.ceil(probed * n_lists)))
    held = np.array([sizes.get(i, 0) for i in range(n_lists)])

    def probe(batches):
        own = shared.value
        squares = (own.centres**2).sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            gaps = squares - 2 * own.rotated(_stack(batch["vector"]), False) @ own.centres.T
            best = np.argsort(gaps, axis=1, kind="stable").astype(np.int32)
            out = []
            for query_id, vector_, lists_ in zip(batch["vec_id"].tolist(), batch["vector"], best):
                in_groups: dict[int, list[int]] = {}
                enough = int(np.searchsorted(np.cumsum(held[lists_]), LEAST_SCANNED * k)) + 1
                for i in lists_[: max(n_probed, enough)].tolist():
                    for g in range(first_group[i], first_group[i] + n_groups[i]):
                        in_groups.setdefault(g, []).append(i)
                out += [(g, query_id, vector_, members) for g, members in in_groups.items()]
            yield pd.DataFrame(out, columns=["group", "query_id", "vector", "lists"])

    asked = vectors.filter(is_query).mapInPandas(probe, f"group int, query_id {kind}, vector array<double>, lists array<int>")

    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))

    def search(keys, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = shared.value
        theirs = theirs.sort_values("list", kind="stable")
        lists_ = theirs["list"].to_numpy()
        starts = {i: (int(np.searchsorted(lists_, i)), int(np.searchsorted(lists_, i, side="right"))) for i in set(lists_.tolist())}
        originals, ids_ = _stack(theirs["vector"]), theirs["ids"].to_numpy()
        columns = Columns(_stack(theirs["turned"]))
        queries = _stack(mine["vector"])
        out = []
        for query_id, q, turned, probes in zip(mine["query_id"].tolist(), queries, own.rotated(queries, False), mine["lists"]):
            ranges = [np.arange(*starts[i]) for i in probes if i in starts]
            if not ranges:
                continue
            places = scan(columns, turned, np.concatenate(ranges), k + 1)
            scores = (originals[places] * q).sum(axis=1)
            rows = [(-s, i) for s, p in zip(scores.tolist(), places.tolist()) for i in ids_[p] if i != query_id]
            rows.sort()
            out += [(query_id, i, -s) for s, i in rows[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = asked.groupBy("group", "turn").cogroup(stored.groupBy("group", "turn"))
    found = pairs.applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

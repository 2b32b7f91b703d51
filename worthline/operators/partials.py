"""Sums of numpy vectors over a distributed table: the one shape all iterative fits share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from worthline.operators.lookup import lookup_join

FLUSH_KEYS = 2_000
#: Rows of a matrix of ``Blocks``, and rows that a task holds while it packs them.
BLOCK_ROWS, PACKED_ROWS = 2048, 1 << 18
#: Numbers that all tasks of a pass may send to the driver together (32 MB).
DIRECT_NUMBERS = 4_000_000


def sum_by_key(
    df: DataFrame, key_schema: str, function: Callable[[pd.DataFrame], Iterable[tuple[tuple, np.ndarray]]]
) -> DataFrame:
    """``function`` maps a batch to (key, vector) pairs; the result is one summed vector per key.

    Each task adds up its own batches and sends one row per key, so what is shuffled depends on
    the number of keys and tasks and not on the number of rows.
    """
    names = [part.split()[0] for part in key_schema.split(",")]

    def frame(sums: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(sums), columns=names)
        out["sums"] = [v.ravel() for v in sums.values()]
        return out

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for key, vector in function(batch):
                if key in sums:
                    sums[key] = sums[key] + vector
                else:
                    sums[key] = vector
            if len(sums) > FLUSH_KEYS:
                yield frame(sums)
                sums = {}
        if sums:
            yield frame(sums)

    partial = df.mapInPandas(run, f"{key_schema}, sums array<double>")
    total = Summarizer.sum(array_to_vector("sums"))
    return partial.groupBy(*names).agg(vector_to_array(total).alias("sums"))


def collect_sums(df: DataFrame) -> dict[tuple, np.ndarray]:
    """The summed vectors on the driver, keyed by the key columns."""
    return {tuple(row)[:-1]: np.asarray(row["sums"]) for row in df.collect()}


class Blocks:
    """The rows of a table as matrices of its columns, each of one segment ``_seg``, held in memory and on disk.

    Fits that read their rows in many passes meet no row one by one: a task takes the matrices as they lie. A matrix
    has at most ``BLOCK_ROWS`` rows, so what is computed from it stays in the cache of a core, and a task holds few.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        columns, width = list(columns), len(columns)

        def pack(batches):
            held: dict = {}
            for batch in batches:
                for seg, part in batch.groupby("_seg", sort=False):
                    held.setdefault(seg, []).append(matrix(part, columns))
                everything = sum(len(x) for parts in held.values() for x in parts) > PACKED_ROWS
                out = []
                for seg, parts in list(held.items()):
                    x = np.concatenate(held.pop(seg))
                    whole = len(x) if everything else len(x) // BLOCK_ROWS * BLOCK_ROWS
                    out += [(seg, x[i : min(i + BLOCK_ROWS, whole)].tobytes()) for i in range(0, whole, BLOCK_ROWS)]
                    if whole < len(x):
                        held[seg] = [x[whole:]]
                if out:
                    yield pd.DataFrame(out, columns=["_seg", "block"])
            if held:
                yield pd.DataFrame([(seg, x.tobytes()) for seg, parts in held.items() for x in parts], columns=["_seg", "block"])

        self.sparkSession = df.sparkSession
        packed = df.select("_seg", *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(pack, "_seg string, block binary")
        self.rdd = packed.rdd.map(lambda row: (row[0], np.frombuffer(row[1]).reshape(-1, width))).persist(StorageLevel.MEMORY_AND_DISK)
        self.partitions = self.rdd.getNumPartitions()

    def sums(self, function: Callable[[str, np.ndarray], Iterable[tuple[tuple, np.ndarray]]], numbers: int) -> dict[tuple, np.ndarray]:
        """The summed vectors of every key, in one pass; ``function`` maps a segment and its matrix to (key, vector) pairs.

        ``numbers`` tells how many a task sends. If those of all tasks are few, they come to the driver as they
        are and are added there, which saves a shuffle.
        """

        def run(blocks):
            sums: dict = {}
            for seg, rows in blocks:
                for key, vector in function(seg, rows):
                    if key in sums:
                        sums[key] += vector
                    else:
                        sums[key] = np.array(vector, dtype=float)
            return iter(sums.items())

        parts = self.rdd.mapPartitions(run)
        if numbers * self.partitions > DIRECT_NUMBERS:
            return dict(parts.reduceByKey(np.add).collect())
        total: dict = {}
        for key, vector in parts.collect():
            total[key] = total[key] + vector if key in total else vector
        return total

    def unpersist(self):
        self.rdd.unpersist()


class Shared:
    """A broadcast of objects whose classes the executors need not have installed."""

    def __init__(self, spark, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.opened = None

    def __getstate__(self):
        return {"packed": self.packed, "opened": None}

    @property
    def value(self):
        if self.opened is None:
            self.opened = cloudpickle.loads(self.packed.value)
        return self.opened

    def unpersist(self):
        self.packed.unpersist()


def matrix(batch: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(dtype=float) for c in columns])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows evenly over the cores, for fits that read them often: a partition for each core, or two where the session
    plans for that many.

    Without this a table of a few compact partitions would keep most cores idle in every pass. Every task of a
    pass sends the sums of all models, so more tasks than that would only add to what is sent.
    """
    spark = df.sparkSession
    planned, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(planned, 2 * cores)), key)


def keyed(df: DataFrame, segment: str | None) -> DataFrame:
    """Add the model key ``_seg``: the segment as text, or one constant for a global model."""
    return df.withColumn("_seg", F.col(segment).cast("string") if segment else F.lit("all"))


def hashed_samples(df: DataFrame, columns: list[str], key: str, rows: int, seed: int = 77) -> dict[str, np.ndarray]:
    """About ``rows`` points per segment ``_seg``, chosen by a hash of the key: starting points and
    landmarks for fits that then read every row."""
    sizes = df.groupBy("_seg").agg(F.count("*").alias("_n"))
    picked = lookup_join(df.select("_seg", key, *columns), sizes, ["_seg"], "inner").filter(in_sample(key, seed, rows))
    frame = picked.drop("_n").toPandas().sort_values(key)
    samples = {seg: matrix(part, list(columns)) for seg, part in frame.groupby("_seg")}
    missed = sizes.filter(F.col("_seg").isNotNull() & ~F.col("_seg").isin(list(samples))).limit(1).collect()
    if missed:
        raise ValueError(f"no row of the segment {missed[0]['_seg']} is in the sample")
    return samples


def in_sample(key: str, seed: int, rows: int):
    """Whether a row of a group of ``_n`` rows is among about ``rows`` of them: exact for any ``_n``."""
    share = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / float(2**53)
    return share * F.col("_n") < float(rows)

"""Mixing sources to target weights by Pfair scheduling (operator 7)."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.operators.lookup import lookup_join
from worthline.operators.ordering import number_rows

#: Rows of a block, slots of a frame (weights are rounded to this many parts), and slots per source at least.
BLOCK_ROWS, FRAME_SLOTS, SLOTS_PER_SOURCE = 100, 10_000, 20


def shares_of(weights: Mapping, slots: int) -> dict:
    """Whole numbers in proportion to the weights that add up to ``slots``, at least 1 each (largest remainder)."""
    total = float(sum(weights.values()))
    names = sorted(weights, key=lambda s: (s is None, s))
    exact = {s: weights[s] / total * slots for s in names}
    shares = {s: max(1, int(exact[s])) for s in names}
    left = slots - sum(shares.values())
    for s in sorted(names, key=lambda s: shares[s] - exact[s])[: max(left, 0)]:
        shares[s] += 1
    while (over := sum(shares.values()) - slots) > 0:
        largest = max(names, key=lambda s: shares[s])
        shares[largest] -= min(over, shares[largest] - 1)
    return shares


def frame_of(shares: Mapping) -> dict:
    """The slots of each source in one frame.

    Block j (from 1) of a source with share a of n slots is released at slot floor((j-1)n/a) and due
    by slot ceil(jn/a). Each slot goes to the released block with the earliest deadline. As the
    shares fill the frame, every block meets its deadline, so after any number of slots t every
    source has had more than t*a/n - 1 and fewer than t*a/n + 1 of them; at the end exactly a.
    """
    n = sum(shares.values())
    names = list(shares)
    done = [0] * len(names)
    slots: dict = {s: [] for s in names}
    releases = [(0, i) for i in range(len(names))]
    heapq.heapify(releases)
    ready: list[tuple[int, int]] = []
    for t in range(n):
        while releases and releases[0][0] <= t:
            _, i = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(done[i] + 1) * n // shares[names[i]]), i))
        _, i = heapq.heappop(ready)
        slots[names[i]].append(t)
        done[i] += 1
        if done[i] < shares[names[i]]:
            heapq.heappush(releases, (done[i] * n // shares[names[i]], i))
    return slots


def mix(
    df: DataFrame,
    weights: Mapping | None = None,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    frame_slots: int = FRAME_SLOTS,
) -> DataFrame:
    """Give every row its slot in a mix of the sources by target weight.

    Adds block (number of the block within its source, from 0), place (in the block) and slot: rows
    in the order of slot and place are the mix. In each source the rows are shuffled by a hash of
    the key and cut into blocks of ``block_rows``. One frame of slots is scheduled (``frame_of``) and
    repeated, so any block's slot follows from its number. Sources without a weight, or all if
    ``weights`` is None, get the square root of their number of rows. When a source runs out its
    later slots stay empty and the others go on as scheduled: nothing is dropped or repeated.

    A null source is a source like the others; null and repeated keys are rows like the others; an
    empty table gives an empty result. Only one count for each source reaches the driver.
    """
    added = {"block", "place", "slot", "_rank", "_slots", "_shuffle"} & set(df.columns)
    if added:
        raise ValueError(f"columns with these names exist already: {sorted(added)}")
    spark = df.sparkSession
    counts = {r[0]: r["n"] for r in df.groupBy(source).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.select("*", *(F.lit(0).cast("long").alias(c) for c in ("block", "place", "slot")))
    given = weights or {}
    wanted = {s: float(given.get(s, n**0.5)) for s, n in counts.items()}
    slots = frame_of(shares_of(wanted, max(frame_slots, SLOTS_PER_SOURCE * len(counts))))
    n = sum(map(len, slots.values()))
    kind = df.schema[source].dataType.simpleString()
    frame = spark.createDataFrame([(s, x) for s, x in slots.items()], f"`{source}` {kind}, _slots array<int>")
    shuffled = df.withColumn("_shuffle", F.xxhash64(F.col(key), F.lit(17)))
    ranked = number_rows(shuffled, ["_shuffle", key], within=[source], name="_rank", start=0)
    placed = lookup_join(ranked.drop("_shuffle"), frame, [source], null_safe=True)
    block = F.floor(F.col("_rank") / block_rows).cast("long")
    share = F.size("_slots").cast("long")
    slot = F.floor(F.col("block") / share).cast("long") * n + F.element_at("_slots", (F.col("block") % share + 1).cast("int"))
    placed = placed.withColumn("block", block).withColumn("place", F.col("_rank") % block_rows)
    return placed.withColumn("slot", slot).drop("_rank", "_slots")


def mixed_documents(df: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` in the order of their mix, with the columns of ``df``, whatever their names are."""
    packed = df.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    return in_mixed_order(mix(packed, **options)).select("row.*")


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` sorted by slot and place, over as many tasks as they need."""
    order = ["slot", "place"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).drop("block", "place", "slot")

"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles (operator 10)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthline.llm.common import char_table, codepoints, give_back, map_batches, mixed, picked, run_hashes, runs_of, sliced, starts_of, texts
from worthline.operators.partials import Shared
from worthline.session import written

#: Words of a shingle, and the least weighted Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Samples are banded as BANDS groups of ROWS: a pair at the threshold meets with chance 0.995, at 0.9 with 0.99998.
BANDS, ROWS = 10, 4
#: Cells of each of the two rows of the document-frequency sketch (a fixed number, whatever the input).
CELLS = 1 << 19
CHUNK_CELLS = 1 << 16
#: A shingle in fewer than one of RARE documents has the full weight 1 + BOOST; one in all has weight 1.
RARE, BOOST = 500, 0.2
#: Rounds in which the members of a bucket meet one leader; what is then still apart is joined by rare shingles.
LEADER_ROUNDS = 5
#: Texts that the verification cuts into shingles at once.
VECTORS = 32

_ONE = np.uint64(1)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOGS = -np.log((np.arange(65536) + 0.5) / 65536).astype(np.float32)


def shingles(items: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes | None]]:
    """For each text its distinct shingles (64-bit), their counts, and a 128-bit key of its word sequence.

    Words are runs of letters and digits in lower case. A text of fewer than five words is one
    shingle; one without words is one shingle of its characters; a blank text has none and no key.
    """
    lowered = [t.lower() for t in items]
    codes, lengths = codepoints(lowered)
    starts, ends = runs_of(char_table("words", lambda c: c.isalnum())[codes].view(bool))
    # a word never runs on into the next text
    bounds = starts_of(lengths)
    inner = bounds[1:-1]
    cut = inner[(np.searchsorted(starts, inner, side="left") - np.searchsorted(ends, inner, side="right")) == 1]
    at = np.searchsorted(starts, cut)
    cut = cut[(at == len(starts)) | (starts[np.minimum(at, len(starts) - 1)] != cut)] if len(starts) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    words = run_hashes(codes, starts, ends)
    first = np.searchsorted(starts, bounds)
    n = max(len(words) - SHINGLE + 1, 0)
    joined = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    joined = mixed(joined)
    # the shingles of each text are sorted where they lie; a run of equal ones begins at every place of ``runs``
    stops = np.maximum(first[1:] - SHINGLE + 1, first[:-1])
    opens = np.zeros(n + 1, dtype=bool)
    for a, b in zip(first[:-1].tolist(), stops.tolist()):
        if b > a:
            joined[a:b].sort()
            opens[a] = opens[b] = True
    opens[1:-1] |= joined[1:] != joined[:-1]
    runs = np.flatnonzero(opens[:-1])
    distinct, repeats = joined[runs], np.diff(runs, append=n)
    run_starts, run_stops = np.searchsorted(runs, first[:-1]).tolist(), np.searchsorted(runs, stops).tolist()
    all_shingles, all_counts, keys = [], [], []
    for i, text in enumerate(lowered):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= SHINGLE:
            values, counts = distinct[run_starts[i] : run_stops[i]], repeats[run_starts[i] : run_stops[i]]
        elif b > a:
            values, counts = mixed(np.array([np.bitwise_xor.reduce(mixed(words[a:b] + np.arange(b - a, dtype=np.uint64)))])), np.ones(1, dtype=np.int64)
        elif text.strip():
            digest = hashlib.blake2b(text.strip().encode(), digest_size=8).digest()
            values, counts = np.frombuffer(digest, dtype=np.uint64).copy(), np.ones(1, dtype=np.int64)
        else:
            values, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        all_shingles.append(values)
        all_counts.append(counts)
        sequence = words[a:b].tobytes() if b > a else text.strip().encode()
        keys.append(hashlib.blake2b(sequence, digest_size=16).digest() if len(values) else None)
    return all_shingles, all_counts, keys


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Rarity of the shingles of each cell (0 in all documents to 255 in fewer than one of RARE), two rows of cells.

    Counts over all texts. Each task adds up its own cells and sends them packed; the sums of a stretch
    of cells are streamed through one task in bounded memory, and only the fixed table reaches the driver.
    """
    spark = docs.sparkSession

    def count(batches):
        cells = np.zeros(2 * CELLS, dtype=np.uint32)
        n = 0
        for batch in batches:
            for part in sliced(batch):
                values, _, keys = shingles(texts(part))
                n += sum(k is not None for k in keys)
                joined = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
                mask = np.uint64(CELLS - 1)
                for row, shift in enumerate((np.uint64(0), np.uint64(24))):
                    places = ((joined >> shift) & mask).astype(np.int64)
                    cells[row * CELLS : (row + 1) * CELLS] += np.bincount(places, minlength=CELLS).astype(np.uint32)
        give_back()
        chunks = [c for c in range(2 * CELLS // CHUNK_CELLS) if cells[c * CHUNK_CELLS : (c + 1) * CHUNK_CELLS].any()]
        packed = [zlib.compress(cells[c * CHUNK_CELLS : (c + 1) * CHUNK_CELLS].tobytes(), 1) for c in chunks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *chunks], pa.int32()), pa.array([n.to_bytes(8, "little"), *packed], pa.binary())], names=["chunk", "cells"]
        )

    def add(batches):
        sums: dict[int, np.ndarray | int] = {}
        for batch in batches:
            for chunk, cells in zip(batch["chunk"].to_pylist(), batch["cells"].to_pylist()):
                new = int.from_bytes(cells, "little") if chunk < 0 else np.frombuffer(zlib.decompress(cells), dtype=np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + new if chunk in sums else new
        packed = [v.to_bytes(8, "little") if k < 0 else zlib.compress(v.tobytes(), 1) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "cells"])

    schema = "chunk int, cells binary"
    summed = docs.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    total = next((int.from_bytes(r["cells"], "little") for r in summed if r["chunk"] < 0), 0)
    cells = np.zeros(2 * CELLS, dtype=np.uint64)
    for r in summed:
        if r["chunk"] >= 0:
            cells[r["chunk"] * CHUNK_CELLS : (r["chunk"] + 1) * CHUNK_CELLS] = np.frombuffer(zlib.decompress(r["cells"]), dtype=np.uint64)
    del summed
    share = np.clip(total / np.maximum(cells, 1), 1.0, RARE)
    rarity = np.round(255 * np.log(share) / np.log(RARE)).astype(np.uint8)
    del cells, share
    give_back()
    return rarity


def weights_of(values: np.ndarray, counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """TF-IDF weights: the count, raised by up to BOOST for rare shingles.

    The boost is small on purpose. In a large group of near copies the shared shingles are frequent and
    the edits rare; a plain logarithmic weight would let the edits outweigh the copied text.
    """
    mask = np.uint64(CELLS - 1)
    level = np.maximum(rarity[(values & mask).astype(np.int64)], rarity[((values >> np.uint64(24)) & mask).astype(np.int64) + CELLS])
    return counts * (1.0 + BOOST / 255.0 * level)


def samples(values: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples: for each text (from ``starts``, none empty) BANDS * ROWS numbers of 32 bits.

    Two texts have the same number at a place with a chance equal to their weighted Jaccard similarity.
    """
    logs = np.log(weights).astype(np.float32)
    sizes = np.diff(starts, append=len(values))
    out = np.empty((len(starts), len(_SEEDS)), dtype=np.uint32)
    h, g = np.empty(len(values), dtype=np.uint64), np.empty(len(values), dtype=np.uint64)
    pieces, draws = np.empty((4, len(values)), dtype=np.intp), np.empty((4, len(values)), dtype=np.float32)
    for k, seed in enumerate(_SEEDS):
        np.bitwise_xor(values, seed, out=h)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= np.right_shift(h, np.uint64(32), out=g)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= np.right_shift(h, np.uint64(29), out=g)
        np.copyto(pieces, h.view(np.uint16).reshape(-1, 4).T)
        np.take(_LOGS, pieces, out=draws, mode="clip")  # every piece is a place of the table; other modes copy the result
        rate = np.add(draws[0], draws[1], out=draws[0])
        order = np.add(draws[2], draws[3], out=draws[2])
        np.log(order, out=order)
        np.multiply(h, np.uint64(0xC2B2AE3D27D4EB4F), out=g)
        shift = np.right_shift(g, np.uint64(40), out=h).view(np.int64).astype(np.float32)
        shift *= np.float32(2.0**-24)
        step = logs / rate
        step += shift
        np.floor(step, out=step)
        rest = np.subtract(step, shift, out=shift)
        rest += np.float32(1.0)
        rest *= rate
        order -= rest
        ranks = order.view(np.int32)
        ranks ^= (ranks >> np.int32(31)) & np.int32(0x7FFFFFFF)
        # marks are needed where the order is least; of several such places the least mark counts
        best = np.flatnonzero(ranks == np.repeat(np.minimum.reduceat(ranks, starts), sizes))
        marks = ((g[best] ^ step[best].astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(marks, np.searchsorted(best, starts))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    bands = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for row in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, row])
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sparse vectors."""
    common, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][at_a], b[1][at_b]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def signed(docs: DataFrame, shared: Shared) -> DataFrame:
    """doc_id, text_key, content (key of the word sequence, null if blank), size and band keys of every text."""

    def make():
        rarity = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            values, counts, keys = shingles(texts(batch))
            bands: list = [None] * len(keys)
            begin = 0
            while begin < len(keys):
                stop, held = begin, 0
                while stop < len(keys) and held < 32_768:
                    held += len(values[stop])
                    stop += 1
                full = [i for i in range(begin, stop) if keys[i] is not None]
                if full:
                    joined, sizes = np.concatenate([values[i] for i in full]), np.array([len(values[i]) for i in full])
                    weights = weights_of(joined, np.concatenate([counts[i] for i in full]), rarity)
                    found = band_keys(samples(joined, weights, starts_of(sizes)[:-1]))
                    for i, row in zip(full, found):
                        bands[i] = row
                begin = stop
            return {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "content": keys, "size": [int(c.sum()) for c in counts], "bands": bands}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, f"doc_id {kind}, text_key string, content binary, size long, bands array<long>", make)


def verified(pairs: DataFrame, bodies: DataFrame, shared: Shared) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold; ``bodies``: content, text."""
    left = bodies.select(F.col("content").alias("b"), F.col("text").alias("text_b"))
    right = bodies.select(F.col("content").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right.hint("merge"), "a").join(left.hint("merge"), "b")

    def make():
        rarity = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            # each text of the batch is cut into shingles once, some texts at a time
            held = dict(zip(a + b, batch["text_a"].to_pylist() + batch["text_b"].to_pylist()))
            names, vectors = list(held), {}
            for i in range(0, len(names), VECTORS):
                some = names[i : i + VECTORS]
                values, counts, _ = shingles([held[x] or "" for x in some])
                vectors |= {x: (v, weights_of(v, c, rarity)) for x, v, c in zip(some, values, counts)}
            return {"a": batch["a"], "b": batch["b"], "similarity": [similarity(vectors[x], vectors[y]) for x, y in zip(a, b)]}

        return run

    found = map_batches(joined.select("a", "b", "text_a", "text_b"), "a binary, b binary, similarity double", make, "text_a")
    return written(found, "verified").filter(F.col("similarity") >= SIMILAR)


def rare_pairs(nodes: DataFrame, bodies: DataFrame, shared: Shared) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (content, label) with different labels that can reach the threshold: none is missed.

    Shingles are put in one order, rarest among these nodes first. Two texts whose similarity is at
    least SIMILAR share a shingle in the part of each that remains until less than SIMILAR of its
    weight is left. Text that many nodes repeat comes last in the order, so it brings no pairs
    together unless little else is in them.
    """

    def make():
        rarity = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            values, counts, _ = shingles(texts(batch))
            weights = [weights_of(v, c, rarity) for v, c in zip(values, counts)]
            return {
                "content": batch["content"],
                "label": batch["label"],
                "weight": [float(w.sum()) for w in weights],
                "shingles": [v.view(np.int64) for v in values],
                "weights": weights,
            }

        return run

    schema = "content binary, label binary, weight double, shingles array<long>, weights array<double>"
    vectors = written(map_batches(bodies.join(nodes.hint("merge"), "content").select("content", "label", "text"), schema, make), "vectors")
    terms = vectors.select("content", "label", "weight", F.explode(F.arrays_zip("shingles", "weights")).alias("t"))
    terms = terms.select("content", "label", "weight", F.col("t.shingles").alias("shingle"), F.col("t.weights").alias("part"))
    shared_terms = terms.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    terms = terms.join(shared_terms.hint("merge"), "shingle")
    order = Window.partitionBy("content").orderBy("df", "shingle")
    terms = terms.select(
        "content",
        "label",
        "weight",
        "shingle",
        (F.col("weight") - F.sum("part").over(Window.partitionBy("content")) + F.sum("part").over(order) - F.col("part")).alias("before"),
    )
    left = F.col("weight") - F.col("before")
    prefix = terms.filter(F.col("before") <= (1 - SIMILAR) * F.col("weight") + 1e-6).select("content", "label", "weight", "shingle", left.alias("left"))
    prefix = written(prefix, "prefixes")
    other = prefix.select("shingle", *(F.col(c).alias(f"b_{c}") for c in ("content", "label", "weight", "left")))
    # at the first shingle that a pair shares, what is left of both must hold all that they share
    enough = F.least("left", "b_left") >= SIMILAR / (1 + SIMILAR) * (F.col("weight") + F.col("b_weight")) - 1e-6
    met = prefix.join(other.hint("merge"), "shingle").filter(
        (F.col("content") < F.col("b_content")) & (F.col("label") != F.col("b_label")) & enough
    )
    return met.select(F.col("content").alias("a"), F.col("b_content").alias("b"))


def components(links: DataFrame, hops: int | None = None) -> DataFrame:
    """node, label: the least node of each connected component of the distinct links (a, b).

    Every node takes the least label among its own and its neighbours', then that label's label, until
    nothing changes: a number of rounds that grows with the logarithm of a component's diameter. With
    ``hops`` it stops after so many rounds: a label is then a node of the same component, and nodes
    of one component may still have several.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels = both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label"))
    if hops is None:
        both, labels = written(both, "links"), written(labels, "labels")
    hop = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = new.join(jump, "low").select("node", F.least("low", "far").alias("next"), "label")
        hop += 1
        if hops is None:
            new = written(new, "labels")
            settled = new.filter(F.col("next") != F.col("label")).isEmpty()
        else:
            settled = hop == hops
        labels = new.select("node", F.col("next").alias("label"))
        if settled:
            return labels


def merged(labels: DataFrame, links: DataFrame, hops: int | None = None) -> DataFrame:
    """``labels`` (content, label) after the links (a, b): labels that a link joins become one.

    Only labels that differ across a link take part, so the graph shrinks with every call.
    """
    of_a = labels.select(F.col("content").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("content").alias("b"), F.col("label").alias("label_b"))
    apart = links.join(of_a, "a").join(of_b, "b").filter(F.col("label_a") != F.col("label_b"))
    apart = apart.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
    joined = components(written(apart, "apart"), hops).select(F.col("node").alias("label"), F.col("label").alias("low"))
    return written(labels.join(joined, "label", "left").select("content", F.coalesce("low", "label").alias("label")), "classes")


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, class_id (least doc_id of the class), n_links and class_size: one row per row of ``df``.

    Texts are linked if the weighted Jaccard similarity of their TF-IDF shingles is at least SIMILAR;
    classes are the connected components of the links. n_links counts the verified links of the text to
    others of its class with other words; copies with the same words are one node and need no link.

    Candidates share a band of samples. In each bucket all members meet one leader, so the pairs grow
    with the rows and not with the square of a bucket. The first leader is the shortest text: where a
    bucket is held together by a passage, a text that is similar to any member is similar to the one
    with least beside the passage. Buckets that still hold different components get another leader,
    and after LEADER_ROUNDS all members of such buckets go through an exact join (``rare_pairs``).

    Null and blank texts are alone in their class, each row with its own id. Repeated rows are copies.
    A very long text is one row like any other. Other columns are not read.
    """
    docs = picked(df, key, text).withColumn("text_key", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    spark = df.sparkSession
    shared = Shared(spark, document_frequencies(docs.select("text")))
    rows = written(signed(docs, shared), "signed")
    nodes = rows.filter(F.col("content").isNotNull()).groupBy("content").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    buckets = nodes.select("content", "text_key", "size", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets.join(sizes.hint("merge"), "band").drop("n"), "buckets")

    # texts of the nodes that share a bucket; by a shuffle at any size
    wanted = buckets.select("content", "text_key").distinct()
    bodies = docs.select("text_key", "text").join(wanted.hint("merge"), "text_key").dropDuplicates(["content"]).select("content", "text")
    bodies = written(bodies, "bodies")

    labels = buckets.select("content").distinct().select("content", F.col("content").alias("label"))
    tested, links, led = None, None, None
    for round_ in range(LEADER_ROUNDS + 1):
        # labels left apart only cost the next leaders some pairs; those the exact join reads and leaves are settled
        hops = None if round_ >= LEADER_ROUNDS - 1 else 1
        placed = buckets.select("band", "content", "size").join(labels, "content")
        if led is not None:
            placed = placed.join(led, "content", "left")
        else:
            placed = placed.withColumn("led", F.lit(None).cast("int"))
        first = [F.coalesce("led", F.lit(0)), F.col("size"), F.col("content")]
        apart = placed.groupBy("band").agg(
            F.min("label").alias("least"),
            F.max("label").alias("most"),
            F.min_by(F.struct(F.col("content").alias("b"), F.col("label").alias("b_label")), F.struct(*first)).alias("leader"),
        ).filter(F.col("least") != F.col("most"))
        apart = written(apart, "leaders")
        now = apart.select(F.col("leader.b").alias("content")).distinct().withColumn("led", F.lit(1))
        led = now if led is None else led.union(now).distinct()
        mixed_rows = placed.join(apart.select("band", "leader.*"), "band")
        if round_ < LEADER_ROUNDS:
            pairs = mixed_rows.filter(F.col("label") != F.col("b_label")).select(F.col("content").alias("a"), "b")
        else:
            pairs = rare_pairs(mixed_rows.select("content", "label").distinct(), bodies, shared)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if round_ and pairs.isEmpty():
            if mixed_rows.isEmpty():
                break
            labels = merged(labels, links, hops)
            continue
        found = verified(pairs, bodies, shared).select("a", "b")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        labels = merged(labels, links, hops)

    degree = links.select(F.col("a").alias("content")).union(links.select("b")).groupBy("content").agg(F.count("*").alias("n_links"))
    by_content = rows.filter(F.col("content").isNotNull()).groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    by_content = by_content.join(labels, "content", "left").join(degree, "content", "left")
    by_content = written(by_content.withColumn("label", F.coalesce("label", "content")), "contents")
    classes = by_content.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    facts = by_content.join(classes, "label").select("content", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "content").join(facts, "content", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def one_of_each(df: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose key is the id of their class, one row of each; columns as in ``df``.

    Rows with a null key are classes of their own only if blank; they are kept.
    """
    kept = classes.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_kept")).distinct()
    joined = df.join(kept.hint("merge"), df[key] == F.col("_kept"), "left_semi")
    return joined.dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))

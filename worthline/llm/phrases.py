"""Phrase collocations from Rabin-Karp fingerprints of every n-gram (operator 12)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worthline.llm.common import mixed
from worthline.operators.lookup import lookup_join, spread_join
from worthline.operators.partials import Shared
from worthline.session import written

#: Least count of a phrase, percent of it that a longer phrase must reach to replace it, rows of each language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Bytes of text that are hashed at once, and fingerprints that a task adds up before it sends them.
WINDOW_BYTES, HELD, SENT = 1 << 19, 1_200_000, 1 << 16
#: Bits of a membership map: 16 for each entry, but never more than this (32 MB); a fuller map lets more pass.
MOST_BITS = 1 << 28
BLOCKS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ROLL, _CHECK_ROLL = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: 0 inside a word, 1 between words (space, tab), 2 between pieces.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTED = "fp long, cnt long, chk long, place long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, dtype=np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Hasher:
    """Fingerprints of the n-grams of windows of text. Its powers are as long as the longest window so far."""

    def __init__(self, mask: np.uint64 = _MASK):
        self.mask = mask
        self.powers = _powers(WINDOW_BYTES + 1)
        self.seeds: dict[str, np.uint64] = {}

    def seed(self, lang: str) -> np.uint64:
        if lang not in self.seeds:
            self.seeds[lang] = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        return self.seeds[lang]

    def words(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends, pieces and prefix-polynomial hashes of the words of ``data``; texts begin at ``edges``."""
        kinds = _KINDS[data]
        inside = kinds == 0
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        before[edges[edges < len(data)]] = True
        after[edges[edges > 0] - 1] = True
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        text_of = np.searchsorted(edges, starts, side="right")
        pieces = np.cumsum(kinds == 2)[starts] + text_of if len(starts) else starts
        if len(self.powers[0]) < len(data) + 1:
            self.powers = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.powers[0][: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.powers[1][starts]
        return starts, ends, pieces, mixed(hashes + (ends - starts).astype(np.uint64))

    def grams(self, words: np.ndarray, pieces: np.ndarray, seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, fingerprints and check numbers (16 bits, by another polynomial) of all n-grams within pieces.

        The two lowest bits of a fingerprint are n.
        """
        m = max(len(words) - n + 1, 0)
        at = np.flatnonzero(pieces[:m] == pieces[n - 1 : n - 1 + m]) if n > 1 else np.arange(m)
        roll, check = np.full(len(at), n, dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        for i in range(n):
            roll = roll * _ROLL + words[at + i]
            check = check * _CHECK_ROLL + (words[at + i] >> np.uint64(17))
        fp = mixed(roll ^ seeds[at]) & self.mask & ~np.uint64(3) | np.uint64(n)
        return at, fp, mixed(check ^ seeds[at]) >> np.uint64(48)


def text_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the column text, and where each text begins (one more entry for the end)."""
    column = pc.fill_null(batch["text"], "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def windows(data: np.ndarray, bounds: np.ndarray, most: int = WINDOW_BYTES):
    """(start, stop) of stretches of about ``most`` bytes that end where a text or a piece ends.

    A piece longer than that is taken whole: no n-gram crosses the end of a piece, so nothing is lost.
    """
    start, size = 0, len(data)
    while start < size:
        stop = min(start + most, size)
        if stop < size:
            edge = int(bounds[np.searchsorted(bounds, stop, side="right") - 1])
            marks = np.flatnonzero(_KINDS[data[max(start, edge) : stop]] == 2)
            if len(marks):
                stop = max(start, edge) + int(marks[-1]) + 1
            elif edge > start:
                stop = edge
            else:
                limit = int(bounds[np.searchsorted(bounds, stop, side="left")])
                while stop < limit:
                    marks = np.flatnonzero(_KINDS[data[stop : min(stop + most, limit)]] == 2)
                    if len(marks):
                        stop += int(marks[0]) + 1
                        break
                    stop = min(stop + most, limit)
        yield start, stop
        start = stop


def cut_up(batch: pa.RecordBatch, hasher: Hasher):
    """For each window of the batch: bytes, words (starts, ends, pieces, hashes), language seeds and text of each word."""
    data, bounds = text_bytes(batch)
    seeds = np.array([hasher.seed(x) for x in batch["lang"].to_pylist()], dtype=np.uint64)
    for start, stop in windows(data, bounds):
        first = np.searchsorted(bounds, start, side="right") - 1
        last = np.searchsorted(bounds, stop, side="left")
        edges = np.maximum(bounds[first:last] - start, 0)
        starts, ends, pieces, hashes = hasher.words(data[start:stop], edges)
        text_of = first + np.searchsorted(edges, starts, side="right") - 1
        yield data[start:stop], starts, ends, pieces, hashes, seeds[text_of], text_of


def _merged(parts: list[tuple]) -> tuple:
    """Equal fingerprints of the parts (fp, cnt, chk, place) added up; the least place is kept."""
    fp, cnt, chk, place = (np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]
    if not len(fp):
        return fp, cnt, chk, place
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    return (
        fp[first],
        np.add.reduceat(cnt[order], first),
        np.add.reduceat(chk[order], first),
        np.minimum.reduceat(place[order], first),
    )


def _sent(columns: tuple):
    """Batches of the columns fp, cnt, chk and place."""
    for i in range(0, len(columns[0]), SENT):
        arrays = [pa.array(c[i : i + SENT].view(np.int64)) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["fp", "cnt", "chk", "place"])


def counted(docs: DataFrame, sizes: tuple[int, ...], least: int, bigrams: Shared | None, mask: np.uint64) -> DataFrame:
    """(fp, n, cnt, chk, place) of the n-grams of the sizes that occur at least ``least`` times.

    Rows go straight to the task of their fingerprint: what a task sends is added up already, so a
    second hash table before the shuffle would find little to combine.

    ``cnt`` counts all occurrences, ``chk`` adds up their check numbers and ``place`` points to a text
    that holds one: it is half of the text's hash, so a few texts may share it. Each task adds up its own before the shuffle. With ``bigrams`` an n-gram is counted
    only if both its halves of two words may be frequent.
    """

    def count(batches):
        hasher, parts, held = Hasher(mask), [], 0
        for batch in batches:
            places = batch["place"].to_numpy()
            for _, _, _, pieces, hashes, seeds, text_of in cut_up(batch, hasher):
                for n in sizes:
                    at, fp, check = hasher.grams(hashes, pieces, seeds, n)
                    if bigrams is not None:
                        pairs, pair_fp, _ = hasher.grams(hashes, pieces, seeds, 2)
                        may = np.zeros(len(hashes) + 1, dtype=bool)
                        may[pairs] = bigrams.value.holds(pair_fp)
                        keep = may[at] & may[at + 1]
                        at, fp, check = at[keep], fp[keep], check[keep]
                    some = _merged([(fp, np.ones(len(at), dtype=np.int64), check.view(np.int64), places[text_of[at]])])
                    parts.append(some)
                    held += len(some[0])
                if held > HELD:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield from _sent(parts[0])
                        parts = []
                    held = sum(len(p[0]) for p in parts)
        if parts:
            yield from _sent(_merged(parts))

    sums = docs.select("lang", "text", "place").mapInArrow(count, _COUNTED).repartition("fp").groupBy("fp")
    sums = sums.agg(F.sum("cnt").alias("cnt"), F.sum("chk").alias("chk"), F.min("place").alias("place"))
    n = F.col("fp").bitwiseAND(F.lit(3)).cast("int").alias("n")
    return sums.filter(F.col("cnt") >= least).select("fp", n, "cnt", "chk", "place")


class Members:
    """A bit for each entry of a set: what it does not hold is certainly absent."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.last, self.packed = np.uint64(bits - 1), packed

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = (values >> np.uint64(2)) & self.last
        return ((self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def members(df: DataFrame, column: str) -> Members:
    """Bit map of a column of 64-bit numbers (but for their two lowest bits); built in ``BLOCKS`` tasks, of at most ``MOST_BITS`` bits."""
    n = df.count()
    bits = 1 << 16
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    width = bits // BLOCKS

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["at"].to_numpy()
            for block in np.unique(at // width):
                inside = at[at // width == block] - block * width
                marks = held.setdefault(int(block), np.zeros(width, dtype=bool))
                marks[inside] = True
        packed = [zlib.compress(np.packbits(v, bitorder="little").tobytes(), 1) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["block", "bits"])

    places = df.select(F.shiftright(column, 2).bitwiseAND(F.lit(bits - 1)).alias("at"))
    rows = places.repartition(BLOCKS, F.floor(F.col("at") / width)).mapInArrow(build, "block int, bits binary").collect()
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        packed[row["block"] * (width // 8) : (row["block"] + 1) * (width // 8)] = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return Members(bits, packed)


def _phrase(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(_LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(at, at + n))


def materialised(docs: DataFrame, found: DataFrame, mask: np.uint64) -> DataFrame:
    """(fp, n, lang, phrase, cnt, whole) of the fingerprints ``found``, read from the texts they point to.

    ``whole`` tells that the check numbers of all occurrences add up to those of this phrase, so that
    no other phrase was counted under its fingerprint. Only texts that are pointed to are shuffled,
    one copy from each task. A fingerprint may be read from several texts of its place.
    """
    spark = docs.sparkSession
    wanted = found.groupBy("place").agg(F.collect_list(F.struct("fp", "n", "cnt", "chk")).alias("wanted"))
    shared = Shared(spark, members(wanted, "place"))

    def pointed(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = shared.value.holds(batch["place"].to_numpy().view(np.uint64))
            for i, body in zip(np.flatnonzero(keep), batch["body"].to_numpy()[keep].tolist()):
                keep[i] = body not in seen
                seen.add(body)
            if keep.any():
                yield batch.filter(pa.array(keep))

    narrow = docs.select("lang", "text", "place", "body")
    texts = narrow.mapInArrow(pointed, narrow.schema).dropDuplicates(["body"])
    joined = texts.join(wanted, "place").select("lang", "text", "wanted")

    def read(batches):
        hasher = Hasher(mask)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for i in range(batch.num_rows):
                entries = batch["wanted"][i].values
                columns = {name: entries.field(name).to_numpy() for name in ("fp", "n", "cnt", "chk")}
                left = {(int(n), int(fp)): k for k, (n, fp) in enumerate(zip(columns["n"], columns["fp"]))}
                out = []
                for data, starts, ends, pieces, hashes, seeds, _ in cut_up(batch.slice(i, 1), hasher):
                    for n in {n for n, _ in left}:
                        at, fp, check = hasher.grams(hashes, pieces, seeds, n)
                        values, first = np.unique(fp, return_index=True)
                        keys = np.array([f for m, f in left if m == n], dtype=np.int64).view(np.uint64)
                        spots = np.searchsorted(values, keys)
                        spots[spots == len(values)] = 0
                        for key, spot in zip(keys, spots):
                            if len(values) and values[spot] == key:
                                k = left.pop((n, int(key.view(np.int64))))
                                j = int(first[spot])
                                whole = int(check[j]) * int(columns["cnt"][k]) == int(columns["chk"][k])
                                out.append((int(columns["fp"][k]), n, langs[i], _phrase(data, starts, ends, int(at[j]), n), int(columns["cnt"][k]), whole))
                    if not left:
                        break
                names = ["fp", "n", "lang", "phrase", "cnt", "whole"]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.bool_()]
                arrays = [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    table = joined.mapInArrow(read, "fp long, n int, lang string, phrase binary, cnt long, whole boolean")
    return table.withColumn("phrase", F.col("phrase").cast("string"))


def recounted(docs: DataFrame, mixed_up: DataFrame, least: int, mask: np.uint64) -> DataFrame:
    """(n, lang, phrase, cnt) of all n-grams under the fingerprints ``mixed_up``, counted by their text."""
    shared = Shared(docs.sparkSession, members(mixed_up, "fp"))

    def count(batches):
        hasher = Hasher(mask)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for data, starts, ends, pieces, hashes, seeds, text_of in cut_up(batch, hasher):
                sums: dict[tuple, int] = {}
                for n in (1, 2, 3):
                    at, fp, _ = hasher.grams(hashes, pieces, seeds, n)
                    for i in np.flatnonzero(shared.value.holds(fp)):
                        key = (int(fp[i].view(np.int64)), n, langs[text_of[at[i]]], _phrase(data, starts, ends, int(at[i]), n))
                        sums[key] = sums.get(key, 0) + 1
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary()]
                arrays = [pa.array([k[c] for k in sums], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.int64())], names=["fp", "n", "lang", "phrase", "cnt"])

    table = docs.select("lang", "text").mapInArrow(count, "fp long, n int, lang string, phrase binary, cnt long")
    table = table.groupBy("fp", "n", "lang", "phrase").agg(F.sum("cnt").alias("cnt"))
    table = table.join(mixed_up.select("fp", "n"), ["fp", "n"], "left_semi")
    return table.filter(F.col("cnt") >= least).select("n", "lang", F.col("phrase").cast("string").alias("phrase"), "cnt")


def frequent_phrases(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, mask: np.uint64 = _MASK) -> DataFrame:
    """(lang, n, phrase, cnt): every phrase of one to three words with at least ``least`` occurrences in its language.

    All n-grams are counted by fingerprint; a phrase of three words only if both its halves of two
    words are frequent, as it cannot be frequent otherwise. Only frequent fingerprints are read back
    from the text they point to, and any that stands for several phrases is counted again by text, so
    the counts are exact whatever collides.
    """
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(name.alias("lang"), body.alias("text")).withColumn("body", F.xxhash64("lang", "text"))
    docs = docs.withColumn("place", F.shiftrightunsigned("body", 32))
    short = written(counted(docs, (1, 2), least, None, mask), "phrases-short")
    pairs = Shared(df.sparkSession, members(short.filter("n = 2"), "fp"))
    found = written(short.unionByName(counted(docs, (3,), least, pairs, mask)), "phrases")
    read = materialised(docs, found, mask).filter("whole").dropDuplicates(["fp"]).drop("whole")
    read = written(read, "phrases-read")
    phrases = read.select("lang", "n", "phrase", "cnt")
    if read.count() == found.count():
        return phrases
    mixed_up = written(found.join(read, "fp", "left_anti"), "phrases-mixed")
    return phrases.unionByName(recounted(docs, mixed_up, least, mask))


def word_totals(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, n): word occurrences of each language."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(body, r"[.,;:!?\x0A-\x0D\x20\x09]+"), lambda w: w != ""))
    counts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), words.cast("long").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP, mask: np.uint64 = _MASK
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two or three words of each language.

    A-Z is lowered, texts are cut at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into
    words. ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut (the earliest of
    equals), ``n`` all words of the language; the score is the whole part of 1000000*a*a/(l*r), in exact
    decimals. A phrase inside a longer one that reaches ``covered`` percent of its count is dropped. Ties
    in the order go by ``a`` and then by the bytes of the phrase. A null language is ``und``; null and
    empty texts hold no word; repeated rows count each; an empty table gives no row; other columns
    are not read. Whole texts are read, in stretches that end with a piece, so a long text is no special case.
    """
    phrases = written(frequent_phrases(df, lang, text, least, mask), "phrases-exact")
    counts = phrases.select("lang", "phrase", "cnt")
    words = F.split("phrase", " ")
    part = lambda a, size: F.array_join(F.slice("_w", a, size), " ")
    candidates = phrases.filter("n >= 2").select("lang", "phrase", "n", F.col("cnt").alias("a"), words.alias("_w"))
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "n", "a", "_w", cut)
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("n") - F.col("k"))}).drop("_w")
    cuts = spread_join(cuts, counts.select("lang", F.col("phrase").alias("left"), F.col("cnt").alias("l")), ["lang", "left"], "inner")
    cuts = spread_join(cuts, counts.select("lang", F.col("phrase").alias("right"), F.col("cnt").alias("r")), ["lang", "right"], "inner")
    # up to 36 digits on either side of the division
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "n", "a")
    scored = lowest.agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "n", "a", "_c.l", "_c.r", "_c.score")

    longer = candidates.filter("n = 3").select("lang", "a", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("_longer") * 100 < F.col("a") * covered, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    named = lookup_join(ranked.drop("n"), word_totals(df, lang, text), ["lang"], "inner")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

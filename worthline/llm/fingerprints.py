"""Document fingerprints: quartile bucket digests of hashed byte triplets (operator 8)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from worthline.llm.common import map_batches, picked, sliced, texts
from worthline.session import written

BUCKETS = 128
#: A difference of this size or more counts as no likeness at all.
WORST = 300
#: Offsets of the second and third byte of the triplets that begin at each byte.
TRIPLETS = ((1, 2), (1, 3), (2, 3))


def digest(data: bytes) -> str:
    """A digest of 70 hexadecimal digits: checksum, length and quartile ratios, then two bits a bucket."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    n = len(raw)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if n >= 4:
        hashes = np.empty((len(TRIPLETS), n - 3), dtype=np.uint32)
        first = raw[: n - 3] << np.uint32(16)
        for k, (i, j) in enumerate(TRIPLETS):
            np.add(first + (raw[i : n - 3 + i] << np.uint32(8)), raw[j : n - 3 + j], out=hashes[k])
            hashes[k] += np.uint32(k << 24)
        hashes *= np.uint32(0x9E3779B1)
        hashes ^= hashes >> np.uint32(15)
        hashes *= np.uint32(0x85EBCA6B)
        counts = np.bincount((hashes >> np.uint32(25)).ravel(), minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    length = int(round(np.log(n + 1) / np.log(1.2)))
    ratios = (15 * q1 // max(q3, 1) << 4) | (15 * q2 // max(q3, 1))
    return f"{zlib.crc32(data) & 255:02x}{min(length, 255):02x}{ratios:02x}" + packed.tobytes().hex()


def _parts(fingerprint: str):
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    codes = (raw[3:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return int(raw[0]), int(raw[1]), int(raw[2]), codes.astype(np.int8).ravel()


#: Penalty of two bucket codes that differ by 0 to 3 quartiles.
_STEPS = np.array([0, 1, 2, 6])


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 at a difference of ``WORST`` or more."""
    if a == b:
        return 1.0
    (sum_a, length_a, ratio_a, codes_a), (sum_b, length_b, ratio_b, codes_b) = _parts(a), _parts(b)
    difference = int(_STEPS[np.abs(codes_a - codes_b)].sum()) + (sum_a != sum_b)
    apart = abs(length_a - length_b)
    difference += apart if apart <= 1 else 4 * apart
    difference += abs((ratio_a >> 4) - (ratio_b >> 4)) + abs((ratio_a & 15) - (ratio_b & 15))
    return 1.0 - min(difference, WORST) / WORST


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id and fingerprint of each whole text, one row per row; null counts as empty.

    Texts under four bytes have no triplets: only length and checksum tell them apart. Equal texts
    have equal fingerprints. Other columns are not read.
    """
    source = picked(df, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "fingerprint": [digest(t.encode()) for t in texts(batch)]}

    return map_batches(source, f"doc_id {kind}, fingerprint string", make)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, mark: str, following: str, next_mark: str) -> tuple:
    data = edited_text(text, following).encode()
    edited = digest(data)
    return (len(text), hashlib.sha256(data).hexdigest(), mark, edited, likeness(mark, edited), likeness(mark, next_mark))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Compare every text with its edited form and with the next text in descending order of the key.

    Returns doc_id and the columns of ``RESULT``, one row per row of ``df``. The last row is followed
    by the first, a single row by itself; equal keys follow each other by a hash of their texts; null
    keys come last; null texts count as empty.

    The texts are range-partitioned once and read in order; a task holds one pending text. What
    follows the last row of a task is the first row of the next, so each task also hands over those
    two texts, and they are joined by task number.
    """
    source = picked(df, key, text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie").asc()]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"doc_id {kind}, {RESULT}, part int, role string, text string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        part = TaskContext.get().partitionId()
        pending = None
        for batch in batches:
            for piece in sliced(batch):
                rows = []
                for doc_id, item in zip(piece["doc_id"].to_pylist(), texts(piece)):
                    mark = digest(item.encode())
                    if pending is None:
                        rows.append((None, None, None, mark, None, None, None, part, "head", item))
                    else:
                        rows.append((pending[0], *_compare(pending[1], pending[2], item, mark), part, None, None))
                    pending = (doc_id, item, mark)
                yield _record(rows, arrow)
        if pending is not None:
            yield _record([(pending[0], None, None, pending[2], None, None, None, part, "tail", pending[1])], arrow)

    walked = written(ordered.mapInArrow(run, schema), "fingerprints")
    parts = sorted(r["part"] for r in walked.filter("role = 'head'").select("part").collect())
    spark = df.sparkSession
    links = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follower int")
    tails = walked.filter("role = 'tail'").select("doc_id", "part", F.col("fingerprint").alias("mark"), "text")
    heads = walked.filter("role = 'head'").select(
        F.col("part").alias("follower"), F.col("fingerprint").alias("next_mark"), F.col("text").alias("following")
    )
    seams = tails.join(F.broadcast(links), "part").join(heads, "follower")

    def make():
        def fill(batch: pa.RecordBatch) -> dict:
            rows = [
                _compare(a, m, b, n)
                for a, m, b, n in zip(*(batch[c].to_pylist() for c in ("text", "mark", "following", "next_mark")))
            ]
            names = [f.split()[0] for f in RESULT.split(", ")]
            return {"doc_id": batch["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return fill

    filled = map_batches(seams.select("doc_id", "text", "mark", "following", "next_mark"), f"doc_id {kind}, {RESULT}", make)
    return walked.filter("role is null").drop("part", "role", "text").unionByName(filled)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

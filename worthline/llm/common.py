"""What the text operators share: column-wise tasks over Arrow batches, and bounded samples by hash."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that a task holds as Python objects at once; a longer single text is taken alone.
SLICE_BYTES = 1_000_000


def sliced(batch: pa.RecordBatch, text: str | None = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` that hold at most ``limit`` bytes of ``text`` each (or one row)."""
    if text is None or batch.num_rows == 0:
        yield batch
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Hand memory that is no longer used back to the system: a worker (or the driver) goes on with other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame,
    schema: str | T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    text: str | None = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``make()`` runs once per task and returns a function from a batch to the columns of ``schema``."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kinds)

    def run(batches):
        function = make()
        for batch in batches:
            for part in sliced(batch, text, slice_bytes):
                columns = function(part)
                arrays = [
                    c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=field.type, from_pandas=True)
                    for field, c in ((field, columns[field.name]) for field in arrow)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        del function
        give_back()

    return df.mapInArrow(run, kinds)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts as Python strings; null becomes empty."""
    return [x or "" for x in batch[name].to_pylist()]


def picked(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under the names the operators use; every other column is left unread."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def crc_part(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) from a hash of the columns, even to 2**-53."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(7919)), 11).cast("double") / float(2**53)


def bounded_sample(df: DataFrame, label: str, key: str, rows: int, known: dict | None = None) -> DataFrame:
    """About ``rows`` rows of each label (all, if fewer), chosen by a hash of the key.

    Labels are few; their counts are the only thing looked at on the driver. ``known`` gives the
    counts where they are already at hand.
    """
    if known is None:
        counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    else:
        kind = df.schema[label].dataType.simpleString()
        counts = df.sparkSession.createDataFrame(list(known.items()), f"`{label}` {kind}, _n long")
    return (
        df.join(F.broadcast(counts), label)
        .filter(hash_share(key) * F.col("_n") < float(rows))
        .drop("_n")
    )


def codepoints(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the length of each text."""
    lengths = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    return np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    return starts


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Base of the rolling hash of words and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; a worker keeps those for a slice, longer ones are let go."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if not _POWERS and n <= SLICE_BYTES + 1:
        _POWERS.extend(made)
    return made


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``codes[start:end]``: equal runs have equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


_TABLES: dict[str, np.ndarray] = {}


def char_table(name: str, test: Callable[[str], int]) -> np.ndarray:
    """``test`` of every code point, computed once in a worker."""
    if name not in _TABLES:
        _TABLES[name] = np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    return _TABLES[name]


def fit_separator(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) of rows ``x`` and signs ``y``: weights and offset.

    Solved in the dual by coordinate descent over the Gram matrix of a bounded sample.
    """
    n = len(x)
    gram = (x @ x.T + 1.0).astype(np.float64)
    signed = gram * y[:, None] * y[None, :]
    diagonal = np.diag(signed) + 0.5 / cost
    alpha, gradient = np.zeros(n), -np.ones(n)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(n):
            g = gradient[i] + alpha[i] * 0.5 / cost
            step = max(alpha[i] - g / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                gradient += step * signed[:, i]
                largest = max(largest, abs(step) * diagonal[i])
        if largest < 1e-3:
            break
    weights = (alpha * y).astype(x.dtype) @ x  # in the width of x: no wider copy of it
    return weights, float(np.sum(alpha * y))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; ``y`` may be soft; the last coefficient is the offset."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (p - y)) + keep * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

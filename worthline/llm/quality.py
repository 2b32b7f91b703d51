"""Quality by a linear-chain conditional random field over lines (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.llm.common import (
    bounded_sample,
    char_table,
    codepoints,
    fit_logistic,
    map_batches,
    picked,
    run_hashes,
    runs_of,
    sigmoid,
    starts_of,
    texts,
)
from worthline.operators.lookup import lookup_join
from worthline.operators.partials import Shared

#: Labelled documents of each label that are fitted; rounds in which the line labels are revised.
FIT_ROWS, REVISIONS = 1500, 3
#: Lines longer than this are read as several, so that long lines weigh by their parts.
KINDS = 8
OWN = 14
FEATURES = 3 * OWN


def _kind(c: str) -> int:
    """Class of a character: small letter, capital, digit, space, mark inside prose, other ASCII mark, other, line end."""
    if c == "\n":
        return 7
    if c.isspace():
        return 3
    if c.isalpha():
        return 1 if c.isupper() else 0
    if c.isdigit():
        return 2
    if c in ".,;:'\"-()?":
        return 4
    return 5 if c.isascii() else 6


def line_features(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-empty line, its document and its length in characters.

    The features describe the line (shares of character classes, word lengths, repeated words, whether
    it repeats an earlier line) and the lines before and after it.
    """
    codes, lengths = codepoints([f"{t}\n" for t in items])
    kinds = char_table("quality", _kind)[codes]
    starts, ends = runs_of(kinds != 7)
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(starts_of(lengths), starts, side="right") - 1
    line_of = np.repeat(np.arange(n), ends - starts)
    inside = kinds[kinds != 7]
    counts = np.bincount(line_of * KINDS + inside, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    word_starts, word_ends = runs_of((kinds != 3) & (kinds != 7))
    word_line = np.searchsorted(starts, word_starts, side="right") - 1
    words = np.maximum(np.bincount(word_line, minlength=n), 1)
    hashes = run_hashes(codes, word_starts, word_ends)
    # words that stand in the line already, and words equal to the one before
    order = np.lexsort((hashes, word_line))
    repeats = np.zeros(len(hashes), dtype=bool)
    repeats[1:] = (hashes[order][1:] == hashes[order][:-1]) & (word_line[order][1:] == word_line[order][:-1])
    repeated = np.bincount(word_line[order], weights=repeats, minlength=n) / words
    adjacent = np.zeros(len(hashes), dtype=bool)
    adjacent[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    doubled = np.bincount(word_line, weights=adjacent, minlength=n) / words
    single = np.bincount(word_line, weights=(word_ends - word_starts) == 1, minlength=n) / words
    whole = run_hashes(codes, starts, ends) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    again = first[number] != np.arange(n)
    own = np.column_stack(
        [
            counts[:, :7] / size[:, None],
            np.log1p(size) / 5.0,
            np.minimum(size / words / 10.0, 3.0),
            repeated,
            doubled,
            single,
            again,
            np.minimum(counts[:, 5] / words, 3.0),
        ]
    )
    # neighbours: a line without one is its own neighbour
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[np.concatenate(([True], doc[1:] != doc[:-1]))] += 1
    after[np.concatenate((doc[1:] != doc[:-1], [True]))] -= 1
    return np.column_stack([own, own[before], own[after]]), doc, size.astype(np.int64)


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first line of each chain, and the chain lengths."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate((first, [len(doc)])))


def marginals(unary: np.ndarray, transition: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: the chance that each line is good, and of each pair of neighbours.

    ``unary`` is the log-potential of good against bad, ``transition[a, b]`` that of state b after a
    (0 bad, 1 good). Chains are walked side by side, longest first.
    """
    n = len(unary)
    potentials = np.column_stack([np.zeros(n), unary])
    first, sizes = _chains(doc)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    forward, backward = potentials.copy(), np.zeros((n, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(1, longest):
        here = first[: active[t]] + t
        step = forward[here - 1][:, :, None] + transition
        forward[here] = potentials[here] + np.logaddexp(step[:, 0], step[:, 1])
    for t in range(longest - 1, 0, -1):
        here = first[: active[t]] + t
        step = transition + (potentials[here] + backward[here])[:, None, :]
        backward[here - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    good = sigmoid((forward[:, 1] + backward[:, 1]) - (forward[:, 0] + backward[:, 0]))
    inner = np.ones(n, dtype=bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    joint = forward[later - 1][:, :, None] + transition + (potentials[later] + backward[later])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    pairs = joint / joint.sum(axis=(1, 2), keepdims=True)
    return good, pairs


@dataclass
class QualityModel:
    """The field (weights of line features, offset, transitions) and the scale from line marginals to scores."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    scale: np.ndarray
    prior: float

    def lines(self, items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features, doc, size = line_features(items)
        good, _ = marginals(self._unary(features), self.transition, doc)
        return good, doc, size

    def _unary(self, features: np.ndarray) -> np.ndarray:
        return _expand(features, self.centre, self.spread) @ self.weights[:-1] + self.weights[-1]

    def score(self, items: list[str]) -> np.ndarray:
        good, doc, size = self.lines(items)
        mean, least = _by_document(good, doc, size, len(items))
        scores = sigmoid(np.column_stack([mean, least]) @ self.scale[:-1] + self.scale[-1])
        empty = np.bincount(doc, minlength=len(items))[: len(items)] == 0
        return np.where(empty, self.prior, scores)


def _expand(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = np.clip((features - centre) / spread, -4.0, 4.0)
    return np.column_stack([x, x * x])


def _by_document(good: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the length-weighted mean marginal of each document and of its length-weighted bad share."""
    total = np.maximum(np.bincount(doc, weights=size, minlength=n), 1)
    mean = np.bincount(doc, weights=size * good, minlength=n) / total
    clear = np.bincount(doc, weights=size * (good < 0.5), minlength=n) / total
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean)), clear


def _marked(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))


def fit_quality(
    labelled: DataFrame,
    text: str = "text",
    label: str = "quality",
    key: str = "doc_id",
    rows: int = FIT_ROWS,
    labels: DataFrame | None = None,
) -> QualityModel:
    """Fit on about ``rows`` documents of each label (1 good, 0 bad), chosen by a hash of the key.

    Lines first take the label of their document. The field is then fitted, the lines of bad documents
    are labelled anew by their marginals (good documents stay good throughout, a bad one keeps its
    worst line), and so on for ``REVISIONS`` rounds. Only the features of the sampled lines reach the
    driver. Without rows of both labels the model gives every text the share of good rows (0.5 if none).

    ``labels`` may hold the labels in a table of its own, by the same key: rows are then counted by a
    join of the keys alone, and only the sampled keys meet the texts, which are not shuffled.
    """
    own = _marked(labelled if labels is None else labels, key, label)
    source = own if labels is None else own.join(labelled.select(F.col(key).alias("doc_id")), "doc_id")
    counts = {r["label"]: r["n"] for r in source.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    neutral = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES + 1), np.zeros((2, 2)), np.array([0.0, 0.0, np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))]), prior)
    if len(counts) < 2:
        return neutral
    if labels is None:
        whole = labelled.filter(F.col(label).isin(0, 1)).select(
            F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")
        )
        sample = bounded_sample(whole, "label", "doc_id", rows, counts)
    else:
        sample = lookup_join(picked(labelled, key, text), bounded_sample(own, "label", "doc_id", rows, counts), ["doc_id"], "inner")
    sample = sample.filter(F.length(F.trim("text")) > 0)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            features, doc, size = line_features(texts(batch))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            return {
                "label": batch["label"],
                "lines": [features[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])],
                "sizes": [size[a:b].tobytes() for a, b in zip(bounds, bounds[1:])],
            }

        return run

    rows_ = map_batches(sample, "label int, lines binary, sizes binary", make).filter("length(sizes) > 0").collect()
    if len({r["label"] for r in rows_}) < 2:
        return neutral
    rows_.sort(key=lambda r: (r["label"], bytes(r["sizes"]), bytes(r["lines"])))
    features = np.concatenate([np.frombuffer(r["lines"], dtype=np.float32).reshape(-1, FEATURES) for r in rows_]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["sizes"], dtype=np.int64) for r in rows_])
    labels = np.array([r["label"] for r in rows_])
    doc = np.repeat(np.arange(len(rows_)), [len(r["sizes"]) // 8 for r in rows_])
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = _expand(features, centre, spread)
    # each document counts once, however many lines it has; lines count by length
    weight = size / np.bincount(doc, weights=size)[doc]
    good = labels[doc].astype(np.float64)
    weights, transition = np.zeros(2 * FEATURES + 1), np.zeros((2, 2))
    for revision in range(REVISIONS + 1):
        weights, transition = _fit_field(x, doc, good, weight * len(doc) / len(labels))
        if revision == REVISIONS:
            break
        now, _ = marginals(x @ weights[:-1] + weights[-1], transition, doc)
        worst = np.ones(len(labels))
        np.minimum.at(worst, doc, now)
        good = np.where(labels[doc] == 1, 1.0, np.where(now <= worst[doc], 0.0, now))
    now, _ = marginals(x @ weights[:-1] + weights[-1], transition, doc)
    mean, clear = _by_document(now, doc, size, len(labels))
    balance = np.where(labels == 1, counts[1] / (labels == 1).sum(), counts[0] / (labels == 0).sum())
    scale = fit_logistic(np.column_stack([mean, clear]), labels.astype(float), balance / balance.mean(), ridge=0.1)
    return QualityModel(centre, spread, weights, transition, scale, prior)


def _fit_field(x: np.ndarray, doc: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Field parameters by alternating exact unary fits and transition counts under the marginals.

    The unary weights start from the weighted logistic fit of single lines; transitions match the
    expected counts of neighbouring states to those of the labels (iterative scaling).
    """
    weights = fit_logistic(x, good, weight, ridge=3.0)
    first, _ = _chains(doc)
    inner = np.ones(len(doc), dtype=bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    transition = np.zeros((2, 2))
    if not len(later):
        return weights, transition
    a, b = good[later - 1], good[later]
    w = weight[later]
    seen = np.array([[((1 - a) * (1 - b) * w).sum(), ((1 - a) * b * w).sum()], [(a * (1 - b) * w).sum(), (a * b * w).sum()]]) + 1.0
    for _ in range(steps):
        _, pairs = marginals(x @ weights[:-1] + weights[-1], transition, doc)
        expected = (pairs * w[:, None, None]).sum(axis=0) + 1.0
        transition = np.clip(transition + 0.5 * np.log(seen / expected), -4.0, 4.0)
    return weights, transition


def quality_scores(df: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, score (0 to 1, higher: good likelier) and bad_share (length share of lines labelled bad).

    One row per row of ``df``. Texts that are null or hold no line get the share of good rows the
    model was fitted on. Whole texts are read, a very long one alone; repeated rows get equal scores;
    other columns are not read.
    """
    shared = Shared(df.sparkSession, model)
    source = picked(df, key, text)

    def make():
        fitted = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            items = texts(batch)
            good, doc, size = fitted.lines(items)
            mean, clear = _by_document(good, doc, size, len(items))
            scores = sigmoid(np.column_stack([mean, clear]) @ fitted.scale[:-1] + fitted.scale[-1])
            empty = np.bincount(doc, minlength=len(items))[: len(items)] == 0
            return {"doc_id": batch["doc_id"], "score": np.where(empty, fitted.prior, scores), "bad_share": clear}

        return run

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, f"doc_id {kind}, score double, bad_share double", make)

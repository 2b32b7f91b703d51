"""Toxic spans and document scores by a linear-chain conditional random field over tokens (operator 11)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.llm.common import fit_logistic, hash_share, map_batches, mixed, picked, sigmoid
from worthline.llm.phrases import text_bytes, windows
from worthline.operators.partials import Shared

#: Labelled documents that are fitted: at most about so many toxic and clean ones, and bytes of each kind.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1500, 2000, 6_000_000
#: Share of the fitted documents that is kept back to scale the scores, rounds of labelling, steps of a fit.
SCALE_SHARE, ROUNDS, STEPS = 0.3, 2, 20
#: Hashed features; a token has its word, the prefixes and suffixes of these lengths in bytes.
CELLS = 1 << 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4, 5)
RIDGE = 0.5
LIMIT = 30.0
#: Words are runs of ASCII letters, digits and all bytes of other characters.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes of ``data``) and the text each stands in; no word crosses two texts."""
    inside = _INSIDE[data]
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cells of the features of each word, lower-cased: the word, its prefixes, its suffixes (cell 0: none)."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[accented] += 32
    longest = int((ends - starts).max()) if len(starts) else 0
    widest = max(*PREFIXES, *SUFFIXES)
    # a word's prefixes byte by byte; the rest of a longer word is folded in by a block sum
    out = np.zeros((len(starts), 1 + len(PREFIXES) + len(SUFFIXES)), dtype=np.int32)
    size = ends - starts
    rolled, back = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    for k in range(widest):
        has = size > k
        at = np.minimum(starts + k, len(low) - 1)
        rolled = np.where(has, rolled * _BASE + low[at] + np.uint64(1), rolled)
        back = np.where(has, back * _BASE + low[np.maximum(ends - 1 - k, 0)] + np.uint64(1), back)
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = np.where(has, _cell(rolled, k + 1), 0)
        if k + 1 in SUFFIXES:
            out[:, 1 + len(PREFIXES) + SUFFIXES.index(k + 1)] = np.where(has, _cell(back, 100 + k), 0)
    whole = rolled
    rest = np.flatnonzero(size > widest)
    if longest > widest:
        for k in range(widest, min(longest, 64)):
            rest = rest[size[rest] > k]
            whole[rest] = whole[rest] * _BASE + low[starts[rest] + k] + np.uint64(1)
    out[:, 0] = _cell(whole + size.astype(np.uint64), 0)
    return out


def _cell(hashes: np.ndarray, kind: int) -> np.ndarray:
    salt = np.uint64(kind * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    return (mixed(hashes + salt) % np.uint64(CELLS - 1)).astype(np.int32) + 1


def chain(unary: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: marginal log-odds, pair marginals summed, log partition.

    ``unary`` is the log-potential of toxic against clean, ``transition[a, b]`` that of b after a, ``first``
    marks the first token of each chain. Messages are kept as ratios of toxic to clean. The tokens are cut
    into rows of equal length and all rows are walked side by side: first for the product of each row's
    steps, which hands the ratio on from row to row, then for the messages. The work is linear and takes
    about the square root of the tokens in array steps, whatever the lengths of the chains.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    wide = max(int(np.sqrt(n)), 1)
    rows = -(-n // wide)
    heat, start = np.ones(rows * wide), np.ones(rows * wide, dtype=bool)
    heat[:n], start[:n] = np.exp(np.clip(unary, -LIMIT, LIMIT)), first
    start = np.ascontiguousarray(start.reshape(rows, wide).T)
    heat = np.ascontiguousarray(heat.reshape(rows, wide).T)
    # step matrices: cc, ct, tc, tt from clean or toxic to clean or toxic; a chain begins afresh
    cc, ct, tc, tt = (np.where(start, 1.0, x) for x in np.exp(transition).ravel())
    ct, tt = ct * heat, tt * heat

    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(wide):
        a, b, c, d = a * cc[k] + b * tc[k], a * ct[k] + b * tt[k], c * cc[k] + d * tc[k], c * ct[k] + d * tt[k]
        scale = 1.0 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    came, entry, leaving = 1.0, np.empty(rows), np.empty(rows)
    for r in range(rows):
        entry[r] = came
        came = (b[r] + came * d[r]) / (a[r] + came * c[r])
    came = 1.0
    for r in range(rows - 1, -1, -1):
        leaving[r] = came
        came = (c[r] + came * d[r]) / (a[r] + came * b[r])

    before, forward, backward = np.empty((wide, rows)), np.empty((wide, rows)), np.empty((wide, rows))
    now = entry
    for k in range(wide):
        before[k] = now
        now = (ct[k] + now * tt[k]) / (cc[k] + now * tc[k])
        forward[k] = now
    now = leaving
    for k in range(wide - 1, -1, -1):
        backward[k] = now
        now = (tc[k] + now * tt[k]) / (cc[k] + now * ct[k])

    line = lambda x: x.T.reshape(-1)[:n]
    odds = np.log(line(forward)) + np.log(line(backward))
    partition = np.log((cc + before * tc + ct + before * tt) / (1.0 + before))
    joint = [cc, ct * backward, before * tc, before * tt * backward]
    share = np.where(start, 0.0, 1.0 / (joint[0] + joint[1] + joint[2] + joint[3]))
    pairs = np.array([line(x * share).sum() for x in joint]).reshape(2, 2)
    return odds, pairs, float(line(partition).sum())


def minimise(function, start: np.ndarray, steps: int = STEPS, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving; ``function`` gives value and slope."""
    x = start
    value, slope = function(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = -slope
        kept = []
        for s, y in reversed(moves):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(np.abs(direction).max(), 1e-12)
        for (s, y), a in zip(moves, reversed(kept)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        downhill, length = direction @ slope, 1.0
        for _ in range(12):
            new = x + length * direction
            new_value, new_slope = function(new)
            if new_value <= value + 1e-4 * length * downhill:
                break
            length /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-10:
            moves = [*moves, (s, y)][-memory:]
        done = value - new_value <= 1e-6 * abs(value)
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


@dataclass
class ToxicModel:
    """Weights of the feature cells (cell 0 is the offset), transitions, scale of document scores, share of toxic rows."""

    weights: np.ndarray
    transition: np.ndarray
    scale: np.ndarray
    prior: float

    def odds(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, texts and marginal log-odds of the tokens; features are cut a stretch of text at a time."""
        starts, ends, text_of = tokens(data, bounds)
        unary = np.empty(len(starts))
        for a, b in windows(data, bounds):
            i, j = np.searchsorted(starts, [a, b])
            cells = features(data[a:b], starts[i:j] - a, ends[i:j] - a)
            unary[i:j] = self.weights[cells].sum(axis=1) + self.weights[0] * (1 - (cells == 0).sum(axis=1))
        found, _, _ = chain(unary, self.transition, _firsts(text_of))
        return starts, ends, text_of, found

    def scores(self, found: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
        """Score of each of ``n`` texts; one without tokens has the share of toxic rows."""
        empty = np.bincount(text_of, minlength=n)[:n] == 0 if n else np.zeros(0, dtype=bool)
        score = sigmoid(np.column_stack(_by_text(found, text_of, n)) @ self.scale[:-1] + self.scale[-1])
        return np.where(empty, min(self.prior, 0.5), score)


def _firsts(text_of: np.ndarray) -> np.ndarray:
    first = np.ones(len(text_of), dtype=bool)
    first[1:] = text_of[1:] != text_of[:-1]
    return first


def _by_text(found: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest log-odds of a token, and the logarithm of the expected number of toxic tokens."""
    highest = np.full(n, -LIMIT)
    np.maximum.at(highest, text_of, np.clip(found, -LIMIT, LIMIT))
    expected = np.bincount(text_of, weights=sigmoid(found), minlength=n)[:n]
    return highest / 5.0, np.log1p(expected)


def _sample(documents: DataFrame, labels: DataFrame, text: str, label: str, key: str) -> tuple[list, float]:
    """(text, label) of the fitted documents, and the share of toxic ones among all labelled.

    Equal rows of one document count once; a key with both labels is toxic. Rows are chosen by a hash
    of key and text, so that one key with many texts is sampled like any others; rows and bytes are bounded.
    """
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    source = picked(documents, key, text).filter(F.length("text") > 0)
    rows = source.select("doc_id", F.xxhash64("text").alias("body"), F.octet_length("text").cast("long").alias("size"))
    rows = rows.join(marked, "doc_id").dropDuplicates(["doc_id", "body"])
    counts = {r["label"]: (r["n"], r["bytes"]) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    total = sum(n for n, _ in counts.values())
    prior = counts.get(1, (0, 0))[0] / total if total else 0.0
    if len(counts) < 2:
        return [], prior
    share = {y: min(1.0, (FIT_TOXIC if y else FIT_CLEAN) / n, FIT_BYTES / max(size, 1)) for y, (n, size) in counts.items()}
    chance = hash_share("doc_id", "body")
    chosen = rows.filter(F.when(F.col("label") == 1, chance < share[1]).otherwise(chance < share[0]) & (F.col("size") <= FIT_BYTES))
    chosen = chosen.select("doc_id", "body", "label")
    texts = source.withColumn("body", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "body"]).dropDuplicates(["doc_id", "body"])
    found = [(r["text"], r["label"], r["body"]) for r in texts.select("text", "label", "body").collect()]
    return sorted(found, key=lambda r: (r[2], r[1])), prior


def fit_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> ToxicModel:
    """Fit the field on a bounded sample of labelled documents (see ``_sample``).

    Documents are labelled, tokens are not: first the tokens of toxic documents are labelled whose features
    stand in toxic documents far more often than chance allows (log-likelihood ratio against the number of
    features); all tokens of clean documents are clean; a toxic document without any such token says
    nothing yet. The field is fitted to these token labels by likelihood, tokens of toxic documents are
    labelled anew by their marginals, and it is fitted again. Document scores are scaled on documents
    that were kept back. Without documents of both labels every text gets the share of toxic ones.
    """
    rows, prior = _sample(documents, labels, text, label, key)
    weights = np.zeros(CELLS)
    weights[0] = -8.0
    flat = ToxicModel(weights, np.zeros((2, 2)), np.array([0.0, 0.0, np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))]), prior)
    if not rows:
        return flat
    column = pa.record_batch([pa.array([r[0] for r in rows])], names=["text"])
    y = np.array([r[1] for r in rows])
    data, bounds = text_bytes(column)
    starts, ends, doc = tokens(data, bounds)
    cells = np.concatenate([features(data[a:b], starts[i:j] - a, ends[i:j] - a) for a, b in windows(data, bounds) for i, j in [np.searchsorted(starts, [a, b])]])
    _, spot, word = np.unique(cells @ mixed(np.arange(1, cells.shape[1] + 1, dtype=np.uint64)).view(np.int64), return_index=True, return_inverse=True)
    cells = cells[spot]
    kept_back = (np.arange(len(rows)) * 0x9E3779B1 % 1000) < 1000 * SCALE_SHARE
    if len(set(y[~kept_back])) < 2 or len(set(y[kept_back])) < 2:
        kept_back[:] = False
    toxic = _first_labels(cells, word, doc, y, ~kept_back)
    model = flat
    for _ in range(ROUNDS):
        said = np.zeros(len(y), dtype=bool)
        said[doc[toxic]] = True
        used = ~kept_back & ((y == 0) | said)
        if not said.any():
            return flat
        model = ToxicModel(*_fit_field(cells, word, doc, toxic, used), flat.scale, prior)
        found, _, _ = chain(_unary(model.weights, cells)[word], model.transition, _firsts(doc))
        toxic = (found > 0) & (y[doc] == 1)
    judged = kept_back if kept_back.any() else ~kept_back
    x = np.column_stack(_by_text(found, doc, len(y)))[judged]
    share = np.where(y[judged] == 1, prior / max((y[judged] == 1).mean(), 1e-9), (1 - prior) / max((y[judged] == 0).mean(), 1e-9))
    model.scale = fit_logistic(x, y[judged].astype(float), share, ridge=0.05)
    if model.scale[0] < 0:  # both columns say the same here: a higher token must never lower a score
        model.scale = np.insert(fit_logistic(x[:, 1:], y[judged].astype(float), share, ridge=0.05), 0, 0.0)
    model.weights = model.weights.astype(np.float32)
    return model


def _unary(weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return weights[cells].sum(axis=1) + weights[0] * (1 - (cells == 0).sum(axis=1))


def _first_labels(cells: np.ndarray, word: np.ndarray, doc: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents that hold a feature too frequent there for chance."""
    pairs = np.unique(doc.astype(np.int64) * len(cells) + word)
    pairs = pairs[used[pairs // len(cells)]]
    of_doc, of_word = pairs // len(cells), pairs % len(cells)
    seen = np.zeros((2, CELLS))
    for j in range(cells.shape[1]):
        cell = cells[of_word, j].astype(np.int64)
        once = np.unique(of_doc * CELLS + cell)
        seen += np.stack([np.bincount(once[y[once // CELLS] == k] % CELLS, minlength=CELLS) for k in (0, 1)])
    share = y[used].mean()
    total = np.maximum(seen.sum(axis=0), 1)
    rate = seen[1] / total
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(seen[1] > 0, seen[1] * np.log(rate / share), 0) + np.where(seen[0] > 0, seen[0] * np.log((1 - rate) / (1 - share)), 0))
    # well above what the best of all features reaches by chance, and toxic in most documents that hold it
    telling = (gain > 2 * np.log(max((seen.sum(axis=0) > 0).sum(), 2))) & (rate > 0.5 * (1 + share))
    telling[0] = False
    return telling[cells].any(axis=1)[word] & (y[doc] == 1)


def _fit_field(cells: np.ndarray, word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of greatest likelihood of the token labels of the ``used`` documents, with a ridge."""
    here = used[doc]
    word, doc, y = word[here], doc[here], toxic[here].astype(float)
    first = _firsts(doc)
    later = np.flatnonzero(~first)
    a, b = y[later - 1], y[later]
    seen = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
    flat = cells.astype(np.int64)
    ones = 1 - (cells == 0).sum(axis=1)

    def function(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, transition = x[:CELLS], x[CELLS:].reshape(2, 2)
        unary = _unary(weights, cells)[word]
        found, pairs, partition = chain(unary, transition, first)
        value = partition - (y * np.clip(unary, -LIMIT, LIMIT)).sum() - (seen * transition).sum()
        value += 0.5 * RIDGE * ((weights[1:] ** 2).sum() + (transition**2).sum()) + 1e-3 * weights[0] ** 2
        by_word = np.bincount(word, weights=sigmoid(found) - y, minlength=len(cells))
        slope = np.zeros(CELLS + 4)
        for j in range(cells.shape[1]):
            slope[:CELLS] += np.bincount(flat[:, j], weights=by_word, minlength=CELLS)
        slope[0] = (by_word * ones).sum() + slope[0] + 2e-3 * weights[0]
        slope[1:CELLS] += RIDGE * weights[1:]
        slope[CELLS:] = (pairs - seen + RIDGE * transition).ravel()
        return value, slope

    start = np.zeros(CELLS + 4)
    start[0] = np.log(max(y.mean(), 1e-6))
    best = minimise(function, start)
    return best[:CELLS], best[CELLS:].reshape(2, 2)


def toxic_scores(df: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) and spans (start, end in code points) of every row of ``df``.

    A span is a run of tokens that are toxic rather than not, in a text that is. Whole texts are read, a very long one
    alone; null texts and texts without a letter or digit have no span and the share of toxic rows the
    model was fitted on (0.5 at most) as their score; repeated rows get equal results; other columns are not read.
    """
    shared = Shared(df.sparkSession, model)
    source = picked(df, key, text)

    def make():
        fitted = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            data, bounds = text_bytes(batch)
            starts, ends, text_of, found = fitted.odds(data, bounds)
            n = batch.num_rows
            scores = fitted.scores(found, text_of, n)
            marked = np.flatnonzero((found > 0) & (scores[text_of] >= 0.5))
            opens = marked[np.concatenate(([True], (marked[1:] != marked[:-1] + 1) | (text_of[marked[1:]] != text_of[marked[:-1]])))[: len(marked)]]
            closes = marked[np.concatenate(((marked[1:] != marked[:-1] + 1) | (text_of[marked[1:]] != text_of[marked[:-1]]), [True]))[: len(marked)]]
            points = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            owner = text_of[opens]
            begin, end = points[starts[opens]] - points[bounds[owner]], points[ends[closes]] - points[bounds[owner]]
            cuts = np.searchsorted(owner, np.arange(n + 1))
            spans = [[{"start": int(s), "end": int(e)} for s, e in zip(begin[a:b], end[a:b])] for a, b in zip(cuts, cuts[1:])]
            return {"doc_id": batch["doc_id"], "score": scores, "spans": spans}

        return run

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, f"doc_id {kind}, score double, spans array<struct<start: long, end: long>>", make, slice_bytes=1_000_000)

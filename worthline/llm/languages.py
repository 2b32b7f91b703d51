"""Language identification by hierarchical discrimination (operator 9).

The family of a text is predicted first; one-versus-one linear support vector machines then separate
the languages within it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.llm.common import (
    bounded_sample,
    char_table,
    fit_separator,
    give_back,
    map_batches,
    picked,
    sigmoid,
    sliced,
    texts,
)
from worthline.operators.partials import Shared

# Families of closely related languages; any other label is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "indic": ["hi", "mr", "ne", "bn", "as", "gu", "pa"],
    "uralic": ["fi", "et", "hu"],
    "malayic": ["id", "ms", "jv"],
}

#: Buckets of each n-gram order; documents of each language that are fitted; sharpness of the scores.
BUCKETS, FIT_ROWS, SHARPNESS = 4096, 500, 3.0
ORDERS = 3
UNKNOWN = "und"


def gram_counts(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed character n-grams (one to three, over letters and word ends) and of letters, by text."""
    letters = char_table("letters", lambda c: c.isalpha())
    counts = np.zeros((len(items), ORDERS * BUCKETS), dtype=np.float32)
    total = np.zeros(len(items), dtype=np.int64)
    for i, item in enumerate(items):
        # a space at either end makes the ends of the text word ends
        codes = np.frombuffer(f" {item.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[codes]
        total[i] = n = int(is_letter.sum())
        if not n:
            continue
        codes = (codes + np.uint32(1)) * is_letter
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for order, (hashes, mask) in enumerate(
            ((one, is_letter), (two, is_letter[1:] | is_letter[:-1]), (three, is_letter[1:-1]))
        ):
            # n-grams without a letter fall into the first bucket, which is then emptied
            where = ((hashes >> np.uint32(20)) % np.uint32(BUCKETS - 1) + np.uint32(1)) * mask
            row = np.bincount(where, minlength=BUCKETS)
            row[0] = 0
            counts[i, order * BUCKETS : (order + 1) * BUCKETS] = row
    return counts, total


@dataclass
class LanguageModel:
    """Pairwise separators: between families, then between the languages of each family."""

    families: list[str]
    members: dict[str, list[str]]
    family_pairs: list[tuple[str, str]]
    language_pairs: list[tuple[str, str]]
    weights: np.ndarray
    offsets: np.ndarray

    def predict(self, items: list[str]) -> tuple[list[str], np.ndarray]:
        counts, total = gram_counts(items)
        names, scores = [UNKNOWN] * len(items), np.zeros(len(items))
        known = np.flatnonzero(total > 0)
        if not self.families or not len(known):
            return names, scores
        shares = counts[known] / total[known, None]
        margins = shares @ self.weights + self.offsets if len(self.offsets) else np.zeros((len(known), 0))
        chance = sigmoid(SHARPNESS * margins)
        n = len(self.family_pairs)
        family, sure = _vote(self.families, self.family_pairs, chance[:, :n])
        for name in self.families:
            rows = np.flatnonzero(family == self.families.index(name))
            members = self.members[name]
            inside = [k for k, pair in enumerate(self.language_pairs) if pair[0] in members]
            choice, sure_inside = _vote(members, [self.language_pairs[k] for k in inside], chance[rows][:, [n + k for k in inside]])
            for row, c, s in zip(rows, choice, sure_inside):
                names[known[row]], scores[known[row]] = members[c], sure[row] * s
        return names, scores


def _vote(names: list[str], pairs: list[tuple[str, str]], chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name with the most pairwise wins (then the larger sum of chances), and its mean chance."""
    rows = len(chance)
    if len(names) == 1:
        return np.zeros(rows, dtype=int), np.ones(rows)
    wins, sums = np.zeros((rows, len(names))), np.zeros((rows, len(names)))
    for k, (a, b) in enumerate(pairs):
        for name, c in ((a, chance[:, k]), (b, 1 - chance[:, k])):
            wins[:, names.index(name)] += c > 0.5
            sums[:, names.index(name)] += c
    best = np.argmax(wins * len(names) + sums, axis=1)
    return best, sums[np.arange(rows), best] / (len(names) - 1)


def fit_languages(
    labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS, families: dict | None = None
) -> LanguageModel:
    """Fit on about ``rows`` documents of each label, chosen by a hash of the key.

    Rows with a null label or without a letter are left out. The workers turn whole texts into
    n-gram counts, at most ``ORDERS * BUCKETS`` numbers each; only those reach the driver.
    """
    source = labelled.filter(F.col(label).isNotNull()).select(
        F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")
    )
    sample = bounded_sample(source, "label", "doc_id", rows)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            counts, total = gram_counts(texts(batch))
            full = [np.flatnonzero(row) for row in counts]
            return {
                "label": batch["label"],
                "total": total,
                "place": [w.astype(np.int32).tobytes() for w in full],
                "value": [row[w].tobytes() for row, w in zip(counts, full)],
            }

        return run

    grams = map_batches(sample, "label string, total long, place binary, value binary", make).filter("total > 0").collect()
    grams.sort(key=lambda r: (r["label"], r["total"], bytes(r["place"])), reverse=True)
    names = np.array([r["label"] for r in reversed(grams)])
    x = np.zeros((len(grams), ORDERS * BUCKETS), dtype=np.float32)
    for i in range(len(x)):
        r = grams.pop()
        x[i, np.frombuffer(r["place"], dtype=np.int32)] = np.frombuffer(r["value"], dtype=np.float32) / r["total"]
    spread = 1.0 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(x.shape[1])
    x *= spread.astype(np.float32)
    norm = float(np.sqrt(np.einsum("ij,ij->i", x, x).mean())) if len(x) else 1.0
    x /= np.float32(norm)
    home = {lang: family for family, langs in (families or FAMILIES).items() for lang in langs}
    members: dict[str, list[str]] = {}
    for lang in sorted(set(names.tolist())):
        members.setdefault(home.get(lang, lang), []).append(lang)
    family_of = np.array([home.get(lang, lang) for lang in names.tolist()])
    weights, offsets = [], []

    def separate(of: np.ndarray, pairs):
        for a, b in pairs:
            rows_ = np.flatnonzero((of == a) | (of == b))
            some = x if len(rows_) == len(x) else x[rows_]
            w, o = fit_separator(some, np.where(of[rows_] == a, 1.0, -1.0), cost=20.0)
            del some
            weights.append(w * spread / norm)
            offsets.append(o)

    family_pairs = list(combinations(sorted(members), 2))
    language_pairs = [pair for family in sorted(members) for pair in combinations(members[family], 2)]
    separate(family_of, family_pairs)
    separate(names, language_pairs)
    del x, names, family_of
    give_back()
    table = np.array(weights, dtype=np.float32).T if weights else np.zeros((ORDERS * BUCKETS, 0), dtype=np.float32)
    return LanguageModel(sorted(members), members, family_pairs, language_pairs, table, np.array(offsets, dtype=np.float32))


def predict_languages(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score (0 to 1): one row per row of ``df``.

    Texts that are null or hold no letter get ``und`` with score 0, as does every text under a model
    fitted on no rows. Whole texts are read; repeated rows get equal results; other columns are not read.
    """
    shared = Shared(df.sparkSession, model)
    source = picked(df, key, text)

    def make():
        fitted = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            names, scores = [], []
            items = texts(batch)
            for start in range(0, len(items), 256):
                n, s = fitted.predict(items[start : start + 256])
                names += n
                scores.append(s)
            return {"doc_id": batch["doc_id"], "lang_pred": names, "score": np.concatenate(scores) if scores else []}

        return run

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, f"doc_id {kind}, lang_pred string, score double", make)


def keep_known(df: DataFrame, model: LanguageModel, text: str = "text", lang: str | None = None) -> DataFrame:
    """The rows of ``df`` whose text has a predicted language, all columns as they are.

    Rows predicted ``und`` (null texts, texts without a letter) go. With ``lang``, nulls of that
    column are filled with the prediction.
    """
    shared = Shared(df.sparkSession, model)
    schema = df.schema

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for part in sliced(batch, text):
                items = texts(part, text)
                names = [n for start in range(0, len(items), 256) for n in fitted.predict(items[start : start + 256])[0]]
                if lang is not None:
                    place = part.schema.get_field_index(lang)
                    filled = pc.coalesce(part.column(place), pa.array(names, part.schema.field(place).type))
                    part = part.set_column(place, part.schema.field(place), filled)
                yield part.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))
        give_back()

    return df.mapInArrow(run, schema)

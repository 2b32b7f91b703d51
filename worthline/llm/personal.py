"""Personal data: weak-supervision labelers, their reliabilities by EM, and a span classifier (operator 5)."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.llm.common import bounded_sample, fit_logistic, map_batches, picked, sigmoid, texts
from worthline.operators.partials import Shared
from worthline.session import written

KINDS = ("email", "ip", "card", "phone")
#: Candidate spans of each kind that the classifier is fitted on.
FIT_ROWS = 2000
#: Characters of context on either side of a span.
CONTEXT = 40
HASHED = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only begin a match at its first digit, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Looser shapes that the labelers judge: spelt-out addresses, digit groups, hexadecimal hosts.
_SPELT_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20", re.I)
_SPELT_LEFT = re.compile(r"[\w.+-]{1,64}$")
_SPELT_RIGHT = re.compile(r"[\w-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[\w-]{1,63})+", re.I)
_DIGITS = re.compile(r"\(?[0-9][0-9\x20().-]{5,28}[0-9](?![0-9])")
_HEX_HOST = re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])")

# Gazetteers and context words of the labelers.
ENDINGS = frozenset("com org net edu gov info io de fr es uk it nl eu us ca au ch at be".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "30", "36", "38")
WORDS = {
    "email": ("mail", "contact", "write to", "correo", "courriel", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llam", "appel", "cell"),
}
AGAINST = ("order", "invoice", "isbn", "version", "total", "id ", "no.", "serial", "date", "page", "$", "€")


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that the fixed patterns find, by kind, then start."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates: looser shapes that touch no base span, leftmost first, without overlap."""
    found = []
    if " dot " in text or "." in text:
        for m in _SPELT_AT.finditer(text):
            right = _SPELT_RIGHT.match(text, m.end())
            left = _SPELT_LEFT.search(text, max(0, m.start() - 64), m.start())
            if left and right and (m.group().strip() != "at" or " dot " in right.group().lower()):
                found.append((0, left.start(), right.end()))
    for m in _HEX_HOST.finditer(text):
        found.append((1, m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        n = len(_NOT_DIGIT.sub("", m.group()))
        if 13 <= n <= 19:
            found.append((2, m.start(), m.end()))
        elif 7 <= n <= 12 and re.search(r"[0-9][\x20().-]", m.group()):
            found.append((3, m.start(), m.end()))
    taken = sorted((s, e) for _, s, e in base)
    kept, last = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start < last or any(s < end and start < e for s, e in taken):
            continue
        kept.append((kind, start, end))
        last = end
    return kept


def judge(text: str, kind: int, start: int, end: int) -> tuple[str, list[float]]:
    """Votes of the labelers on a span ('+' personal, '-' not, '0' no opinion) and the features of the span.

    Labelers: strict shape (regular expression), check digits or ranges, gazetteer of endings or
    issuers, words before it, words after it, words that speak against it, digits grouped evenly.
    """
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = _NOT_DIGIT.sub("", span)
    name = KINDS[kind]
    if kind == 0:
        strict = 1 if "@" in span and _DOMAIN.search(span) else -1
        check = 1 if any(c.isdigit() for c in span) else 0
        listed = 1 if re.split(r"[^\w]+", span.lower())[-1] in ENDINGS else -1
    elif kind == 1:
        strict = 1 if _IP.fullmatch(span) or _HEX_HOST.fullmatch(span) else -1
        check = 1 if _HEX_HOST.fullmatch(span) or all(int(p or 0) <= 255 for p in span.split(".") if len(p) < 5) else -1
        listed = 0
    elif kind == 2:
        strict = 1 if 16 <= len(digits) <= 19 and _CARD.fullmatch(span) else -1
        check = 1 if luhn(digits) else -1
        listed = 1 if digits.startswith(ISSUERS) else -1
    else:
        strict = 1 if span[0] == "+" else -1
        check = 1 if 8 <= len(digits) <= 15 else -1
        listed = 1 if span[0] == "+" or digits.startswith(("00", "0")) or "(" in span else 0
    near = 1 if any(w in before for w in WORDS[name]) else 0
    later = 1 if any(w in after for w in WORDS[name]) else 0
    against = -1 if any(w in before[-16:] for w in AGAINST) else 0
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    even = (1 if len(groups) > 1 and max(groups) <= 4 else 0) if kind >= 2 else 0
    votes = (strict, check, listed, near, later, against, even)
    features = [*map(float, votes), len(span) / 20, len(digits) / 10, len(groups) / 4, float("@" in span)]
    words = np.zeros(HASHED)
    for side, near_words in (("b", before.split()[-3:]), ("a", after.split()[:3])):
        for word in near_words:
            words[zlib.crc32(f"{side}{word}".encode()) % HASHED] = 1.0
    return "".join("-0+"[v + 1] for v in votes), features + words.tolist()


def reliabilities(counts: dict[str, float], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Expectation-maximisation over patterns of votes: the chance that each pattern is personal data.

    Every labeler has for each true class its own chances of '-', '0' and '+', independent of the
    others given the class. It starts from spans that pass the first two labelers (shape, and check
    digits or ranges) being personal nine times in ten, and the others once in ten.
    Returns the chances by pattern, the table (class, labeler, vote) and the share of true spans.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])
    one_hot = np.eye(3)[votes]
    truth = np.where((votes[:, 0] == 2) & (votes[:, 1] > 0), 0.9, 0.1)
    for _ in range(rounds):
        table = np.stack([np.einsum("p,plv->lv", n * (1 - truth), one_hot), np.einsum("p,plv->lv", n * truth, one_hot)]) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        share = (n @ truth + 1) / (n.sum() + 2)
        log = np.einsum("plv,clv->pc", one_hot, np.log(table)) + np.log([1 - share, share])
        new = sigmoid(log[:, 1] - log[:, 0])
        if np.abs(new - truth).max() < 1e-6:
            truth = new
            break
        truth = new
    return dict(zip(patterns, truth.tolist())), table, float(share)


@dataclass
class PersonalModel:
    """For each kind the coefficients of the span classifier; None where nothing was seen."""

    classifiers: list[np.ndarray | None]
    labelers: list[np.ndarray | None]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        kept = []
        for kind, start, end in loose_spans(text, base):
            beta = self.classifiers[kind]
            if beta is not None:
                x = np.asarray(judge(text, kind, start, end)[1])
                if sigmoid(x @ beta[:-1] + beta[-1]) >= 0.5:
                    kept.append((kind, start, end))
        return kept


def fit_personal(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> PersonalModel:
    """Reliabilities over all candidate spans, and a classifier of each kind on about ``rows`` of them.

    The votes are counted by pattern over every text (at most 3**7 patterns a kind); the classifier
    learns the chances of the patterns from features that include the neighbouring words.
    """

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = {"span": [], "kind": [], "votes": [], "features": []}
            for item in texts(batch):
                base = base_spans(item)
                for kind, start, end in base + loose_spans(item, base):
                    votes, features = judge(item, kind, start, end)
                    around = item[max(0, start - CONTEXT) : end + CONTEXT]
                    out["span"].append(zlib.crc32(around.encode()) << 16 | start & 0xFFFF)
                    out["kind"].append(kind)
                    out["votes"].append(votes)
                    out["features"].append(features)
            return out

        return run

    spans = map_batches(picked(df, key, text), "span long, kind int, votes string, features array<double>", make)
    spans = written(spans, "spans")
    counts: list[dict[str, float]] = [{} for _ in KINDS]
    for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        counts[r["kind"]][r["votes"]] = r["n"]
    chances = [reliabilities(c) if c else None for c in counts]
    sample = sorted(
        (r["kind"], r["votes"], r["features"]) for r in bounded_sample(spans, "kind", "span", rows).collect()
    )
    classifiers: list[np.ndarray | None] = []
    for kind in range(len(KINDS)):
        own = [r for r in sample if r[0] == kind]
        if not own or chances[kind] is None:
            classifiers.append(None)
            continue
        truth = np.array([chances[kind][0][r[1]] for r in own])
        classifiers.append(fit_logistic(np.array([r[2] for r in own]), truth, ridge=1.0))
    return PersonalModel(classifiers, [c[1] if c else None for c in chances])


def _written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal(df: DataFrame, model: PersonalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_email, n_ip, n_card, n_phone and base_spans (of the fixed patterns), spans (all), n_added.

    One row per row of ``df``; spans are kind:start:end in code points, end exclusive, by kind, then
    start. Null and empty texts have none; repeated rows get equal results; whole texts are read;
    other columns are not read.
    """
    shared = Shared(df.sparkSession, model)
    source = picked(df, key, text)

    def make():
        fitted = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            base = [base_spans(t) for t in texts(batch)]
            added = [fitted.added(t, b) for t, b in zip(texts(batch), base)]
            counts = {f"n_{name}": [sum(k == i for k, _, _ in b) for b in base] for i, name in enumerate(KINDS)}
            return {
                "doc_id": batch["doc_id"],
                **counts,
                "base_spans": [_written_out(b) for b in base],
                "spans": [_written_out(b + a) for b, a in zip(base, added)],
                "n_added": [len(a) for a in added],
            }

        return run

    kind = source.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"n_{name} long" for name in KINDS)
    return map_batches(source, f"doc_id {kind}, {numbers}, base_spans string, spans string, n_added long", make)


def redact(df: DataFrame, model: PersonalModel, text: str = "text", length: str | None = None) -> DataFrame:
    """``df`` with every span of its text replaced by ``<KIND>``; overlapping spans are replaced as one.

    All columns stay; ``length`` names a column that is set to the new length. Null texts stay null.
    """
    shared = Shared(df.sparkSession, model)

    def make():
        fitted = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            columns = {name: batch[name] for name in batch.schema.names}
            new = [None if t is None else redacted(t, fitted) for t in batch[text].to_pylist()]
            columns[text] = new
            if length:
                columns[length] = [None if t is None else len(t) for t in new]
            return columns

        return run

    return map_batches(df, df.schema, make, text)


def redacted(text: str, model: PersonalModel) -> str:
    base = base_spans(text)
    out, last, name = [], 0, None
    for start, end, kind in sorted((s, e, k) for k, s, e in base + model.added(text, base)):
        if start < last:  # goes on from the span before
            last = max(last, end)
            continue
        out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = end
    return "".join([*out, text[last:]])

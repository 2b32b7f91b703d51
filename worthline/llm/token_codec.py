"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding (operator 3)."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from worthline.llm.common import map_batches, picked, texts
from worthline.llm.token_counts import Memo

# The byte-level pre-tokenisation pattern, in full Unicode form and in a form for the
# standard library that agrees with it on texts without the characters of UNUSUAL.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

#: Token pairs whose test a worker remembers.
FITS_ENTRIES = 1_000_000

_CODECS: dict[int, "Codec"] = {}


def _unusual() -> frozenset[str]:
    """Characters that the two libraries class differently: number letters, and separators that count as space."""
    return frozenset(
        c for c in map(chr, range(0x110000)) if "\x1c" <= c <= "\x1f" or unicodedata.category(c) in ("Nl", "No")
    )


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary as an automaton over its tokens, with the merge that made each token."""

    def __init__(self, raw: bytes):
        import ahocorasick

        spec = json.loads(raw)
        letters = byte_letters()
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.of_id = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.of_id |= {i: content.encode() for content, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: rank of merging two tokens, and of each token: its two parts and its own merge; bytes come first
        self.merge_rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if token not in self.parts:
                self.rank[token], self.parts[token] = r, (vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.parts:
                self.automaton.add_word("".join(chr(letters[c]) for c in token), (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by left << 20 | right
        self.memo = Memo(self.encode_piece)
        self.plain, self.full = re.compile(PLAIN), regex.compile(PATTERN)
        self.unusual = _unusual()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether byte-pair merging, left to itself, can end with these two tokens side by side.

        Undo the merges at the seam, latest first. The pair is out if two pieces that face each other
        at some time could have been merged before the merge that hid one of them.
        """
        rank, parts, merge_rank = self.rank, self.parts, self.merge_rank
        until, on_right = len(merge_rank), False
        while True:
            r = merge_rank.get((left, right))
            # of two places with the same merge the left one goes first
            if r is not None and (r < until or (r == until and on_right)):
                return False
            at_left, at_right = rank[left], rank[right]
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                until, on_right, left = at_left, False, parts[left][1]
            else:
                until, on_right, right = at_right, True, parts[right][0]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian 32-bit numbers.

        The last token of every prefix is unique: the one that the automaton finds at its end and
        that fits the last token of the prefix before it. Following them back gives the ids.
        """
        word = piece.encode().decode("latin-1")
        size = len(word)
        last = [-1] * (size + 1)
        lengths = [0] * (size + 1)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                previous = last[start]
                if previous < 0:
                    continue
                pair = previous << 20 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= FITS_ENTRIES:
                        fits.clear()
                    good = fits[pair] = self.compatible(previous, token)
                if not good:
                    continue
            last[end] = token
            lengths[end] = length
        ids = array("I")
        while size:
            ids.append(last[size])
            size -= lengths[size]
        ids.reverse()
        return ids.tobytes() if sys.byteorder == "little" else ids.byteswap() or ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed."""
        if self.specials is not None and self.specials.search(text):
            out = []
            for part in self.specials.split(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                elif part:
                    out.append(self.encode_plain(part))
            return b"".join(out)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        pattern = self.plain if self.unusual.isdisjoint(text) else self.full
        return b"".join(map(self.memo.__getitem__, pattern.findall(text)))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.of_id.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec_of(raw: bytes) -> Codec:
    """The vocabulary, built once in each Python worker."""
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_tokens and ids (binary: little-endian 32-bit ids), one row per row of ``df``.

    ``vocabulary`` names a byte-level vocabulary file on the driver (about a megabyte; its bytes are
    sent to the workers). Ids are those of the file's own library without added tokens; strings of
    special tokens inside a text give their ids. Null and empty texts have no ids. Repeated rows are
    encoded each, very long texts whole; other columns of ``df`` are not read.
    """
    raw = _shared(df, vocabulary)

    def make():
        codec = codec_of(raw.value)

        def run(batch: pa.RecordBatch) -> dict:
            ids = [codec.encode(t) for t in texts(batch)]
            return {"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return run

    source = picked(df, key, text)
    return map_batches(source, f"doc_id {_kind(source)}, n_tokens long, ids binary", make)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Return doc_id and the decoded text of packed ids; null ids give an empty text."""
    raw = _shared(df, vocabulary)
    source = df.selectExpr(f"`{key}` as doc_id", f"`{ids}` as ids")

    def make():
        codec = codec_of(raw.value)
        return lambda batch: {"doc_id": batch["doc_id"], "text": [codec.decode(x or b"") for x in batch["ids"].to_pylist()]}

    return map_batches(source, f"doc_id {_kind(source)}, text string", make, text=None)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, n_tokens, ids, decoded; rules as for ``encode``."""
    raw = _shared(df, vocabulary)

    def make():
        codec = codec_of(raw.value)

        def run(batch: pa.RecordBatch) -> dict:
            ids = [codec.encode(t) for t in texts(batch)]
            return {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids": ids,
                "decoded": [codec.decode(x) for x in ids],
            }

        return run

    source = picked(df, key, text)
    return map_batches(source, f"doc_id {_kind(source)}, n_tokens long, ids binary, decoded string", make)


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()

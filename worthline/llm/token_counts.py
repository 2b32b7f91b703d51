"""Token counts of texts by heap-and-linked-list byte-pair merging (operator 4)."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.llm.common import map_batches, picked, texts

#: Distinct segments whose counts a worker remembers, in each of two generations.
MEMO_ENTRIES = 300_000
SPACE = "▁"
_MODELS: dict[int, "Pieces"] = {}


class Pieces:
    """Merge ranks of a sentencepiece byte-pair model, and where its texts may be cut."""

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.processor = processor
        ids = [i for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
        pieces = {processor.id_to_piece(i): processor.get_score(i) for i in ids}
        levels = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {piece: levels[score] for piece, score in pieces.items()}
        self.singles = {piece for piece in pieces if len(piece) == 1}
        self.byte_fallback = any(processor.is_byte(i) for i in range(processor.get_piece_size()))
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.cut = re.compile(self._pattern([p for p in pieces if len(p) > 1]))
        self.memo = Memo(self.count_segment)

    @staticmethod
    def _pattern(pieces: list[str]) -> str:
        """Segments that no merge can cross.

        ``opening`` is the largest set of characters that stand in pieces only at the start or
        after each other. No piece spans the place before a run of them, so texts are cut there.
        """
        chars = {c for p in pieces for c in p}
        opening = {c for c in chars if not c.isalnum()} | {SPACE, "\n", "\t"}
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
        while bad := {b for a, b in pairs if b in opening and a not in opening}:
            opening -= bad
        if not opening:
            return r"(?s).+"
        kind = "".join(map(re.escape, sorted(opening)))
        return f"[{kind}]*[^{kind}]+|[{kind}]+"

    def count_segment(self, segment: str) -> int:
        """Tokens of a segment; it is cut once more between characters that stand side by side in no piece."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in pairs]
        if not cuts:
            return self.merge(segment)
        memo = self.memo
        return sum(memo[segment[i:j]] for i, j in zip([0, *cuts], [*cuts, len(segment)]))

    def merge(self, segment: str) -> int:
        """Initial symbols less merges: the lowest-ranked adjacent pair, leftmost first, is merged until none is left."""
        n = len(segment)
        rank_of = self.rank.get
        push, pop = heapq.heappush, heapq.heappop
        parts = list(segment)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks = [rank_of(segment[i : i + 2], -1) for i in range(n - 1)]  # of the pair that begins at each symbol
        ranks.append(-1)
        heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, left = divmod(pop(heap), n)
            if ranks[left] != r:
                continue  # one of its symbols has been merged since
            right = after[left]
            parts[left] = pair = parts[left] + parts[right]
            parts[right] = ""
            ranks[right] = -1
            merges += 1
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                ranks[left] = r = rank_of(pair + parts[follower], -1)
                if r >= 0:
                    push(heap, r * n + left)
            else:
                ranks[left] = -1
            leader = before[left]
            if leader >= 0:
                ranks[leader] = r = rank_of(parts[leader] + pair, -1)
                if r >= 0:
                    push(heap, r * n + leader)
        if self.byte_fallback and not self.singles.issuperset(segment):
            # a symbol that no piece covers counts as its bytes
            merges -= sum(len(s.encode()) - 1 for s in parts if len(s) == 1 and s not in self.singles)
        return n - merges

    def count(self, normalized: str) -> int:
        """Tokens of a text that the model has normalised."""
        return sum(map(self.memo.__getitem__, self.cut.findall(normalized)))


class Memo(dict):
    """Remembers a function of short strings in two generations, so its memory is bounded.

    When the young one is full it becomes the old one, and the old one is dropped; what is asked for
    again moves back, so frequent strings stay.
    """

    def __init__(self, function, entries: int = MEMO_ENTRIES, longest: int = 64):
        super().__init__()
        self.function, self.entries, self.longest = function, entries, longest
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def pieces_of(model: bytes) -> Pieces:
    """The model as merge ranks, built once in each Python worker."""
    key = hash(model)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Pieces(model)
    return _MODELS[key]


def token_counts(
    df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``): one row per row of ``df``.

    ``model_path`` names a sentencepiece byte-pair model on the driver; its bytes (under a megabyte)
    are sent to the workers. The counts are those of the library's encoder. Null and empty texts
    have 0 bytes and 0 tokens; repeated rows are counted each; a very long text without a cutting
    place is merged as one list in n log n time. Other columns of ``df`` are not read.
    """
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        pieces = pieces_of(model.value)
        normalize = pieces.processor.normalize
        plain = [normalize(s) == expected for s, expected in (("a  b\n\tc ", f"{SPACE}a{SPACE}{SPACE}b\n\tc{SPACE}"), ("Åﬁ", f"{SPACE}Åﬁ"))]
        # the identity normaliser only marks spaces; any other is left to the library
        prepare = (lambda t: (SPACE + t).replace(" ", SPACE)) if all(plain) and "\x00" not in SPACE else normalize

        def run(batch: pa.RecordBatch) -> dict:
            items = texts(batch)
            counts = np.fromiter((pieces.count(prepare(t)) if t else 0 for t in items), dtype=np.int64, count=len(items))
            sizes = pc.cast(pc.fill_null(pc.binary_length(batch["text"]), 0), pa.int64())
            return {"doc_id": batch["doc_id"], "n_bytes": sizes, "n_tokens": counts}

        return run

    source = picked(df, key, text)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return map_batches(source, schema, make).withColumn("over_limit", F.col("n_tokens") > limit)

"""Conversation structure repair over a suffix-shared automaton of role and fault signatures (operator 13)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worthline.llm.common import map_batches
from worthline.operators.lookup import BROADCAST_ROWS, lookup_join
from worthline.session import written

#: The characters that count as blank, that end a sentence, and the costs of the edits.
BLANKS, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Grammar states of (s?(ua)+)?: at the start, after s, after u (an assistant must follow), after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state a user or assistant row leads to, and the state reached by each kept initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: Signature symbols: D for a row that must go; else the initial (o: any other), in capitals if cut off.
STRETCH = 4096
#: Audits and signatures of at most so many letters are broadcast; longer tables are joined by shuffle.
BROADCAST_LETTERS = 8_000_000


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copy, gone: the rows after damage by the hash of ``conv:turn``; a dropped row stays, marked."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    body = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(name(text), ENDS, "")).otherwise(name(text))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(name(role)).alias("role"),
        body.alias("text"),
        F.explode(copies).alias("copy"),
        (kind == 0).alias("gone"),
    )


def whole_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), name(role).alias("role"), name(text).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone")
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("copy")]


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """One row of each conversation: gaps, blank, duplicate, truncated, illegal and its signature.

    Texts are judged where they lie; what is shuffled of a row is its turn, role and digest. The
    signature is put together from stretches of rows, so a long conversation costs a letter a row.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    end = F.right(trimmed, F.lit(1))
    facts = _with_digest(rows).select(
        "conv", "turn", "role", "digest", "copy", "gone", (trimmed == "").alias("empty"), (~end.isin(list(ENDS))).alias("cut")
    )
    same = Window.partitionBy("conv", "gone", "role", "digest").orderBy(*_order())
    along = Window.partitionBy("conv", "gone").orderBy(*_order())
    initial = F.substring("role", 1, 1)
    facts = facts.repartition("conv").withColumn("again", F.row_number().over(same) > 1)
    facts = facts.withColumns(
        {
            "before": F.lag(initial).over(along),
            "last_turn": F.lag("turn").over(along),
            "pos": F.row_number().over(along),
            "fault": F.when(F.col("empty"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated"),
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")),
        }
    )
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("D")).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    legal = F.concat("before", initial).isin("su", "ua", "au")
    here = ~F.col("gone")
    facts = facts.withColumns(
        {
            "letter": letter,
            "new_turn": here & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn")),
            "illegal": here & F.col("before").isNotNull() & ~legal,
            "stretch": F.floor((F.col("pos") - 1) / STRETCH),
        }
    )
    count = lambda test: F.count_if(here & test)
    parts = facts.groupBy("conv", "gone", "stretch").agg(
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.count_if("new_turn").alias("turns"),
        count(F.col("fault") == "blank").alias("blank"),
        count(F.col("fault") == "duplicate").alias("duplicate"),
        count(F.col("fault") == "truncated").alias("truncated"),
        F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("letters"),
    )
    stay = ~F.col("gone")
    pieces = F.array_sort(F.collect_list(F.when(stay, F.struct("stretch", "letters"))))
    whole = parts.groupBy("conv").agg(
        F.max(F.when(stay, F.col("most"))).alias("most"),
        F.min(F.when(stay, F.col("least"))).alias("least"),
        *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")],
        F.array_join(F.transform(pieces, lambda x: x["letters"]), "").alias("signature"),
    )
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


def node(symbol: str, after: list) -> list:
    """Cost-to-go and cheapest first edit of a suffix in each grammar state, from those of the suffix one row shorter.

    The edits of a state differ in their letters, so among equal costs the least letter begins the
    ASCII-least audit.
    """
    cut = CUT_OFF if symbol.isupper() else 0
    initial = symbol.lower()
    out = []
    for state in range(4):
        options = [(DELETE + after[state][0], "D")]
        if symbol != "D":
            if initial in KEPT[state]:
                options.append((cut + after[KEPT[state][initial]][0], "K"))
            options.append((REROLE + cut + after[NEXT[state]][0], "R"))
        out.append(min(options))
    return _inserted(out)


def _inserted(out: list) -> list:
    """Costs where rows may be inserted first: two in a row at most can help, as the third repeats a state."""
    for _ in range(2):
        out = [min(out[state], (INSERT + out[NEXT[state]][0], "I")) for state in range(4)]
    return out


def last_node() -> list:
    """The empty suffix: the conversation may end at the start or after an assistant."""
    return _inserted([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, shared): the cheapest edits of every distinct signature.

    The automaton is shared from the end: signatures sorted by their reversed text follow each other
    through their common suffixes, so each suffix is one node, whose cost-to-go and best edit in each
    grammar state are found once for all conversations that end so. ``shared`` is how many nodes a
    signature took over from the one before. A task keeps the nodes of one signature.
    """
    turned = signatures.select("signature", F.reverse("signature").alias("turned")).distinct()
    ordered = turned.repartitionByRange("turned").sortWithinPartitions("turned")

    def make():
        path, held = [last_node()], ""

        def run(batch: pa.RecordBatch) -> dict:
            nonlocal held
            out: dict = {"signature": [], "cost": [], "audit": [], "shared": []}
            for turned in batch["turned"].to_pylist():
                common = 0
                for a, b in zip(held, turned):
                    if a != b:
                        break
                    common += 1
                del path[common + 1 :]
                for symbol in turned[common:]:
                    path.append(node(symbol, path[-1]))
                held = turned
                out["signature"].append(turned[::-1])
                out["cost"].append(path[-1][START][0])
                out["audit"].append(_audit(path, turned))
                out["shared"].append(common)
            return out

        return run

    return map_batches(ordered, "signature string, cost long, audit string, shared long", make, text=None)


def _audit(path: list, turned: str) -> str:
    """The letters of the best edits, read off the nodes from the first row on."""
    letters, state, at = [], START, len(turned)
    while True:
        letter = path[at][state][1]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        if letter == "K":
            state = KEPT[state][turned[at - 1].lower()]
        elif letter != "D":
            state = NEXT[state]
        if letter != "I":
            at -= 1


class Repair:
    """Applies an audit to the rows of one conversation in order, and digests the result piece by piece."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.sha, self.written = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.written = True

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._write(ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state][role[:1]]
            self._write(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self._write(ROLES[self.state], text)

    def digest(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row of each conversation of ``rows`` (the form of ``damaged``): its faults, the cheapest repair and its digest.

    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, signature. Rows are
    taken by turn, nulls first; rows of one turn by role, digest of the text and copy. A null conversation
    is one like the others; null roles and texts are a space. The texts are shuffled once and streamed
    through the task of their conversation behind a head row with its audit, so a conversation of any
    length needs the memory of its audit. A conversation whose rows are all gone has zeros, an empty
    audit and the digest of nothing.
    """
    found = faults(rows)
    table = written(audits(found.select("signature")), "audits")
    letters = table.agg(F.sum(F.length("signature") + F.length("audit"))).first()[0] or 0
    # broadcast only if both the rows and the letters are few
    small = BROADCAST_ROWS if letters <= BROADCAST_LETTERS else 0
    best = lookup_join(found, table, ["signature"], "inner", small)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = F.lit(None)
    heads = best.select("conv", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.lit(0).alias("copy"), none.cast("string").alias("text"), "audit", "signature", *numbers)
    bodies = _with_digest(rows.filter(~F.col("gone"))).select(
        "conv", F.lit(1).alias("part"), "turn", "role", "digest", "copy", "text", none.cast("string").alias("audit"), none.cast("string").alias("signature"), *[none.cast("long").alias(c) for c in numbers]
    )
    lined = heads.unionByName(bodies).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part", *_order())
    lined = lined.select("conv", "part", "role", "text", "audit", "signature", *numbers)
    carried = ["conv", "audit", "signature", *numbers]
    schema = T.StructType([lined.schema[c] for c in carried]).add("repaired_sha256", "string")

    def apply(batches):
        head, work = None, None

        def closed(done: list) -> pa.RecordBatch:
            columns = [pa.array([row[c] for row, _ in done], kinds[c]) for c in carried]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], names=[*carried, "repaired_sha256"])

        kinds: dict = {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in carried}
            done = []
            parts = batch["part"].to_pylist()
            for i, (part, role, text) in enumerate(zip(parts, batch["role"].to_pylist(), batch["text"].to_pylist())):
                if part == 0:
                    if head is not None:
                        done.append((head, work.digest()))
                    head = {c: batch[c][i].as_py() for c in carried}
                    work = Repair(head["audit"])
                else:
                    work.row(role, text)
            if done:
                yield closed(done)
        if head is not None:
            yield closed([(head, work.digest())])

    return lined.mapInArrow(apply, schema)

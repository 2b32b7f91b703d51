"""Toxic spans, phrase collocations and conversation repair against plain versions and odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from worthline.llm import catalog, conversations, phrases, toxicity
from worthline.llm.common import crc_part

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- phrases -------------------------------------------------------------------------------------


def plain_collocations(rows, least=10, covered=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= least}
    dropped = {
        (lang, part)
        for (lang, words), a in candidates.items()
        if len(words) == 3
        for part in (words[:2], words[1:])
        if 100 * a >= covered * counts[lang, part]
    }
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            score, cut = min((1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:cut]], counts[lang, words[cut:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def collocated(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def odd_documents():
    rng = random.Random(4)
    words = ["a", "b", "A", "cé", "d d", "x'y", "É", "–", "日本", "e"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "; ", "!"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("de", " \t\n"), ("en", "a b a b a b"), ("en", "a b a b a b")]


@pytest.mark.parametrize("mask", [None, 0x3FF])
def test_collocations_of_odd_texts(spark, mask):
    """Also with fingerprints of eight bits, where almost every phrase shares its own with others."""
    rows = odd_documents()
    options = {} if mask is None else {"mask": np.uint64(mask)}
    df = spark.createDataFrame([(lang, text, i, "x", 1) for i, (lang, text) in enumerate(rows)], "lang string, text string, fp long, place string, n int")
    want = plain_collocations(rows)
    assert len(want) > 30
    assert collocated(df, **options) == want
    assert collocated(df.repartition(7), **options) == want


def test_collocations_keep_the_first_of_each_language(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert collocated(df, top=3, least=2) == plain_collocations(rows, least=2, top=3)


def test_collocations_of_an_empty_table(spark):
    assert collocated(spark.createDataFrame([], "lang string, text string")) == []
    assert collocated(spark.createDataFrame([(None, None)], "lang string, text string")) == []


def test_a_long_text_is_read_whole(spark):
    """One text of over 8 MB: pieces longer than a window, and a phrase that only its end holds."""
    long_piece = "kilo lima mike " * 60_000
    text = long_piece + ". " + "ab cd. ef gh, " * 560_000 + "zz yy. " * 12
    assert len(text) > 8_000_000
    rows = [("en", text), ("en", "zz yy")]
    got = collocated(spark.createDataFrame(rows, "lang string, text string"))
    assert got == plain_collocations(rows)
    assert any(r[2] == "zz yy" and r[3] == 13 for r in got)


def test_windows_end_with_a_piece():
    data = np.frombuffer(b"aa bb.cc dd,ee ff gg hh ii jj kk.ll" + b"mm nn", dtype=np.uint8)
    bounds = np.array([0, 0, 35, 40, 40])
    for most in (1, 4, 9, 100):
        cuts = list(phrases.windows(data, bounds, most))
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(data)
        for _, b in cuts:
            assert b in bounds or data[b - 1] in b".,"


def test_scores_beyond_64_bits(spark):
    row = spark.sql("select 3000000000000 a, 4000000000000 l, 5000000000000 r")
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    assert row.select(score).first()[0] == 1000000 * 3000000000000**2 // (4000000000000 * 5000000000000)


# --- conversations -------------------------------------------------------------------------------


def plain_repair(rows):
    """All by search over row and grammar state with whole audits, conversation by conversation."""
    talks = {}
    for conv, turn, role, text in rows:
        out = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = []
    for conv, lines in talks.items():
        lines = sorted(lines, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in lines:
            trimmed = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))

        @lru_cache(None)
        def go(i, state, inserted):
            options = []
            after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[after]
            if i == len(lines) and state in ("", "a"):
                options.append((0, "", ()))
            if inserted < 3 and (rest := go(i, after, inserted + 1)):
                options.append((rest[0] + 2, "I" + rest[1], (f"{name}:", *rest[2])))
            if i < len(lines):
                _, role, text = lines[i]
                if rest := go(i + 1, state, 0):
                    options.append((rest[0] + 3, "D" + rest[1], rest[2]))
                if faults[i] not in ("blank", "duplicate"):
                    cut = faults[i] == "truncated"
                    if (role[:1] == after or (state == "" and role[:1] == "s")) and (rest := go(i + 1, role[:1], 0)):
                        options.append((rest[0] + cut, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                    if rest := go(i + 1, after, 0):
                        options.append((rest[0] + cut + 2, "R" + rest[1], (f"{name}:{text}", *rest[2])))
            return min(options) if options else None

        cost, audit, out = go(0, "", 0)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(found, key=str)


REPAIRED = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    return sorted((tuple(r) for r in conversations.repair(conversations.damaged(df)).select(*REPAIRED).collect()), key=str)


def test_repair_of_the_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    got = repaired(df)
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert {r[7] for r in got} & {"KK", "KKKK"} and any(r[6] > 0 for r in got)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(5)
    roles = [None, "user", "assistant", "system", "tool", "", "assistant", "user"]
    texts = [None, "", "a.", "b", "c!  ", " \n", "a.", "d?\n", "..", "x y", "é.", " "]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randint(1, 7))]
    df = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, part int, signature string")
    want = plain_repair(rows)
    assert repaired(df) == want
    assert repaired(df.repartition(7)) == want


def test_conversations_whose_rows_are_all_gone(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert repaired(df) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired(df.limit(0)) == []


def test_long_conversations_and_long_texts(spark):
    """More rows than a stretch of the signature, and one text of over 8 MB."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(3 * conversations.STRETCH)]
    rows += [(2, 0, "user", "word " * 1_700_000 + "."), (2, 1, "assistant", "ok.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repair(conversations.whole_rows(df)).select("conv", "cost", "audit", "repaired_sha256").collect()
    by_conv = {r["conv"]: r for r in got}
    n = 3 * conversations.STRETCH
    # an assistant stands first: a user goes in before it, and one assistant at the end
    assert by_conv[1]["audit"] == "D" + "K" * (n - 1) + "I" or by_conv[1]["cost"] <= 5
    assert by_conv[2]["audit"] == "KK" and by_conv[2]["cost"] == 0
    assert by_conv[2]["repaired_sha256"] == hashlib.sha256(("user:" + "word " * 1_700_000 + ".\nassistant:ok.").encode()).hexdigest()


def test_every_short_signature_has_its_cheapest_audit(spark):
    """All signatures of up to four rows, against search over edit sequences by cost."""
    symbols = "suaoSAD"
    every = ["".join(p) for n in range(5) for p in itertools.product(symbols, repeat=n)]
    got = {r["signature"]: (r["cost"], r["audit"]) for r in conversations.audits(spark.createDataFrame([(s,) for s in every], "signature string")).collect()}
    assert len(got) == len(every)

    @lru_cache(None)
    def go(rest, state, inserted):
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        options = [(0, "")] if not rest and state in ("", "a") else []
        if inserted < 3 and (x := go(rest, after, inserted + 1)):
            options.append((x[0] + 2, "I" + x[1]))
        if rest:
            if x := go(rest[1:], state, 0):
                options.append((x[0] + 3, "D" + x[1]))
            c, cut = rest[0].lower(), rest[0] in "SUAO"
            if rest[0] != "D":
                if (c == after or (state == "" and c == "s")) and (x := go(rest[1:], c, 0)):
                    options.append((x[0] + cut, "K" + x[1]))
                if x := go(rest[1:], after, 0):
                    options.append((x[0] + cut + 2, "R" + x[1]))
        return min(options) if options else None

    assert all(got[s] == go(s, "", 0) for s in every)


# --- toxicity ------------------------------------------------------------------------------------


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    for n, starts in ((11, [0, 4, 5]), (1, [0]), (7, [0]), (4, [0, 1, 2, 3])):
        unary, transition, first = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), np.isin(np.arange(n), starts)
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            links = [(states[i - 1], states[i]) for i in range(n) if not first[i]]
            weight = np.exp(unary @ np.array(states) + sum(transition[link] for link in links))
            total += weight
            ones += weight * np.array(states)
            for link in links:
                pairs[link] += weight
        odds, found, partition = toxicity.chain(unary, transition, first)
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(ones / total, abs=1e-12)
        assert found == pytest.approx(pairs / total, abs=1e-9)
        assert partition == pytest.approx(np.log(total))


def test_fit_follows_the_slope_of_the_likelihood(monkeypatch):
    """The slope that the fit is given equals differences of its value."""
    rng = np.random.default_rng(2)
    cells = rng.integers(1, 40, size=(12, 10)).astype(np.int32)
    word, doc = rng.integers(0, 12, size=60), np.repeat(np.arange(6), 10)
    toxic = rng.random(60) < 0.3
    caught = {}
    monkeypatch.setattr(toxicity, "minimise", lambda function, start, **_: caught.update(f=function, x=start) or start)
    toxicity._fit_field(cells, word, doc, toxic, np.ones(6, dtype=bool))
    x = caught["x"] + 0.0
    x[:40] += rng.normal(size=40) * 0.3
    x[-4:] += rng.normal(size=4) * 0.3
    _, slope = caught["f"](x)
    for i in [0, *range(1, 40, 6), *range(len(x) - 4, len(x))]:
        step = np.zeros(len(x))
        step[i] = 1e-5
        difference = (caught["f"](x + step)[0] - caught["f"](x - step)[0]) / 2e-5
        assert slope[i] == pytest.approx(difference, abs=1e-4)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    plain = ["bara", "kodu", "lemi", "sato", "vine", "orka", "tulo", "pesi", "garo", "nemu"]
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(plain) + rng.choice(["", "na", "ti"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), "Grimzol" + rng.choice(["", "a", "est", "ing"]))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxic_spans_of_held_out_documents(labelled):
    documents, labels = labelled
    model = toxicity.fit_toxicity(documents, labels.filter(crc_part("doc_id", 3) != 1))
    held_out = documents.filter(crc_part("doc_id", 3) == 1)
    got = {r["doc_id"]: r for r in toxicity.toxic_scores(held_out, model).collect()}
    for row in held_out.collect():
        found = got[row["doc_id"]]
        assert (found["score"] >= 0.7) == (row["doc_id"] % 4 == 0)
        marked = [row["text"][s["start"] : s["end"]] for s in found["spans"]]
        assert " ".join(marked).split() == re.findall(r"Grimzol\w*", row["text"])


def test_toxicity_of_odd_texts(spark, labelled):
    documents, labels = labelled
    model = toxicity.fit_toxicity(documents, labels)
    long_text = "bara kodu. " * 800_000 + "ÉÉ grimzola."
    rows = [(1, None), (2, ""), (3, " \n.!"), (4, "日本 é Grimzol"), (None, "Grimzoling bara"), (None, "Grimzoling bara"), (5, long_text)]
    df = spark.createDataFrame([(i, t, 1.0, [t]) for i, t in rows], "doc_id long, text string, score double, spans array<string>")
    got = toxicity.toxic_scores(df, model).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["score"], [tuple(s) for s in r["spans"]]))
    assert len(got) == len(rows)
    prior = by_id[1][0][0]
    assert 0 < prior <= 0.5 and by_id[1] == by_id[2] == by_id[3] == [(prior, [])]
    assert by_id[4][0][0] >= 0.7 and (5, 12) in by_id[4][0][1]
    assert by_id[None][0] == by_id[None][1] and by_id[None][0][1] == [(0, 10)]
    assert by_id[5][0][1] == [(len(long_text) - 9, len(long_text) - 1)]
    assert toxicity.toxic_scores(df.limit(0), model).count() == 0


def test_toxicity_without_labels_of_both_kinds(spark, labelled):
    documents, labels = labelled
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit_toxicity(documents, some)
        scores = {r["score"] for r in toxicity.toxic_scores(documents, model).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() < 0.7


def test_a_key_with_many_rows_does_not_swell_the_sample(spark, labelled, monkeypatch):
    """One key holds most rows: copies count once, and many texts of one key are sampled like others."""
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 100)
    documents, labels = labelled
    texts = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("bara "), (F.col("id") % 1500).cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows, _ = toxicity._sample(documents.union(texts), labels, "text", "toxic", "doc_id")
    clean = [r for r in rows if r[1] == 0]
    assert 50 < len(clean) < 170
    assert len({r[0] for r in clean}) == len(clean)


def test_registered_queries_agree_with_plain_versions(spark, small):
    got = sorted(tuple(r) for r in catalog.QUERIES["op12_collocations"](spark, small).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").collect()]
    assert got == plain_collocations(rows)
    scored = catalog.QUERIES["op11_toxicity"](spark, small)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == len(rows)
    assert scored.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0

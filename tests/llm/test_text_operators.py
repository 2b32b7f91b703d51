"""The text operators against plain versions, and on nulls, blanks, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from worthline.llm import languages, licences, mixing, near_copies, neighbours, personal, quality
from worthline.llm.fingerprints import digest, edited_fingerprints, edited_text, fingerprints, likeness
from worthline.llm.token_codec import Codec, decode, encode, round_trip
from worthline.llm.token_counts import SPACE, Pieces, token_counts

ODD = [
    None,
    "",
    "   ",
    "a",
    "  two  spaces ",
    "\t\n\r\n x",
    "<|endoftext|> a<|endoftext|><|endoftext|>b",
    "x²½ Ⅷ \x1c\x1d a \x85 　",
    "é́ 🙂🙂 你好世界 ٣٤ \x00",
    "don't I'LL 's ..,;;'' <s></s><0x0A>",
    "a" * 3000,
    "one two three four five six seven",
    "one two three four five six seven",
]
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with nulls, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, t, "s", 1.0, "x") for i, t in enumerate(ODD)] + [(3, "a", "s", 1.0, "x"), (None, "null key", None, 1.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, spans string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("1 = 0")


def random_texts(n, seed=5):
    rng = random.Random(seed)
    letters = "abc .,\n\t'-_1230é▁<>🙂你(){}[]=+/\\\"AB²\x1e "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_codec_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    codec = Codec(open(BPE, "rb").read())
    for text in [t or "" for t in ODD] + random_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_piece_counts_equal_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    pieces = Pieces(open(PIECE, "rb").read())
    for text in [t or "" for t in ODD] + random_texts(1500):
        mine = pieces.count((SPACE + text).replace(" ", SPACE)) if text else 0
        assert mine == len(library.encode(text))


def test_codec_tables(odd, nothing):
    rows = round_trip(odd, BPE).collect()
    assert len(rows) == odd.count()
    assert all(r["decoded"] == (ODD[r["doc_id"]] or "") for r in rows if r["doc_id"] is not None)
    back = decode(encode(odd, BPE), BPE)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in [*ODD, "a", "null key"])
    assert round_trip(nothing, BPE).count() == 0


def test_count_tables(odd, nothing):
    rows = {r["doc_id"]: r for r in token_counts(odd, PIECE).collect()}
    assert (rows[0]["n_tokens"], rows[0]["n_bytes"]) == (0, 0) and rows[1]["n_tokens"] == 0
    assert token_counts(odd, PIECE, limit=2).filter("over_limit").count() > 0
    assert token_counts(odd, PIECE).count() == odd.count()
    assert token_counts(nothing, PIECE).count() == 0


def test_fingerprints_follow_order(spark, odd, nothing):
    texts = [(i, t) for i, t in enumerate(random_texts(60))]
    rows = {r["doc_id"]: r for r in edited_fingerprints(spark.createDataFrame(texts, "doc_id long, text string").repartition(7)).collect()}
    order = sorted(range(60), reverse=True)
    for i, doc in enumerate(order):
        following = texts[order[(i + 1) % 60]][1]
        edited = edited_text(texts[doc][1], following)
        third = len(texts[doc][1]) // 3
        assert len(edited) == len(texts[doc][1]) - third + min(third, len(following))
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[doc]["fingerprint"] == digest(texts[doc][1].encode())
        assert rows[doc]["near_next"] == likeness(digest(texts[doc][1].encode()), digest(following.encode()))
    assert edited_fingerprints(odd).count() == odd.count()
    assert edited_fingerprints(nothing).count() == 0
    one = edited_fingerprints(odd.filter("doc_id = 11")).first()
    assert one["near_next"] == 1.0
    same = {r["fingerprint"] for r in fingerprints(odd.filter("doc_id in (11, 12)")).collect()}
    assert len(same) == 1


def test_likeness_is_bounded():
    marks = [digest(t.encode()) for t in ["", "abc", *random_texts(30)]]
    assert all(0.0 <= likeness(a, b) <= 1.0 and likeness(a, b) == likeness(b, a) for a in marks for b in marks)


def test_languages(spark, small, nothing):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    train = documents.filter("doc_id % 4 <> 2")
    model = languages.fit_languages(train, rows=40)
    rows = languages.predict_languages(documents.filter("doc_id % 4 = 2"), model).join(documents, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 3")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"]) for r in languages.predict_languages(blank, model).collect()} == {("und", 0.0)}
    assert languages.keep_known(blank, model).count() == 0
    none = languages.fit_languages(documents.filter("1 = 0"))
    assert {r["lang_pred"] for r in languages.predict_languages(documents.limit(3), none).collect()} == {"und"}
    one = languages.fit_languages(documents.filter("lang = 'fr'"), rows=10)
    assert {r["lang_pred"] for r in languages.predict_languages(documents, one).collect()} == {"fr"}


def test_quality(spark, small, odd, nothing):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_quality(documents.join(labels.filter("doc_id % 3 <> 1"), "doc_id"))
    apart = quality.fit_quality(documents, labels=labels.filter("doc_id % 3 <> 1"))
    assert np.array_equal(model.weights, apart.weights) and np.array_equal(model.scale, apart.scale) and model.prior == apart.prior
    rows = quality.quality_scores(documents, model).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows)
    assert quality.quality_scores(odd, model).filter("score is null or isnan(score)").count() == 0
    assert quality.quality_scores(nothing, model).count() == 0
    alone = quality.fit_quality(documents.join(labels.filter("quality = 1"), "doc_id"))
    assert {round(r["score"], 6) for r in quality.quality_scores(documents.limit(5), alone).collect()} == {0.9999}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    unary, transition = rng.normal(size=7), rng.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    good, _ = quality.marginals(unary, transition, doc)
    for d in range(3):
        lines = np.flatnonzero(doc == d)
        sums = np.zeros((len(lines), 2))
        for states in np.ndindex(*[2] * len(lines)):
            value = sum(unary[i] * s for i, s in zip(lines, states)) + sum(transition[a, b] for a, b in zip(states, states[1:]))
            for i, s in enumerate(states):
                sums[i, s] += np.exp(value)
        assert np.allclose(good[lines], sums[:, 1] / sums.sum(axis=1))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, name in enumerate(personal.KINDS):
        for m in re.finditer(PATTERNS[name], text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = name == "email"
            if name == "ip":
                good = all(int(p) <= 255 for p in m.group().split("."))
            elif name == "card":
                good = 16 <= len(digits) <= 19 and personal.luhn(digits)
            elif name == "phone":
                good = 8 <= len(digits) <= 15
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_patterns():
    rng = random.Random(9)
    pieces = ["a.b@c.d_e@f.g", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "+1 (504) 555-2652", "+12", "++1 2345678", " ", "  ", "-", ".", "é", "12", "b", "\n", "@@a.b", "a@b.c-@d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7)))
        assert personal.base_spans(text) == plain_spans(text), text
    assert personal.base_spans("1" * 50_000 + "." + "9" * 50_000) == []


def test_personal_tables(spark, odd, nothing):
    rows = [(i, f"write to mail a{i}@b.com or call +1 (504) 555-26{i:02d}, host 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"my e-mail is jo{i} (at) site (dot) com for all") for i in range(40)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.fit_personal(docs)
    found = {r["doc_id"]: r for r in personal.find_personal(docs, model).collect()}
    assert len(found) == len(rows) and found[300]["spans"] == "" and found[301]["base_spans"] == ""
    for i, text in rows:
        base = personal._written_out(plain_spans(text or ""))
        assert found[i]["base_spans"] == base
        assert set(filter(None, base.split(","))) <= set(found[i]["spans"].split(","))
    hidden = {r["doc_id"]: r["text"] for r in personal.redact(docs, model).collect()}
    assert "<EMAIL>" in hidden[1] and "@" not in hidden[1] and "<PHONE>" in hidden[1] and hidden[300] is None
    assert personal.find_personal(nothing, personal.fit_personal(nothing)).count() == 0
    assert personal.redact(odd, model).columns == odd.columns


def test_reliabilities_find_the_good_labeler():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [("+" if true else "-") if rng.random() < right else ("-" if true else "+") for right in (0.95, 0.9, 0.6)]
        counts["".join(votes)] += 1
    chances, table, share = personal.reliabilities(counts)
    assert abs(share - 0.4) < 0.05 and chances["+++"] > 0.9 and chances["---"] < 0.1
    assert abs(table[1, 0, 2] - 0.95) < 0.05 and abs(table[1, 2, 2] - 0.6) < 0.07


def test_mixing_keeps_all_and_follows_weights(spark, odd, nothing):
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.31}
    shares = mixing.shares_of(weights, 997)
    assert sum(shares.values()) == 997
    slots = mixing.frame_of(shares)
    owner = {t: s for s, places in slots.items() for t in places}
    assert sorted(owner) == list(range(997))
    done = collections.Counter()
    for t in range(997):
        done[owner[t]] += 1
        for s, share in shares.items():
            assert abs(done[s] - (t + 1) * share / 997) < 1
    rows = [(i, "abcd"[min(3, i % 7)]) for i in range(500)] + [(i, None) for i in range(20)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights | {None: 1.0}, block_rows=4, frame_slots=50)
    got = mixed.collect()
    assert sorted((r["doc_id"], r["source"] or "") for r in got) == sorted((i, s or "") for i, s in rows)
    seen = collections.defaultdict(set)
    for r in got:
        seen[r["slot"]].add((r["source"], r["block"]))
    assert all(len(s) == 1 for s in seen.values())
    blocks = collections.defaultdict(list)
    for slot in sorted(seen):
        source, block = next(iter(seen[slot]))
        blocks[source].append(block)
    assert all(b == list(range(len(b))) for b in blocks.values())
    assert mixing.mix(nothing).count() == 0 and mixing.mix(odd).count() == odd.count()
    ordered = mixing.in_mixed_order(mixed).collect()
    assert [r["doc_id"] for r in ordered] == [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["place"]))]


def test_nearest_recall_and_rules(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1200, 24))
    points[100:400] = points[100]  # a large group of equal vectors
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [float("inf")] + [1.0] * 23), (5080, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(1200) if i % 20 == 0}
    found = 0
    for q, rows_ in got.items():
        scores = points @ points[q]
        best = sorted((i for i in range(1200) if i != q), key=lambda i: (-scores[i], i))[:10]
        rows_.sort()
        assert [r for r, _, _ in rows_] == list(range(1, 11))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in rows_)
        assert [(-s, i) for _, i, s in rows_] == sorted((-s, i) for _, i, s in rows_)
        found += len(set(best) & {i for _, i, _ in rows_})
    assert found >= 0.9 * 10 * len(got)
    few = neighbours.nearest(df.filter("vec_id < 5 or vec_id >= 5000"), F.col("vec_id") % 20 == 0, 10).collect()
    assert len(few) == 4
    assert neighbours.nearest(df.filter("1 = 0"), F.col("vec_id") == 0).count() == 0


def test_licences_inherit_from_the_nearest_directory(spark, nothing):
    rows = [
        (1, "repo/LICENSE", licences.TEMPLATES["MIT"][2]),
        (2, "repo/src/a.py", "print(1)"),
        (3, "repo/src/vendor/COPYING", licences.TEMPLATES["GPL-3.0"][2]),
        (4, "repo/src/vendor/lib/deep/b.c", "int x;"),
        (5, "repo/src/c.py", "# Licensed under the Apache License, Version 2.0.\nimport os"),
        (6, "other/d.txt", "nothing here"),
        (7, "other/e.txt", None),
        (8, None, "int y;"),
        (9, "repo/f.txt", "We never said anything about a licence for dogs or cats in the park, nor for any other animal."),
        (9, "repo/f.txt", ""),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {(r["doc_id"], r["origin"], r["licence"], r["from_dir"]) for r in licences.scan_licences(files).collect()}
    assert got == {
        (1, "own", "MIT", None),
        (2, "inherited", "MIT", "repo"),
        (3, "own", "GPL-3.0", None),
        (4, "inherited", "GPL-3.0", "repo/src/vendor"),
        (5, "own", "Apache-2.0", None),
        (6, "none", None, None),
        (7, "none", None, None),
        (8, "none", None, None),
        (9, "inherited", "MIT", "repo"),
    }
    assert licences.scan_licences(files.filter("1 = 0")).count() == 0


def plain_shingles(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return collections.Counter([text.strip()]) if text.strip() else collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_shingles_equal_plain_ones():
    items = [t or "" for t in ODD] + random_texts(200) + ["end of a word", "start of a word"]
    values, counts, keys = near_copies.shingles(items)
    for text, v, c, k in zip(items, values, counts, keys):
        plain = plain_shingles(text)
        assert len(v) == len(plain) and sorted(c.tolist()) == sorted(plain.values()), repr(text)
        assert (k is None) == (not text.strip())


def test_shingles_need_no_set_of_each_text(monkeypatch):
    """Sets of values (``np.unique``, ``np.isin``) took half the time of the shingles; runs of sorted ones tell the same."""
    items = [t or "" for t in ODD] + random_texts(50) + ["one two three four five", "a b c d e a b c d e a b c d e", "five six", "five", " "]
    expected = [sorted(plain_shingles(t).values()) for t in items]

    def refuse(*_, **__):
        raise AssertionError("a set of values")

    monkeypatch.setattr(np, "unique", refuse)
    monkeypatch.setattr(np, "isin", refuse)
    values, counts, _ = near_copies.shingles(items)
    assert [sorted(c.tolist()) for c in counts] == expected
    assert all((v[1:] > v[:-1]).all() for v in values)


def test_samples_equal_plain_ones():
    """Every place holds the mark of the least (order, mark), also where a text repeats a value."""
    rng = np.random.default_rng(9)
    values = np.concatenate([near_copies.mixed(np.arange(1, 60, dtype=np.uint64)), np.full(5, 7, dtype=np.uint64)])
    weights, starts = rng.integers(1, 4, len(values)) * 1.1, np.array([0, 1, 30, 59])
    found = near_copies.samples(values, weights, starts)
    for k, seed in enumerate(near_copies._SEEDS):
        h = (values ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        logs = near_copies._LOGS[h.view(np.uint16).reshape(-1, 4)]
        rate, scale = logs[:, 0] + logs[:, 1], np.log(logs[:, 2] + logs[:, 3])
        g = h * np.uint64(0xC2B2AE3D27D4EB4F)
        shift = (g >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        step = np.floor(np.log(weights).astype(np.float32) / rate + shift)
        order = scale - rate * (step - shift + np.float32(1.0))
        marks = ((g ^ step.astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(values)])):
            assert found[i, k] == min(zip(order[a:b].tolist(), marks[a:b].tolist()))[1]


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(8)
    pool = near_copies.mixed(np.arange(1, 401, dtype=np.uint64))
    hits = trials = expected = 0
    for _ in range(30):
        a, b = np.sort(rng.choice(pool, 150, replace=False)), np.sort(rng.choice(pool, 250, replace=False))
        wa, wb = rng.integers(1, 4, len(a)) * 1.1, rng.integers(1, 4, len(b)) * 1.1
        s = near_copies.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]))
        hits += (s[0] == s[1]).sum()
        trials += s.shape[1]
        expected += near_copies.similarity((a, wa), (b, wb)) * s.shape[1]
    assert abs(hits - expected) < 4 * np.sqrt(trials * 0.25)


def test_near_classes(spark, odd, nothing):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(150)]
    for i in range(150, 300):  # near copies of one text, more than a few of them
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[0][1].upper()) for i in range(300, 320)] + [(320, None), (321, " "), (322, None), (7, rows[7][1])]
    got = near_copies.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = collections.defaultdict(list)
    for r in got:
        classes[r["class_id"]].append(r["doc_id"])
    assert len(got) == len(rows)
    assert sorted(classes[150]) == list(range(150, 300))
    assert sorted(classes[0]) == [0, *range(300, 320)]
    assert classes[7] == [7, 7] and classes[320] == [320] and classes[322] == [322]
    assert all(len(v) == 1 for k, v in classes.items() if k not in (0, 7, 150))
    assert near_copies.near_classes(odd).count() == odd.count()
    assert near_copies.near_classes(nothing).count() == 0

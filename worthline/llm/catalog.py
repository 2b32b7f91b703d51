"""Registered queries of the text operators, with checking SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worthline.llm.common import crc_part
from worthline.llm.conversations import damaged, repair
from worthline.llm.fingerprints import edited_fingerprints
from worthline.llm.languages import fit_languages, predict_languages
from worthline.llm.licences import scan_licences
from worthline.llm.mixing import mix
from worthline.llm.near_copies import near_classes
from worthline.llm.neighbours import nearest
from worthline.llm.personal import find_personal, fit_personal
from worthline.llm.phrases import collocations
from worthline.llm.quality import fit_quality, quality_scores
from worthline.llm.token_codec import round_trip
from worthline.llm.token_counts import token_counts
from worthline.llm.toxicity import fit_toxicity, toxic_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document under the piece vocabulary."""
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document beside that of its edited text and of the next document."""
    return edited_fingerprints(table(spark, folder, "documents"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; the model has not seen the held-out quarter."""
    documents = table(spark, folder, "documents")
    model = fit_languages(documents.filter(crc_part("doc_id", 4) != 2))
    held_out = (crc_part("doc_id", 4) == 2).alias("held_out")
    return predict_languages(documents, model).select("doc_id", held_out, "lang_pred", "score")


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels of the held-out third are never read by the fit."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality").filter(crc_part("doc_id", 3) != 1)
    model = fit_quality(documents, labels=labels)
    scored = quality_scores(documents, model)
    held_out = (crc_part("doc_id", 3) == 1).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted, "bad_share")


@query
def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The slot of every document in a mix by the square roots of the source sizes."""
    return mix(table(spark, folder, "documents").select("doc_id", "source"))


@query
def op1_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above.

    A document lies in source/language/thousand/hundred; one that states a licence speaks for its directory.
    """
    place = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), F.concat("doc_id", F.lit(".txt")))
    files = table(spark, folder, "documents").select("doc_id", "text", place.alias("path"))
    return scan_licences(files, licence_file=F.lit(True))


@query
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document: those of the fixed patterns, and all."""
    documents = table(spark, folder, "documents")
    found = find_personal(documents, fit_personal(documents))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


@query
def op10_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_classes(table(spark, folder, "documents"))


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document and its toxic spans; labels of the held-out third are never read by the fit."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(crc_part("doc_id", 3) != 1)
    scored = toxic_scores(documents, fit_toxicity(documents, labels))
    held_out = (crc_part("doc_id", 3) == 1).alias("held_out")
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans")
    return scored.select("doc_id", held_out, "score", predicted, spans)


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The collocations of every language."""
    return collocations(table(spark, folder, "documents"))


ORACLES["op12_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
totals as (select lang, sum(len(w))::bigint n from words group by lang),
sizes as (select unnest([1, 2, 3]) k),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
  from words, sizes where len(w) >= k),
counts as (select lang, k, phrase, count(*) f from grams group by lang, k, phrase having count(*) >= 10),
candidates as (select lang, k, phrase, f a, string_split(phrase, ' ') w from counts where k >= 2),
cuts as (
  select c.*, x.k cut, array_to_string(w[1:x.k], ' ') head, array_to_string(w[x.k + 1:], ' ') tail
  from candidates c join sizes x on x.k < c.k),
scores as (
  select c.lang, c.phrase, c.a, c.cut, h.f l, t.f r,
         (1000000::hugeint * c.a * c.a) // (h.f::hugeint * t.f) score
  from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.tail),
lowest as (
  select * from scores qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, phrase, max(a) a
  from (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase, a from candidates where k = 3)
  group by lang, phrase),
kept as (
  select s.* from lowest s left join longer g on g.lang = s.lang and g.phrase = s.phrase
  where g.a is null or 100 * g.a < 50 * s.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as "rank" from kept)
select lang, "rank", phrase, a, l, r, n, score::bigint score from ranked join totals using (lang) where "rank" <= 2000
"""


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest repair of every conversation, after the damage that the hash of each turn does."""
    repaired = repair(damaged(table(spark, folder, "conversations")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return repaired.select(F.col("conv").alias("conv_id"), *numbers, "audit", "repaired_sha256", "signature")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = pipeline

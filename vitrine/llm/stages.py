"""Stages of the pipeline over documents (doc_id, text, lang, source, n_chars).

Each stage works on what its predecessor kept and reads whole texts.  Filtering stages keep a
document unless their operator's finding is plain; columns beyond the five are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import bpe, decontaminate, langid, near_dedup, secrets
from vitrine.llm.common import small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of an accepted language; under it the classifier is no better than a guess among three.
MIN_SCORE = 0.34


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and guesses under ``MIN_SCORE``.

    Without any labelled text there is no classifier, and only texts without a letter go.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs, model)
    return known.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class stays, that of the least id."""
    small_batches(spark)
    return near_dedup.without_near_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hits = decontaminate.find_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return decontaminate.without_documents(hits)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    masked = secrets.redact(secrets.scan(docs, secrets.fit(docs)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it: (doc_id, lang, source, n_chars, n_tokens, ids, exact)."""
    small_batches(spark)
    words = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.encode(docs.select(*COLUMNS), words, decoded="decoded")
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("exact"),
    )

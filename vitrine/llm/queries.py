"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import public_tokenizers

from vitrine.llm import bpe, decontaminate, html_text, langid, licenses, near_dedup, pieces, secrets, substring_dedup, token_files, variants, whitening, winnowing
from vitrine.llm.common import table
from vitrine.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


@register
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token store of all documents, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "tokens")
    tokens = token_files.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), parts)
    token_files.write(tokens, path)
    sums = token_files.checksums(token_files.read_tokens(spark, path))
    return token_files.with_start(sums, spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))

    def of(*kinds: str) -> Column:
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    def written(findings: Column) -> Column:
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(written(of("assign", "access", "hex")), 256).alias("base_sha256"),
        written(F.col("findings")).alias("spans"),
    )


@register
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to."""
    words = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, words, decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op6_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(list_slice(words, first, first + least(10, len(words)) - 1), ' ') AS win
  FROM (SELECT item, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS first FROM item_words WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, first, array_to_string(list_slice(words, first, first + n - 1), ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS first FROM doc_words JOIN sizes ON len(words) >= n)),
hits AS (SELECT doc_id, first, n, item FROM doc_windows JOIN windows USING (n, win)),
words_hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(first, first + n)) AS pos FROM hits) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)"""


def held_out() -> Column:
    """Rows that must not teach the classifier; a null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = langid.fit(docs, ~held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


@register
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnowing.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


@register
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings of 200 bytes cover, removed from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs, with_text=False)


@register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    vectors = table(spark, sf_dir, "embeddings").where(whitening.whole(F.col("embedding")))
    vectors = vectors.select("vec_id", whitening.quantise(F.col("embedding")).alias("x"))
    return whitening.transform(vectors, whitening.fit(vectors, k=4), k=4).drop("x")


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commoner spelling of every word of the documents."""
    return variants.variants(table(spark, sf_dir, "documents"))


@register
def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text that they decode to."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


ORACLES["op9_license_scan"] = licenses.oracle()

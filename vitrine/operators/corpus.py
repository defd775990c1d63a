"""Building the retrieval corpus: product chunks, document chunks, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import text as TX
from vitrine.schemas import PAYLOAD


def _payload(**known: Column) -> Column:
    """The shared payload struct with the given fields set and the others null."""
    fields = [
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields
    ]
    return F.struct(*fields)


def render_products(catalog: DataFrame) -> DataFrame:
    return catalog.select("sku", TX.product_text().alias("text"))


def product_payload() -> Column:
    names = ("sku", "name", "category", "fabric", "colors", "sizes", "price_eur", "occasion")
    return _payload(source_type=F.lit("product"), **{n: F.col(n) for n in names})


def product_chunks(catalog: DataFrame) -> DataFrame:
    """Exactly one chunk per product; product text is never split."""
    return catalog.select(
        F.col("sku").alias("id"),
        F.lit("product").alias("source_type"),
        TX.product_text().alias("text"),
        product_payload().alias("payload"),
    )


def document_chunks(documents: DataFrame, pieces: Column | None = None) -> DataFrame:
    """Chunks of documents ``(id, text)``, numbered from 0 within each document.

    ``pieces`` is an array expression over ``text``; the default keeps
    separators.  A map-side explode: no shuffle, and one huge document costs
    its own task only.
    """
    pieces = TX.recursive_chunks(F.col("text")) if pieces is None else pieces
    exploded = documents.select(F.col("id").alias("policy_id"), F.posexplode(pieces).alias("i", "text"))
    return exploded.select(
        F.concat("policy_id", F.lit("_chunk_"), F.col("i").cast("string")).alias("id"),
        F.lit("policy").alias("source_type"),
        "text",
        _payload(
            policy_id=F.col("policy_id"), chunk_index=F.col("i"), source_type=F.lit("policy")
        ).alias("payload"),
    )


def corpus(catalog: DataFrame, documents: DataFrame, pieces: Column | None = None) -> DataFrame:
    return product_chunks(catalog).unionByName(document_chunks(documents, pieces))


def lookup_documents(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Text of each requested document id, or a message when there is no such document."""
    missing = F.format_string("Policy '%s' not found.", F.col("id"))
    return (
        requests.select("id")
        .distinct()
        .join(documents.select("id", "text"), "id", "left")
        .select("id", F.coalesce("text", missing).alias("text"))
    )


def excerpts(documents: DataFrame, length: int = 300) -> DataFrame:
    return documents.select("id", TX.excerpt(F.col("text"), length).alias("excerpt"))

"""Evaluation: run the questions of a golden set, score retrieval, summarise ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.operators.answering import AnswerStep, answer_batch
from vitrine.operators.routing import RETAIL, Vocabulary


def run_eval(
    gold: DataFrame,
    catalog: DataFrame,
    documents: DataFrame,
    hits: DataFrame | None = None,
    vocabulary: Vocabulary = RETAIL,
    step: AnswerStep | str = "rules",
) -> DataFrame:
    """Expected next to predicted, seven fields per golden item."""
    questions = gold.select(
        F.col("id").alias("question_id"),
        F.col("question").alias("query"),
        "expected_answer",
        "required_facts",
        "difficulty",
    )
    answers = answer_batch(questions, catalog, documents, hits, vocabulary, step)
    return answers.select(
        F.col("question_id").alias("id"),
        F.col("query").alias("question"),
        "expected_answer",
        F.col("answer").alias("predicted_answer"),
        F.col("sources").alias("retrieved_sources"),
        "required_facts",
        "difficulty",
    )


ANY_PRODUCT = "products"


def gold_id_of_hit(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Map chunk ids to the ids golden sets use: the document of a chunk, the sku of a product."""
    names = corpus.select(
        "id",
        F.coalesce("payload.policy_id", "id").alias("source_id"),
        (F.col("source_type") == "product").alias("is_product"),
    )
    return hits.join(names, "id").select("question_id", "source_id", "is_product")


def context_recall(gold_sources: DataFrame, mapped_hits: DataFrame) -> DataFrame:
    """Per golden item: expected sources, how many were retrieved, and their share.

    ``gold_sources`` is ``(question_id, source_id)``, one row per expected
    source and a null source for items without any.  The source id
    ``products`` is met by any product hit.
    """
    direct = mapped_hits.select("question_id", "source_id")
    products = mapped_hits.filter("is_product").select("question_id", F.lit(ANY_PRODUCT).alias("source_id"))
    found = direct.unionByName(products).distinct().withColumn("hit", F.lit(1))
    return (
        gold_sources.distinct()
        .join(found, ["question_id", "source_id"], "left")
        .groupBy("question_id")
        .agg(
            F.count("source_id").alias("n_expected"),
            F.count("hit").alias("n_found"),
        )
        .withColumn("recall", F.when(F.col("n_expected") > 0, F.col("n_found") / F.col("n_expected")))
    )


def rubric_rollup(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Mean rating and share of top ratings by dimension and difficulty, with subtotals.

    ``level`` is 0 for a group, 1 for a dimension's subtotal and 3 for the whole, which
    tells a subtotal from a group without a name.

    ``scores`` is ``(dimension, difficulty, score)``; ratings the rubric has no
    anchor for are left out.  The rubric has 15 rows.
    """
    return (
        scores.join(F.broadcast(rubric.select("dimension", "score")), ["dimension", "score"], "left_semi")
        .rollup("dimension", "difficulty")
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.count(F.lit(1)).alias("n_scores"),
            F.round(F.avg("score"), 6).alias("mean_score"),
            F.round(F.avg((F.col("score") == 5).cast("int")), 6).alias("top_share"),
        )
    )


def gold_profile(gold: DataFrame) -> DataFrame:
    """Number of golden items by source type and difficulty, with subtotals (``level`` as in ``rubric_rollup``)."""
    return gold.rollup("source_type", "difficulty").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n_items")
    )

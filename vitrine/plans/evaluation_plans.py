"""Registered evaluation queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import answering as A
from vitrine.operators import evaluation as E
from vitrine.plans.dialogue_plans import CONTEXT_SQL, TOOLS_SQL, _cascade, prompt_sql
from vitrine.plans.corpus_plans import CORPUS_SQL
from vitrine.plans.retrieval_plans import bm25_sql, chunk_index
from vitrine.plans.views import (
    CATALOG_SQL, GOLD_SOURCES_SQL, GOLD_SQL, SCORES_SQL, VOCABULARY, catalog, gold, gold_sources, policy_documents, scores,
)
from vitrine.sources.files import RUBRIC_ROWS, rubric


def _gold_hits(spark, sf_dir):
    corpus, index = chunk_index(spark, sf_dir)
    asked = gold(spark, sf_dir).select(F.col("id").alias("question_id"), F.col("question").alias("query"))
    return A.retrieve(asked, corpus, 3, index)


def _eval(spark, sf_dir, hits):
    result = E.run_eval(gold(spark, sf_dir), catalog(spark, sf_dir), policy_documents(spark, sf_dir), hits, VOCABULARY)
    return result.withColumns(
        {
            "retrieved_sources": F.array_join("retrieved_sources", ","),
            "required_facts": F.array_join("required_facts", "|"),
        }
    )


def eval_run(spark, sf_dir):
    return _eval(spark, sf_dir, _gold_hits(spark, sf_dir))


def eval_run_tools_only(spark, sf_dir):
    return _eval(spark, sf_dir, None)


def context_recall(spark, sf_dir):
    corpus, _ = chunk_index(spark, sf_dir)
    mapped = E.gold_id_of_hit(_gold_hits(spark, sf_dir), corpus)
    recall = E.context_recall(gold_sources(spark, sf_dir), mapped)
    return recall.withColumn("recall", F.round("recall", 6))


GOLD_ASKED_SQL = f"""{GOLD_SQL},
questions AS (SELECT id AS question_id, question AS query, lower(question) AS q, expected_answer, required_facts,
                     difficulty FROM gold)"""

_FIELDS = """question_id AS id, query AS question, expected_answer, answer AS predicted_answer, sources AS retrieved_sources,
       array_to_string(required_facts, '|') AS required_facts, difficulty"""

_RUBRIC_VALUES = ", ".join(f"('{d}', {s})" for d, s, _ in RUBRIC_ROWS)

QUERIES = {
    "eval_run": eval_run,
    "eval_run_tools_only": eval_run_tools_only,
    "context_recall": context_recall,
    "rubric_rollup": lambda spark, sf_dir: E.rubric_rollup(scores(spark, sf_dir), rubric(spark)),
    "gold_profile": lambda spark, sf_dir: E.gold_profile(gold(spark, sf_dir)),
}

ORACLES = {
    "eval_run": f"""WITH RECURSIVE {CORPUS_SQL}, {GOLD_ASKED_SQL}, {bm25_sql('corpus')}, {TOOLS_SQL}, {CONTEXT_SQL}, prompted AS (
        SELECT t.*, coalesce(sources, '') AS sources, {prompt_sql('context_text', 'tool_info', 'query')} AS prompt
        FROM tooled t LEFT JOIN contexts USING (question_id)),
        answered AS (SELECT *, {_cascade('lower(prompt)', A.RETAIL_RULES)} AS answer FROM prompted)
        SELECT {_FIELDS} FROM answered""",
    "eval_run_tools_only": f"""WITH {CATALOG_SQL}, {GOLD_ASKED_SQL}, {TOOLS_SQL}, prompted AS (
        SELECT *, '' AS sources, {prompt_sql("''", 'tool_info', 'query')} AS prompt FROM tooled),
        answered AS (SELECT *, {_cascade('lower(prompt)', A.RETAIL_RULES)} AS answer FROM prompted)
        SELECT {_FIELDS} FROM answered""",
    "context_recall": f"""WITH RECURSIVE {CORPUS_SQL}, {GOLD_ASKED_SQL}, {bm25_sql('corpus')}, {GOLD_SOURCES_SQL},
        found AS (SELECT DISTINCT question_id, coalesce(policy_id, sku) AS source_id, 1 AS hit FROM hits JOIN corpus USING (id))
        SELECT question_id, count(source_id) AS n_expected, count(hit) AS n_found,
               CASE WHEN count(source_id) > 0 THEN round(count(hit) / count(source_id), 6) END AS recall
        FROM gold_sources LEFT JOIN found USING (question_id, source_id) GROUP BY question_id""",
    "rubric_rollup": f"""WITH {SCORES_SQL}, rubric(dimension, score) AS (VALUES {_RUBRIC_VALUES})
        SELECT dimension, difficulty, GROUPING(dimension, difficulty) AS level, count(*) AS n_scores, round(avg(score), 6) AS mean_score,
               round(avg(CASE WHEN score = 5 THEN 1 ELSE 0 END), 6) AS top_share
        FROM scores SEMI JOIN rubric USING (dimension, score) GROUP BY ROLLUP (dimension, difficulty)""",
    "gold_profile": f"""WITH {GOLD_SQL} SELECT source_type, difficulty, GROUPING(source_type, difficulty) AS level, count(*) AS n_items
        FROM gold GROUP BY ROLLUP (source_type, difficulty)""",
}

"""The training-data pipeline: documents through the stages of STAGES, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import stages
from vitrine.session import materialise

STAGES = [
    ("language", stages.language),
    ("near_copies", stages.near_copies),
    ("decontamination", stages.decontamination),
    ("secrets", stages.secret_scan),
    ("token_ids", stages.token_ids),
]

#: The classifier, the sampled sketches and the tokenizer have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

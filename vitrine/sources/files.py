"""File sources: catalog and golden set (JSON arrays), documents (Markdown), rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine import schemas


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with ``ord``, a number that grows in file order.

    The schema is given, not inferred: inference would turn ``stock`` into one
    struct holding every size of every row.
    """
    rows = spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("ord"), "*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(id, text)`` per ``*.md`` file below ``path``; id is the file stem.

    A folder that does not exist gives an empty table.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schemas.DOCUMENT)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return files.select(stem.alias("id"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GOLD).option("multiLine", True).json(path)


# The scoring rubric, five dimensions with anchors at 1, 3 and 5.
RUBRIC_ROWS = [
    ("correctness", 1, "Mostly incorrect or misleading."),
    ("correctness", 3, "Partially correct, some key facts wrong or missing."),
    ("correctness", 5, "Fully correct, no factual errors."),
    ("groundedness", 1, "Many claims not supported by context (hallucinations)."),
    ("groundedness", 3, "Some unsupported claims, but core info is grounded."),
    ("groundedness", 5, "All claims are supported by the context."),
    ("completeness", 1, "Misses most of the question."),
    ("completeness", 3, "Addresses main point but misses important details."),
    ("completeness", 5, "Fully addresses all parts of the question."),
    ("helpfulness", 1, "Not actionable, vague."),
    ("helpfulness", 3, "Somewhat helpful, but user still unsure what to do."),
    ("helpfulness", 5, "Clear, actionable, and directly useful."),
    ("tone", 1, "Rude, robotic, or off-brand."),
    ("tone", 3, "Neutral, acceptable but not warm."),
    ("tone", 5, "Friendly, polite, fits a small boutique."),
]


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRIC_ROWS, schemas.RUBRIC)

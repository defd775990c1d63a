"""The engine's tables as views over the benchmark tables, in Spark and in SQL.

The benchmark data holds no shop, so parts stand for the catalog, line items
for stock movements, documents for policy texts, user turns for questions,
benchmark passages for the golden set, and labels for ratings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.operators.routing import Vocabulary
from vitrine.session import materialise

SIZES = ["S", "M", "L", "XL", "XXL", "XS", "one_size"]

# Words that occur in the benchmark texts, in the roles of the retail words.
VOCABULARY = Vocabulary(
    inventory=("with", "sch"),
    returns=("que", "das"),
    shipping=("from", "und"),
    sizes=(("M", (" of ",)), ("L", (" is ",)), ("S", (" la ",))),
    colors=(("red", ("was",)), ("blue", ("que",))),
    returns_document="7",
    shipping_document="11",
)

RULES = [
    ((("from",), ("the",)), "rule 1"),
    ((("from",), ("is",)), "rule 2"),
    ((("que",),), "rule 3"),
    ((("der",), ("und",)), "rule 4"),
    ((("for",),), "rule 5"),
    ((("that",),), "rule 6"),
    ((("tion",),), "rule 7"),
    ((), "rule 8"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows of a small input with fewer splits than cores over all cores.

    The text work per row is heavy and the benchmark file is one row group.  A
    large input has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a stock map built from their line items.

    The seven quantities are conditional sums of one aggregation, pre-summed
    in every task, so a part holding a third of all line items is no hot spot.
    """
    part = table(spark, sf_dir, "part")
    items = table(spark, sf_dir, "lineitem")
    quantity = [
        F.sum(F.when(F.col("l_linenumber") == i + 1, F.col("l_quantity"))).alias(f"q{i}")
        for i in range(len(SIZES))
    ]
    sums = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(*quantity)
    entries = F.array(
        *[
            F.struct(F.lit(size).alias("key"), (F.col(f"q{i}").cast("bigint") % 11).cast("int").alias("value"))
            for i, size in enumerate(SIZES)
        ]
    )
    stock = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    stocked = sums.select("p_partkey", stock.alias("stock"))
    return part.join(stocked, "p_partkey", "left").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("fabric"),
        F.split("p_name", " ").alias("colors"),
        F.map_keys("stock").alias("sizes"),
        F.col("p_retailprice").alias("price_eur"),
        "stock",
        F.concat_ws(" ", F.lit("care class"), "p_size").alias("care_instructions"),
        F.array("p_type", "p_brand").alias("occasion"),
        F.concat_ws(" ", "p_type", "p_name").alias("short_description"),
    )


CATALOG_SQL = """
stock_rows AS (
  SELECT l_partkey, l_linenumber AS pos,
         (['S','M','L','XL','XXL','XS','one_size'])[l_linenumber] AS size,
         CAST(sum(l_quantity) AS BIGINT) % 11 AS qty
  FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_partkey, l_linenumber),
stock_lists AS (
  SELECT l_partkey, list(size ORDER BY pos) AS sizes, list(qty ORDER BY pos) AS qtys,
         string_agg(size || ': ' || qty, ', ' ORDER BY pos) AS stock_text
  FROM stock_rows GROUP BY l_partkey),
catalog AS (
  SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_type AS category,
         p_brand AS fabric, string_split(p_name, ' ') AS colors, sizes, p_retailprice AS price_eur,
         qtys, stock_text, 'care class ' || p_size AS care_instructions, [p_type, p_brand] AS occasion,
         p_type || ' ' || p_name AS short_description
  FROM part LEFT JOIN stock_lists ON l_partkey = p_partkey)"""


def flat_catalog(products: DataFrame, *extra) -> DataFrame:
    """Catalog rows with lists and maps joined into strings."""
    stock = F.transform(F.map_entries("stock"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return products.select(
        "sku",
        "name",
        "category",
        "price_eur",
        F.array_join("sizes", ",").alias("sizes"),
        F.array_join(stock, ", ").alias("stock"),
        *extra,
    )


FLAT_SQL = "sku, name, category, price_eur, array_to_string(sizes, ',') AS sizes, stock_text AS stock"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two documents that stand for policies, filtered by the stored key, so that the scan skips the rest."""
    wanted = [int(VOCABULARY.returns_document), int(VOCABULARY.shipping_document)]
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(wanted))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For chunking and indexing, where the work per text is heavy."""
    return spread(documents(spark, sf_dir), "id")


DOCUMENTS_SQL = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("query"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).filter("role = 'user'").drop("role")


QUESTIONS_SQL = """
questions AS (
  SELECT conv_id || ':' || turn AS question_id, CAST(conv_id AS VARCHAR) AS session_id, turn, text AS query,
         lower(text) AS q
  FROM conversations WHERE role = 'user')"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as golden items: the passage asks, its first sentence is expected."""
    length = F.length("text")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
        F.split("text", "[.]")[0].alias("expected_answer"),
        F.when(F.col("text").contains("\n"), "inventory").otherwise("policy").alias("source_type"),
        F.split("text", "\n").alias("required_facts"),
        F.when(length < 150, "easy").when(length < 250, "medium").otherwise("hard").alias("difficulty"),
    )


GOLD_SQL = """
gold AS (
  SELECT 'g' || item_id AS id, text AS question, string_split(text, '.')[1] AS expected_answer,
         CASE WHEN contains(text, chr(10)) THEN 'inventory' ELSE 'policy' END AS source_type,
         string_split(text, chr(10)) AS required_facts,
         CASE WHEN length(text) < 150 THEN 'easy' WHEN length(text) < 250 THEN 'medium' ELSE 'hard' END AS difficulty
  FROM benchmark)"""

_GRAM = 4


def _grams(rows: DataFrame, key: str, inner: bool) -> DataFrame:
    """Distinct runs of four words per row; with ``inner`` the outermost words are left out."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    if inner:
        words = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    starts = F.sequence(F.lit(1), F.size("words") - (_GRAM - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(_GRAM)), " "))
    return (
        rows.select(key, words.alias("words"))
        .filter(F.size("words") >= _GRAM)
        .select(key, F.explode(F.array_distinct(grams)).alias("gram"))
    )


def gold_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(question_id, source_id)``: the documents that contain the passage, null if none does.

    A document holding a passage holds every run of four words inside it.
    Each passage is looked up by its rarest run, and the text is compared only
    for the documents found.  A passage under six words has no inner run; those
    few lie in blocks, and each text is searched for the passages of a block at a time.
    """
    passages = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("question_id"), "text"
    )
    docs = spread_documents(spark, sf_dir)
    wanted = _grams(passages, "question_id", inner=True)
    present = _grams(docs, "id", inner=False).join(wanted.select("gram").distinct(), "gram", "left_semi")
    present = materialise(present, "passage-runs")
    frequency = present.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # an unmatched run proves that no document holds the passage; it sorts first
    ranked = wanted.join(frequency, "gram", "left").groupBy("question_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
    )
    keys = ranked.filter("rarest.n > 0").select("question_id", F.col("rarest.gram").alias("gram"))
    candidates = present.join(keys, "gram").select("question_id", "id")
    short = passages.filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) < _GRAM + 2)
    verified = (
        candidates.join(passages.withColumnRenamed("text", "passage"), "question_id")
        .join(docs, "id")
        .filter(F.col("text").contains(F.col("passage")))
        .select("question_id", F.col("id").alias("source_id"))
    )
    verified = verified.unionByName(_containing(docs, short))
    return passages.select("question_id").join(verified, "question_id", "left")


SHORT_PASSAGES = 1000


def _containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(question_id, source_id)`` of documents that contain short passages.

    About ``SHORT_PASSAGES`` passages are one row of a stored table, and each text is searched
    for the passages of one row at a time: a stated set of queries against all texts, in blocks.
    """
    n_blocks = -(-passages.count() // SHORT_PASSAGES)
    if not n_blocks:
        return docs.where("false").select(F.col("id").alias("question_id"), F.col("id").alias("source_id"))
    block = F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)).alias("block")
    asked = F.collect_list(F.struct(F.col("question_id").alias("q"), F.col("text").alias("t"))).alias("asked")
    asked = materialise(passages.groupBy(block).agg(asked), "short-passages")
    met = docs.select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")).join(asked, "block")
    held = F.explode(F.filter("asked", lambda p: F.col("text").contains(p["t"])))
    return met.select(held.alias("p"), "id").select(F.col("p.q").alias("question_id"), F.col("id").alias("source_id"))


GOLD_SOURCES_SQL = """
gold_sources AS (
  SELECT 'g' || item_id AS question_id, CAST(d.doc_id AS VARCHAR) AS source_id
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings on the five rubric dimensions from the labels, with the language as difficulty.

    A document of unknown length has no rating for completeness.
    """
    labels = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )
    rated = F.array(
        F.struct(F.lit("correctness").alias("dimension"), (1 + 4 * F.col("quality")).alias("score")),
        F.struct(F.lit("tone").alias("dimension"), (5 - 4 * F.col("toxic")).alias("score")),
        F.struct(
            F.lit("completeness").alias("dimension"),
            F.when(F.col("n_chars") < 500, 1).when(F.col("n_chars") < 2000, 3).when(F.col("n_chars") >= 2000, 5).alias("score"),
        ),
        F.struct(F.lit("groundedness").alias("dimension"), (3 + 2 * F.col("quality") - 2 * F.col("toxic")).alias("score")),
        F.struct(F.lit("helpfulness").alias("dimension"), (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).alias("score")),
    )
    return labels.select(F.col("lang").alias("difficulty"), F.explode(rated).alias("r")).select(
        "difficulty", "r.dimension", F.col("r.score").cast("int").alias("score")
    )


SCORES_SQL = """
scores AS (
  SELECT lang AS difficulty, 'correctness' AS dimension, 1 + 4 * quality AS score FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'tone', 5 - 4 * toxic FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'groundedness', 3 + 2 * quality - 2 * toxic FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'helpfulness', 1 + 2 * quality + 2 * (1 - toxic) FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT lang, 'completeness', CASE WHEN n_chars < 500 THEN 1 WHEN n_chars < 2000 THEN 3 WHEN n_chars >= 2000 THEN 5 END
  FROM labels JOIN documents USING (doc_id))"""

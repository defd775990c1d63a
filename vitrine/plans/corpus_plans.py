"""Registered corpus and storage queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import vector
from vitrine.functions.text import fixed_chunks
from vitrine.operators import corpus
from vitrine.plans.catalog_plans import RENDER_SQL
from vitrine.plans.views import CATALOG_SQL, DOCUMENTS_SQL, GOLD_SQL, catalog, documents, gold, spread_documents, table
from vitrine.sources.points import dimension_check, new_point_table, upsert

DIM = 64


def document_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "text", F.length("text").cast("bigint").alias("n_chars"))


def document_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return corpus.lookup_documents(requests, documents(spark, sf_dir))


def document_excerpt(spark, sf_dir):
    return corpus.excerpts(documents(spark, sf_dir))


def gold_scan(spark, sf_dir):
    return gold(spark, sf_dir).withColumn("required_facts", F.array_join("required_facts", "|"))


def _flat_chunks(chunks):
    return chunks.select(
        "id", "text", F.col("payload.policy_id").alias("policy_id"),
        F.col("payload.chunk_index").cast("bigint").alias("chunk_index"),
    )


def chunk_fixed(spark, sf_dir):
    return _flat_chunks(corpus.document_chunks(spread_documents(spark, sf_dir), fixed_chunks(F.col("text"))))


def chunk_recursive(spark, sf_dir):
    return _flat_chunks(corpus.document_chunks(spread_documents(spark, sf_dir)))


def shop_corpus(spark, sf_dir):
    return corpus.corpus(catalog(spark, sf_dir), spread_documents(spark, sf_dir))


def corpus_union(spark, sf_dir):
    return shop_corpus(spark, sf_dir).select(
        "id", "source_type", "text", F.col("payload.sku").alias("sku"),
        F.col("payload.policy_id").alias("policy_id"),
        F.col("payload.chunk_index").cast("bigint").alias("chunk_index"),
    )


def upsert_latest(spark, sf_dir):
    """Documents are stored; labels replace some of them, conversations add versioned keys."""
    existing = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit(0).cast("bigint").alias("version"),
        F.col("lang").alias("kind"), F.col("text").alias("body"),
    )
    labelled = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit(1).cast("bigint").alias("version"),
        F.lit("labelled").alias("kind"), F.concat(F.lit("quality "), "quality").alias("body"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), "conv_id").alias("id"), F.col("turn").alias("version"),
        F.col("role").alias("kind"), F.col("text").alias("body"),
    )
    return upsert(existing, labelled.unionByName(turns))


def upsert_stored(spark, sf_dir):
    """A stored collection after two upserts and one that failed, and the points that it rejected.

    The vectors create it; labelled documents replace some of them, one that comes with an older
    version does not; documents of one language come without a vector and are rejected.
    """
    points = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("id"), F.lit(5).cast("bigint").alias("version"),
        F.concat(F.lit("label "), "label").alias("note"), "embedding",
    )
    labels = table(spark, sf_dir, "labels").withColumn("id", F.concat(F.lit("v"), "doc_id"))
    rated = points.select("id", "embedding").join(labels, "id").select(
        "id", (5 + F.col("quality") - F.col("toxic")).cast("bigint").alias("version"),
        F.concat(F.lit("quality "), "quality").alias("note"), "embedding",
    )
    empty = F.array().cast("array<float>")
    bare = table(spark, sf_dir, "documents").where("lang = 'de'").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(1).cast("bigint").alias("version"), F.col("lang").alias("note"),
        empty.alias("embedding"),
    )
    stored = new_point_table(spark, DIM)
    stored.upsert(points)
    broken = rated.withColumn("note", F.when(F.col("version") == 5, F.raise_error(F.lit("write broken off"))).otherwise("note"))
    try:
        stored.upsert(broken.withColumn("version", F.col("version") + 100))
    except Exception as error:
        if "write broken off" not in str(error):
            raise
    rejected = stored.upsert(rated.unionByName(bare))
    kept = stored.read().withColumn("stored", F.lit(True))
    return kept.unionByName(rejected.drop("dim", "accepted").withColumn("stored", F.lit(False))).select(
        "id", "version", "note", F.size("embedding").cast("bigint").alias("dim"), "stored"
    )


def vector_dim_check(spark, sf_dir):
    checked = dimension_check(table(spark, sf_dir, "embeddings"), DIM)
    return checked.select("vec_id", F.col("dim").cast("bigint").alias("dim"), "accepted")


def l2_normalize(spark, sf_dir):
    """Centred vectors, whose length is not one, brought to unit length."""
    shifted = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.5)
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.unit(shifted)).alias("pos", "value"))
    return unit.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


WINDOWS_SQL = """
chunks AS (
  SELECT id || '_chunk_' || i AS id, substr(text, CAST(i * 448 + 1 AS BIGINT), 512) AS text, id AS policy_id, i AS chunk_index
  FROM (SELECT id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 512) / 448.0)) AS BIGINT))) AS i
        FROM docs WHERE length(text) > 0))"""


def _level_sql(level: int, separator: str) -> str:
    """Pieces of the level's texts: runs of short ones to pack, long ones for the next level."""
    here, after, size = f"long{level}", f"long{level + 1}", len(separator)
    code = " || ".join(f"chr({ord(c)})" for c in separator)
    return f"""
parts{level} AS (
  SELECT id, base, unnest(string_split(text, {code})) AS part,
         generate_subscripts(string_split(text, {code}), 1) AS n FROM {here}),
pieces{level} AS (
  SELECT id, base, n, CASE WHEN n = 1 THEN part ELSE {code} || part END AS piece,
         length(part) + CASE WHEN n = 1 THEN 0 ELSE {size} END AS len FROM parts{level}),
placed{level} AS (
  SELECT id, base, n, piece, len, sum(len) OVER (PARTITION BY id, base ORDER BY n) - len + base AS pos,
         count(*) FILTER (WHERE len >= 512) OVER (PARTITION BY id, base ORDER BY n) AS grp
  FROM pieces{level} WHERE len > 0),
{after} AS (SELECT id, CAST(pos AS BIGINT) AS base, piece AS text FROM placed{level} WHERE len >= 512),
runs{level} AS (
  SELECT id, CAST(min(pos) AS BIGINT) AS base, string_agg(piece, '' ORDER BY n) AS text, {code} AS sep
  FROM placed{level} WHERE len < 512 GROUP BY id, base, grp)"""


_BLANK = "[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+"

# Packs each run a chunk at a time: the chunk ends at the last separator within
# 512 characters; the next one starts at the first separator of the tail.
CHUNK_SQL = f"""
long1 AS (SELECT id, CAST(0 AS BIGINT) AS base, text FROM docs WHERE length(text) > 0),
{_level_sql(1, chr(10) * 2)}, {_level_sql(2, chr(10))}, {_level_sql(3, " ")},
runs AS (SELECT * FROM runs1 UNION ALL SELECT * FROM runs2 UNION ALL SELECT * FROM runs3),
packed(id, base, pos, size, next_at) AS (
  SELECT id, base, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM runs
  UNION ALL
  SELECT id, base, pos, size,
         CASE WHEN pos + size < total THEN pos + size - room + instr(substr(win, size - room + 1), sep) - 1 END
  FROM (SELECT *, least(64, 512 - CASE WHEN following > 0 THEN following ELSE length(win) - size END) AS room
    FROM (SELECT *, instr(substr(win, size + 2), sep) AS following
      FROM (SELECT *, CASE WHEN total - pos <= 512 THEN total - pos
                      ELSE length(head) - instr(reverse(head), sep) + 1 - length(sep) END AS size
        FROM (SELECT p.id, p.base, p.next_at AS pos, r.sep, length(r.text) AS total,
                     substr(r.text, p.next_at + 1, 1024) AS win, substr(r.text, p.next_at + 1, 512 + length(r.sep)) AS head
              FROM packed p JOIN runs r ON r.id = p.id AND r.base = p.base WHERE p.next_at IS NOT NULL))))),
windows AS (
  SELECT id, base + i * 448 AS start, substr(text, CAST(i * 448 + 1 AS BIGINT), 512) AS text
  FROM (SELECT *, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 512) / 448.0)) AS BIGINT))) AS i FROM long4)),
cut AS (
  SELECT p.id, p.base + p.pos AS start, substr(r.text, p.pos + 1, p.size) AS text
  FROM packed p JOIN runs r ON r.id = p.id AND r.base = p.base WHERE p.size > 0
  UNION ALL SELECT id, start, text FROM windows),
stripped AS (
  SELECT id, start, regexp_replace(regexp_replace(text, '^{_BLANK}', ''), '{_BLANK}$', '') AS text FROM cut),
chunks AS (
  SELECT policy_id || '_chunk_' || chunk_index AS id, text, policy_id, chunk_index
  FROM (SELECT text, id AS policy_id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS chunk_index
        FROM stripped WHERE text <> ''))"""

# needs WITH RECURSIVE
CORPUS_SQL = f"""{CATALOG_SQL}, {DOCUMENTS_SQL}, {CHUNK_SQL},
corpus AS (
  SELECT sku AS id, 'product' AS source_type, {RENDER_SQL} AS text, sku,
         CAST(NULL AS VARCHAR) AS policy_id, CAST(NULL AS BIGINT) AS chunk_index FROM catalog
  UNION ALL SELECT id, 'policy', text, NULL, policy_id, chunk_index FROM chunks)"""

QUERIES = {
    "document_scan": document_scan,
    "document_lookup": document_lookup,
    "document_excerpt": document_excerpt,
    "gold_scan": gold_scan,
    "chunk_fixed": chunk_fixed,
    "chunk_recursive": chunk_recursive,
    "corpus_union": corpus_union,
    "upsert_latest": upsert_latest,
    "upsert_stored": upsert_stored,
    "vector_dim_check": vector_dim_check,
    "l2_normalize": l2_normalize,
}

ORACLES = {
    "document_scan": f"WITH {DOCUMENTS_SQL} SELECT id, text, length(text) AS n_chars FROM docs",
    "document_lookup": f"""WITH {DOCUMENTS_SQL}
        SELECT r.id, coalesce(d.text, 'Policy ''' || r.id || ''' not found.') AS text
        FROM (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part) r LEFT JOIN docs d ON d.id = r.id""",
    "document_excerpt": f"WITH {DOCUMENTS_SQL} SELECT id, substr(text, 1, 300) || '...' AS excerpt FROM docs",
    "gold_scan": f"""WITH {GOLD_SQL} SELECT id, question, expected_answer, source_type,
        array_to_string(required_facts, '|') AS required_facts, difficulty FROM gold""",
    "chunk_fixed": f"WITH {DOCUMENTS_SQL}, {WINDOWS_SQL} SELECT id, text, policy_id, chunk_index FROM chunks",
    "chunk_recursive": f"WITH RECURSIVE {DOCUMENTS_SQL}, {CHUNK_SQL} SELECT id, text, policy_id, chunk_index FROM chunks",
    "corpus_union": f"WITH RECURSIVE {CORPUS_SQL} SELECT id, source_type, text, sku, policy_id, chunk_index FROM corpus",
    "upsert_latest": """WITH points AS (
        SELECT 'doc_' || doc_id AS id, CAST(0 AS BIGINT) AS version, lang AS kind, text AS body FROM documents
        UNION ALL SELECT 'doc_' || doc_id, 1, 'labelled', 'quality ' || quality FROM labels
        UNION ALL SELECT 'conv_' || conv_id, turn, role, text FROM conversations)
        SELECT id, version, kind, body FROM points
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""",
    "upsert_stored": """WITH points AS (
        SELECT 'v' || vec_id AS id, CAST(5 AS BIGINT) AS version, 'label ' || label AS note, len(embedding) AS dim, 0 AS later
        FROM embeddings
        UNION ALL SELECT 'v' || vec_id, 5 + quality - toxic, 'quality ' || quality, len(embedding), 1
        FROM embeddings JOIN labels ON vec_id = doc_id),
        kept AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, later DESC) = 1)
        SELECT id, version, note, dim, true AS stored FROM kept
        UNION ALL SELECT 'd' || doc_id, 1, lang, 0, false FROM documents WHERE lang = 'de'""",
    "vector_dim_check": "SELECT vec_id, len(embedding) AS dim, len(embedding) = 64 AS accepted FROM embeddings",
    "l2_normalize": """WITH shifted AS (
        SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.5) AS v FROM embeddings),
        numbered AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM shifted)
        SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM numbered""",
}

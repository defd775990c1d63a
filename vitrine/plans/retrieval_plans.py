"""Registered retrieval queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import dense, fusion, lexical
from vitrine.plans.corpus_plans import CORPUS_SQL, shop_corpus
from vitrine.plans.views import DOCUMENTS_SQL, GOLD_SQL, QUESTIONS_SQL, documents, gold, questions, spread_documents, table
from vitrine.session import input_state, materialise, still_stored

K = 3


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")


def _ranked(hits):
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


_collections: dict[tuple, dense.VectorIndex] = {}


def vector_index(spark, sf_dir) -> dense.VectorIndex:
    """The vectors in blocks, built on first use."""
    key = (spark.sparkContext.applicationId, input_state(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _collections or not still_stored(_collections[key].vectors):
        _collections[key] = dense.build_index(_vectors(spark, sf_dir))
    return _collections[key]


def vector_topk(spark, sf_dir):
    return _ranked(dense.search_index(vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), K))


def vector_topk_filtered(spark, sf_dir):
    wanted = "label = 3 OR label >= 8"
    return _ranked(dense.search_index(vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), K, wanted))


def hits_with_text(spark, sf_dir):
    """Documents carry the number of a vector as id; vectors beyond them have no text."""
    corpus = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.lit("policy").alias("source_type")
    )
    return dense.with_text(vector_topk(spark, sf_dir), corpus)


_counts: dict[tuple, lexical.TermCounts] = {}
_indexes: dict[tuple, lexical.LexicalIndex] = {}


def document_index(spark, sf_dir, scheme: str) -> lexical.LexicalIndex:
    """The text index of the documents: built on first use, then shared by all searches.

    The scratch folder may be emptied between queries; then it is built again, as
    it is when the files of the documents are others.
    """
    docs = spread_documents(spark, sf_dir)
    key = (spark.sparkContext.applicationId, input_state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _counts or not still_stored(_counts[key].packed) or not still_stored(_counts[key].frequencies):
        _counts[key] = lexical.count_terms(docs)
        for scheme_key in [k for k in _indexes if k[:2] == key]:
            del _indexes[scheme_key]
    if (*key, scheme) not in _indexes or not still_stored(_indexes[(*key, scheme)].packed):
        _indexes[(*key, scheme)] = lexical.build_index(docs, scheme, counts=_counts[key])
    return _indexes[(*key, scheme)]


_corpora: dict[tuple, tuple] = {}


def chunk_index(spark, sf_dir):
    """The stored chunk corpus and its BM25 index, built on first use."""
    states = tuple(input_state(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "part", "lineitem"))
    key = (spark.sparkContext.applicationId, states)
    known = _corpora.get(key)
    stored = known and (known[0], known[1].packed, known[1].frequencies)
    if not stored or not all(still_stored(part) for part in stored):
        corpus = materialise(shop_corpus(spark, sf_dir).select("*", "payload.category", "payload.price_eur"), "corpus")
        _corpora[key] = (corpus, lexical.build_index(corpus, facets=("source_type", "category", "price_eur")))
    return _corpora[key]


def _text_topk(scheme: str, k: int):
    return lambda spark, sf_dir: _ranked(
        lexical.search(document_index(spark, sf_dir, scheme), questions(spark, sf_dir), k)
    )


WANTED = "source_type = 'policy' OR category LIKE '%BRUSHED%' AND price_eur <= 1200"


def bm25_topk_filtered(spark, sf_dir):
    """Hits among policy chunks and the cheaper products of some categories."""
    _, index = chunk_index(spark, sf_dir)
    return _ranked(lexical.search(index, questions(spark, sf_dir), K, WANTED))


def bm25_topk_updated(spark, sf_dir):
    """Hits after an update of the document index: labelled documents of low quality are cut to their
    first sentence, benchmark passages are added, toxic documents are removed."""
    index = document_index(spark, sf_dir, "bm25")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    docs = documents(spark, sf_dir)
    poor = docs.join(labels.where("quality = 0 AND toxic = 0"), "id").select("id", F.split("text", "[.]")[0].alias("text"))
    passages = gold(spark, sf_dir).select("id", F.col("question").alias("text"))
    updated = lexical.update_index(index, poor.unionByName(passages), labels.where("toxic = 1"))
    return _ranked(lexical.search(updated, questions(spark, sf_dir), K))


def hybrid_rrf(spark, sf_dir):
    indexes = [document_index(spark, sf_dir, scheme) for scheme in ("bm25", "tfidf")]
    searches = [lambda asked, depth, i=i: lexical.search(i, asked, depth, prune=False) for i in indexes]
    places = [lambda asked, pairs, i=i: lexical.places(i, asked, pairs) for i in indexes]
    return _ranked(fusion.fuse_looked_up(*searches, *places, questions(spark, sf_dir), K))


def tfidf_vectors(spark, sf_dir):
    vectors = lexical.term_vectors(document_index(spark, sf_dir, "tfidf"))
    return vectors.withColumn("w", F.round("w", 6))


VECTOR_SQL = """
cosines AS (
  SELECT q.vec_id AS question_id, v.vec_id AS id, v.label,
         round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) q,
       (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v)"""

VECTOR_HITS_SQL = """
hits AS (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score
  FROM cosines QUALIFY rank <= 3)"""


def words_sql(name: str, source: str, key: str, text: str) -> str:
    return (
        f"{name} AS (SELECT {key}, list_filter(string_split_regex(lower({text}), '\\s+'), "
        f"lambda w: w <> '') AS words FROM {source})"
    )


def bm25_sql(source: str, asked: str = "questions", query: str = "query", k: int = K, hits: str = "hits") -> str:
    """Hits of the rows of ``asked (question_id, ...)`` in ``source (id, text)``."""
    return f"""
{words_sql('b_docs', source, 'id', 'text')},
{words_sql('b_asked', asked, 'question_id', query)},
b_totals AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM b_docs),
b_tf AS (SELECT id, n_words, term, count(*) AS tf
         FROM (SELECT id, len(words) AS n_words, unnest(words) AS term FROM b_docs) GROUP BY ALL),
b_df AS (SELECT term, count(*) AS df FROM b_tf GROUP BY term),
b_terms AS (SELECT DISTINCT question_id, unnest(words) AS term FROM b_asked),
b_scores AS (
  SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
         / (tf + 1.5 * (1 - 0.75 + 0.75 * n_words / mean))), 6) AS score
  FROM b_terms JOIN b_tf USING (term) JOIN b_df USING (term), b_totals GROUP BY question_id, id),
{hits} AS (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score
  FROM b_scores QUALIFY rank <= {k})"""


def tfidf_sql(k: int = K, hits: str = "hits") -> str:
    return f"""
{words_sql('t_docs', 'docs', 'id', 'text')},
{words_sql('t_asked', 'questions', 'question_id', 'query')},
t_totals AS (SELECT count(*) AS n FROM t_docs),
t_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM t_docs) GROUP BY ALL),
t_df AS (SELECT term, count(*) AS df FROM t_tf GROUP BY term),
t_raw AS (SELECT id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM t_tf JOIN t_df USING (term), t_totals),
t_vectors AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM t_raw),
t_qtf AS (SELECT question_id, term, count(*) AS tf
          FROM (SELECT question_id, unnest(words) AS term FROM t_asked) GROUP BY ALL),
t_qraw AS (SELECT question_id, term, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS w
           FROM t_qtf LEFT JOIN t_df USING (term), t_totals),
t_qvectors AS (SELECT question_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS wq FROM t_qraw),
t_scores AS (SELECT question_id, id, round(sum(wq * w), 6) AS score
             FROM t_qvectors JOIN t_vectors USING (term) GROUP BY question_id, id),
{hits} AS (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score
  FROM t_scores QUALIFY rank <= {k})"""


CHUNK_HITS_SQL = f"{CORPUS_SQL}, {QUESTIONS_SQL}, {bm25_sql('corpus')}"

QUERIES = {
    "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "hits_with_text": hits_with_text,
    "tfidf_vectors": tfidf_vectors,
    "tfidf_topk": _text_topk("tfidf", K),
    "bm25_topk": _text_topk("bm25", K),
    "bm25_topk_filtered": bm25_topk_filtered,
    "bm25_topk_updated": bm25_topk_updated,
    "hybrid_rrf": hybrid_rrf,
}

ORACLES = {
    "vector_topk": f"WITH {VECTOR_SQL}, {VECTOR_HITS_SQL} SELECT question_id, rank, id, score FROM hits",
    "vector_topk_filtered": f"""WITH {VECTOR_SQL} SELECT question_id,
        row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score
        FROM cosines WHERE label = 3 OR label >= 8 QUALIFY rank <= 3""",
    "hits_with_text": f"""WITH {VECTOR_SQL}, {VECTOR_HITS_SQL}
        SELECT id, question_id, rank, score, coalesce(text, '') AS text,
               CASE WHEN doc_id IS NULL THEN 'unknown' ELSE 'policy' END AS source_type
        FROM hits LEFT JOIN documents ON doc_id = id""",
    "tfidf_vectors": f"WITH {DOCUMENTS_SQL}, {QUESTIONS_SQL}, {tfidf_sql()} SELECT id, term, round(w, 6) AS w FROM t_vectors",
    "tfidf_topk": f"WITH {DOCUMENTS_SQL}, {QUESTIONS_SQL}, {tfidf_sql()} SELECT question_id, rank, id, score FROM hits",
    "bm25_topk": f"WITH {DOCUMENTS_SQL}, {QUESTIONS_SQL}, {bm25_sql('docs')} SELECT question_id, rank, id, score FROM hits",
    "bm25_topk_filtered": f"""WITH RECURSIVE {CORPUS_SQL}, {QUESTIONS_SQL}, {bm25_sql('corpus', k=10**12, hits='scored')}
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, scored.id) AS rank, scored.id, score
        FROM scored JOIN corpus USING (id) LEFT JOIN catalog ON catalog.sku = corpus.sku
        WHERE source_type = 'policy' OR category LIKE '%BRUSHED%' AND price_eur <= 1200 QUALIFY rank <= 3""",
    "bm25_topk_updated": f"""WITH {DOCUMENTS_SQL}, {QUESTIONS_SQL}, {GOLD_SQL},
        rated AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels),
        updated AS (
          SELECT id, CASE WHEN quality = 0 THEN string_split(text, '.')[1] ELSE text END AS text
          FROM docs LEFT JOIN rated USING (id) WHERE coalesce(toxic, 0) <> 1
          UNION ALL SELECT id, question FROM gold),
        {bm25_sql('updated')} SELECT question_id, rank, id, score FROM hits""",
    "hybrid_rrf": f"""WITH {DOCUMENTS_SQL}, {QUESTIONS_SQL}, {bm25_sql('docs', k=10**12, hits='sparse')},
        {tfidf_sql(k=10**12, hits='dense')}, fused AS (
        SELECT coalesce(s.question_id, d.question_id) AS question_id, coalesce(s.id, d.id) AS id,
               round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 6) AS score
        FROM sparse s FULL OUTER JOIN dense d ON s.question_id = d.question_id AND s.id = d.id)
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score
        FROM fused QUALIFY rank <= 3""",
}

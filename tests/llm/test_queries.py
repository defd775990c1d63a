"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from vitrine.llm import stages
from vitrine.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()) == sorted(cursor.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op12_spelling_variants"}))
def test_a_row_for_every_row(spark, name):
    source, times = {"op1_html_text": ("pages", 1), "op11_whitening": ("embeddings", 4)}.get(name, ("documents", 1))
    assert QUERIES[name](spark, SF).count() == times * spark.read.parquet(f"{SF}/{source}.parquet").count()


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(result) < docs.count() and all(r.exact for r in result)


@needs_data
def test_stages_take_odd_rows(spark, odd_docs, clashing, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, clashing):
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if stage is not stages.token_ids:
                assert out.columns == stages.COLUMNS
        assert stage(spark, no_docs, SF).count() == 0, name

"""Cases in which rows were once lost: repeated and unknown skus, odd vectors, deep ranks, short passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_products
from vitrine.operators import blocks, catalog, dense, fusion


def shop_of(spark, rows):
    return as_products(
        spark,
        [(i, sku, f"{sku}{i}", "c", "f", [], list(stock), price, stock, "", [], "") for i, (sku, price, stock) in enumerate(rows)],
    )


def test_alternatives_with_repeated_skus(spark):
    shop = shop_of(spark, [("a", 1.0, {"M": 0}), ("a", 2.0, {"M": 3}), ("a", 2.5, {"M": 3}), ("b", 3.0, {"M": 1}), ("b", 3.5, {"M": 1}), ("c", 4.0, {"M": 1}), ("d", None, {"M": 1}), ("e", 9.0, {"M": 1})])
    asked = spark.createDataFrame([("a", "M")], "sku string, size string")
    rows = {(r.place, r.alt_sku, r.alt_price) for r in catalog.alternatives(asked, shop, 3).collect()}
    assert rows == {(1, "b", 3.0), (2, "c", 4.0), (3, "e", 9.0)}


def test_unknown_sku_is_not_offered(spark):
    shop = shop_of(spark, [("a", 1.0, {"M": 1, "L": 2}), ("b", 1.0, None or {})])
    asked = spark.createDataFrame([("a", "M"), ("zz", "M"), ("b", "S")], "sku string, size string")
    rows = {r.sku: (r.status, r.other_sizes) for r in catalog.size_availability(asked, shop).collect()}
    assert rows == {"a": ("available", ["L"]), "zz": ("not offered", []), "b": ("not offered", [])}


def test_scores_that_are_no_numbers():
    scores = np.random.default_rng(0).random((5, 1000))
    clean = scores.copy()
    scores[:, [3, 400, 900]] = np.nan
    clean[:, [3, 400, 900]] = -1
    row, column = blocks.top_cells(scores, 3)
    expected_row, expected_column = blocks.top_cells(clean, 3)
    assert len(row) == 15 and (row == expected_row).all() and (column == expected_column).all()


def test_vectors_with_missing_elements_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [0.0, 1.0]), (5, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = vectors.where("id IN (1, 4)").withColumnRenamed("id", "question_id")
    got = {(r.question_id, r["rank"], r.id) for r in dense.search(vectors, asked, 2).collect()}
    assert got == {(1, 1, 1), (1, 2, 4), (4, 1, 4), (4, 2, 1)}


def test_vectors_of_different_sizes_raise(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="different sizes"):
        dense.search(vectors, vectors.withColumnRenamed("id", "question_id"), 1).collect()


def test_fusion_of_whole_lists(spark):
    draw = random.Random(5)
    lists = {}
    for q in range(12):
        ids = list(range(60 if q else 2))
        first, second = ids[:], ids[: 1 + len(ids) // 2]
        draw.shuffle(first)
        draw.shuffle(second)
        lists[q] = (first, second)

    def search(i):
        rows = [(q, r, d) for q, pair in lists.items() for r, d in enumerate(pair[i], 1)]
        whole = spark.createDataFrame(rows, "question_id int, rank int, id int")
        return lambda asked, depth: whole.join(asked, "question_id", "left_semi").where(F.col("rank") <= depth)

    asked = spark.createDataFrame([(q,) for q in lists], "question_id int")
    got = {(r.question_id, r["rank"], r.id) for r in fusion.fuse_whole_lists(search(0), search(1), asked, 3, depth=4).collect()}
    expected = set()
    for q, pair in lists.items():
        score = {}
        for ids in pair:
            for r, d in enumerate(ids, 1):
                score[d] = score.get(d, 0) + 1 / (60 + r)
        ranked = sorted(score, key=lambda d: (-round(score[d], 6), d))[:3]
        expected |= {(q, i, d) for i, d in enumerate(ranked, 1)}
    assert got == expected


def test_short_passages_find_their_documents(spark, tmp_path):
    from vitrine.plans import views

    spark.createDataFrame([(1, "beta gamma delta"), (2, "not there"), (3, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "gamma delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.question_id, r.source_id) for r in views.gold_sources(spark, str(tmp_path)).collect()}
    assert got == {("g1", "1"), ("g2", None), ("g3", "1")}

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import decontaminate as D

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short item"),
    (3, None),
    (4, ""),
    (5, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "naïve café"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    mine, hit, found = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        n = min(width, len(theirs))
        wins = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if n and tuple(mine[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(mine), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


TEXTS = [
    "so: alpha, beta gamma delta epsilon zeta eta theta iota kappa! and lambda",
    "SHORT ITEM short item item short",
    "xx naïve café yy",
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3,
    None,
    "",
]


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, benchmark, odd_rows, bound):
    rows = [*enumerate(TEXTS), *[(100 + i, r[1]) for i, r in enumerate(odd_rows)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in D.find_hits(docs, benchmark, max_broadcast_bytes=bound).collect()}
    assert got == {i: brute(t, ITEMS) for i, t in rows}


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_BYTES, 0])
def test_empty_tables_and_clashes(spark, benchmark, no_docs, clashing, bound):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.find_hits(no_docs, benchmark, max_broadcast_bytes=bound).count() == 0
    found = D.find_hits(clashing, nothing, max_broadcast_bytes=bound)
    assert found.count() == clashing.count() and found.agg(F.sum("n_hit")).head()[0] == 0


def test_removal(spark, benchmark):
    docs = spark.createDataFrame([(1, "a short item b"), (2, "clean"), (3, None)], "doc_id long, text string")
    hits = D.find_hits(docs, benchmark)
    assert sorted(r.doc_id for r in D.without_documents(hits).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in D.without_spans(hits).collect()} == {1: "a  b", 2: "clean", 3: None}


def test_words_decide_not_hashes(spark, benchmark, monkeypatch):
    monkeypatch.setattr(D, "gram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    rows, expected = list(enumerate(TEXTS)), {i: brute(t, ITEMS) for i, t in enumerate(TEXTS)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # the functions that hash for the joins are nested, so tasks get them with what they name here
    found = D.find_hits(docs, benchmark, max_broadcast_bytes=0).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found} == expected
    known = D.WindowSet([tuple(r) for r in D.benchmark_windows(benchmark).collect()])
    scanned = [D._scan(np.frombuffer((t or "").encode(), np.uint8), known, known.tables()) for _, t in rows]
    assert dict(enumerate(r[:3] for r in scanned)) == expected


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_BYTES, 0])
def test_a_window_in_every_text(spark, benchmark, bound):
    rows = [(i, f"text {i} with a short item in it, short item") for i in range(1200)] + [(None, "short item")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = D.find_hits(docs, benchmark, max_broadcast_bytes=bound).groupBy("n_words", "n_hit", "items").count().collect()
    assert sorted((r.n_words, r.n_hit, list(r["items"]), r["count"]) for r in found) == [(2, 2, ["2"], 300), (10, 4, ["2"], 1200)]

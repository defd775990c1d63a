import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.functions import vector
from vitrine.operators import blocks, dense, fusion, lexical


def ranked(hits):
    return sorted((r.question_id, r["rank"], r.id, r.score) for r in hits.collect())


def top(scores, k):
    """``{(question, id): score}`` to ranked rows."""
    rows = []
    for question in sorted({q for q, _ in scores}):
        own = sorted((-round(s, 6), i) for (q, i), s in scores.items() if q == question)
        rows += [(question, n, i, -s) for n, (s, i) in enumerate(own[:k], 1)]
    return rows


def assert_same(found, expected):
    """Equal rows; scores may differ in the last decimal only."""
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in expected], abs=1.1e-6)


def bm25(questions, docs):
    words = {i: t.lower().split() for i, t in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    scores = {}
    for q, text in questions.items():
        for i, ws in words.items():
            tf, total = Counter(ws), 0.0
            for term in set(text.lower().split()) & set(tf):
                idf = math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5))
                total += idf * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            if total > 0:
                scores[q, i] = total
    return scores


def tfidf(questions, docs):
    words = {i: Counter(t.lower().split()) for i, t in docs.items()}
    df = Counter(w for ws in words.values() for w in ws)

    def unit(counts):
        weights = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / length for t, w in weights.items()}

    vectors = {i: unit(c) for i, c in words.items()}
    scores = {}
    for q, text in questions.items():
        asked = unit(Counter(text.lower().split()))
        for i, v in vectors.items():
            if set(asked) & set(v):
                scores[q, i] = sum(w * v.get(t, 0.0) for t, w in asked.items())
    return scores


@pytest.fixture(scope="module")
def library():
    """Texts where one word is in every text, and a third are copies of one text."""
    random.seed(7)
    words = [f"w{n}" for n in range(60)]
    docs = {f"d{n:03d}": "the " + " ".join(random.choices(words, k=random.randint(3, 40))) for n in range(120)}
    for n in range(60):
        docs[f"x{n:03d}"] = "the same copied text W1 w2"
    docs["blank"] = "  \n "
    questions = {f"q{n:02d}": "The " + " ".join(random.choices(words, k=random.randint(1, 8))) for n in range(30)}
    questions |= {"copy": "same copied w2", "common": "the", "again": "w1 W1 w1", "none": "nothing known", "empty": ""}
    return questions, docs


def frames(spark, questions, docs):
    asked = spark.createDataFrame(list(questions.items()), "question_id string, query string")
    corpus = spark.createDataFrame(list(docs.items()), "id string, text string")
    return asked, corpus


@pytest.mark.parametrize("scheme, brute", [("bm25", bm25), ("tfidf", tfidf)])
@pytest.mark.parametrize("per_block", [10_000, 150])
def test_text_search_equals_brute_force(spark, library, scheme, brute, per_block):
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    index = lexical.build_index(corpus, scheme, per_block=per_block)
    assert_same(ranked(lexical.search(index, asked, 5)), top(brute(questions, docs), 5))


def test_batches_split_inside_a_question(spark, library):
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    index = lexical.build_index(corpus, per_block=400)
    expected = top(bm25(questions, docs), 3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert_same(ranked(lexical.search(index, asked, 3)), expected)
    finally:
        spark.conf.set(key, before)


def test_more_hits_wanted_than_texts_and_empty_corpus(spark):
    asked, corpus = frames(spark, {"q": "a b"}, {"1": "a", "2": "b b", "3": "c"})
    index = lexical.build_index(corpus)
    assert sorted(r[2] for r in ranked(lexical.search(index, asked, 10))) == ["1", "2"]
    nothing = lexical.build_index(corpus.filter("false"))
    assert ranked(lexical.search(nothing, asked, 3)) == []
    with pytest.raises(ValueError):
        lexical.build_index(corpus, "other")


def test_filtered_text_search(spark, library):
    """Only wanted texts are hits, by the statistics of all; blocks are ranges of the facets."""
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    corpus = corpus.withColumn("kind", F.substring("id", 1, 1)).withColumn("price", F.when(F.col("kind") == "d", F.expr("CAST(substring(id, 2) AS INT) * 0.5")))
    index = lexical.build_index(corpus, per_block=200, facets=("kind", "price"))
    scores = bm25(questions, docs)
    for where, wanted in (
        ("kind = 'd' AND price <= 20", lambda i: i[0] == "d" and int(i[1:]) <= 40),
        ("kind <> 'd' OR price = 3", lambda i: i[0] != "d" or i == "d006"),
        ("kind = 'nothing'", lambda i: False),
    ):
        expected = top({(q, i): s for (q, i), s in scores.items() if wanted(i)}, 4)
        assert_same(ranked(lexical.search(index, asked, 4, where)), expected)
    assert_same(ranked(lexical.search(index, asked, 4)), top(scores, 4))
    with pytest.raises(ValueError):
        lexical.search(lexical.build_index(corpus), asked, 3, "price < 1")


@pytest.mark.parametrize("facets", [(), ("kind",)])
def test_updated_index_equals_one_built_anew(spark, library, facets):
    """Texts come, change and go in three updates; a word that all texts hold changes its frequency each time."""
    questions, docs = library
    docs = dict(docs)
    asked, corpus = frames(spark, questions | {"late": "brandnew w3 the"}, docs)
    kind = F.length("id").alias("kind")
    index = lexical.build_index(corpus.select("*", kind), per_block=300, facets=facets)
    updates = [
        ({"d001": "the w1 w1 w1", "new1": "brandnew the", "x000": ""}, ["d002", "x001", "unknown"]),
        ({"new1": "brandnew brandnew w3", "d002": "the word is back"}, [f"x{n:03d}" for n in range(40)]),
        ({}, ["new1", "d001"]),
    ]
    for changed, removed in updates:
        fresh = spark.createDataFrame(list(changed.items()), "id string, text string").select("*", kind)
        index = lexical.update_index(index, fresh, spark.createDataFrame([(i,) for i in removed], "id string"))
        for i in removed:
            docs.pop(i, None)
        docs |= changed
        expected = top(bm25(questions | {"late": "brandnew w3 the"}, docs), 4)
        assert_same(ranked(lexical.search(index, asked, 4)), expected)
        anew = lexical.build_index(frames(spark, {"q": ""}, docs)[1])
        assert (index.n_docs, index.n_words) == (anew.n_docs, anew.n_words)
        assert sorted(map(tuple, index.frequencies.collect())) == sorted(map(tuple, anew.frequencies.collect()))
    with pytest.raises(ValueError):
        lexical.update_index(lexical.build_index(corpus, "tfidf"), corpus)


def test_vector_blocks_out_of_reach_are_not_scored(spark):
    """Bundles of vectors about 12 directions, a third of all rows copies of one: each query meets few blocks."""
    draw = np.random.default_rng(2)
    directions = np.eye(12)[draw.integers(0, 12, 400)] + 0.02 * draw.normal(size=(400, 12))
    points = [*directions, *[directions[0]] * 200, np.zeros(12), -directions[1]]
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)], "id long, embedding array<double>, kind int")
    asked = vectors.where("id % 9 = 0 OR id >= 600").select(F.col("id").alias("question_id"), "embedding")
    index = dense.build_index(vectors, per_block=20)
    assert index.n_blocks >= 30
    first = dense.materialise(dense._to_blocks(index, asked.withColumn("floor", F.lit(None).cast("double"))), "first")
    assert first.groupBy("question_id").count().where("count <> 1").count() == 0
    reached = dense._to_blocks(index, asked.withColumn("floor", F.lit(0.9)))
    assert reached.count() < asked.count() * index.n_blocks / 3

    unit = np.array(points) / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    for where, wanted in ((None, lambda i: True), ("kind = 1", lambda i: i % 3 == 1), ("id >= 600", lambda i: i >= 600)):
        scores = {(r.question_id, i): float(unit[r.question_id] @ unit[i]) for r in asked.collect() for i in range(len(points)) if wanted(i)}
        assert_same(ranked(dense.search_index(index, asked, 4, where)), top(scores, 4))


def test_blocks_that_cannot_matter_are_not_scored(spark):
    """Texts of 20 topics in ranges, a third of all words is one word: each question meets few of the blocks."""
    random.seed(3)
    topics = [[f"t{t}_{n}" for n in range(12)] for t in range(20)]
    docs = {f"{t:02d}-{n:02d}": " ".join(random.choices(topics[t], k=12)) + " the" * 6 for t in range(20) for n in range(30)}
    questions = {f"q{t}": "the " + " ".join(topics[t][:3]) for t in range(20)}
    asked, corpus = frames(spark, questions, docs)
    index = lexical.build_index(corpus.withColumn("topic", F.substring("id", 1, 2)), per_block=300, facets=("topic",))
    assert index.n_blocks >= 16
    terms = lexical.materialise(lexical.question_terms(index, asked), "terms")
    directory = index.postings.where("term IS NOT NULL").select("term", "block", index.bound().alias("bound"))
    first, pairs = lexical._prune(index, terms, directory, 3, None)
    assert first.select("question_id").distinct().count() == len(questions)
    assert pairs.count() < len(questions) * index.n_blocks / 4  # "the" alone would make nearly all of them
    expected = top(bm25(questions, docs), 3)
    assert_same(ranked(lexical.search(index, asked, 3)), expected)
    assert_same(ranked(lexical.search(index, asked, 3, prune=False)), expected)


def test_tfidf_vectors_have_unit_length(spark, library):
    _, corpus = frames(spark, *library)
    lengths = lexical.term_vectors(lexical.build_index(corpus, "tfidf")).groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in lengths.collect())


@pytest.mark.parametrize("per_block", [1000, 64])
def test_vector_search_equals_brute_force(spark, per_block):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 16)).astype(np.float32)
    matrix[200:300] = matrix[0]  # a third are copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = vectors.filter("id < 40").withColumnRenamed("id", "question_id")
    unit = matrix.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    scores = {(q, i): float(unit[q] @ unit[i]) for q in range(40) for i in range(300)}
    found = ranked(dense.search(vectors, asked, 4, per_block))
    assert_same(found, top(scores, 4))
    assert [r[2] for r in found if r[0] == 0] == [0, 200, 201, 202]
    few = dense.search(vectors.filter("id < 2"), asked, 5, per_block)
    assert few.groupBy("question_id").count().filter("count <> 2").count() == 0
    filtered = dense.search(vectors.filter("id % 2 = 1"), asked, 3, per_block)
    odd = {key: s for key, s in scores.items() if key[1] % 2 == 1}
    assert_same(ranked(filtered), top(odd, 3))


def test_hits_get_text_or_default(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "gone", 0.4)], "question_id string, rank int, id string, score double")
    corpus = spark.createDataFrame([("a", "text", "policy"), ("b", "t", None)], "id string, text string, source_type string")
    rows = {r.id: (r.text, r.source_type) for r in dense.with_text(hits, corpus).collect()}
    assert rows == {"a": ("text", "policy"), "gone": ("", "unknown")}
    loaded = corpus.withColumn("payload", F.struct("id", F.lit(3).alias("price")))
    payloads = {r.id: r.payload for r in dense.with_text(hits, loaded).collect()}
    assert payloads == {"a": ("a", 3), "gone": None}


def test_fusion(spark):
    schema = "question_id string, rank int, id string"
    first = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("p", 1, "z")], schema)
    second = spark.createDataFrame([("q", 1, "c"), ("q", 2, "a")], schema)
    rows = fusion.reciprocal_rank_fusion(first, second, 3).collect()
    got = sorted((r.question_id, r["rank"], r.id, r.score) for r in rows)
    assert got == [
        ("p", 1, "z", round(1 / 61, 6)),
        ("q", 1, "a", round(1 / 61 + 1 / 62, 6)),
        ("q", 2, "c", round(1 / 61, 6)),
        ("q", 3, "b", round(1 / 62, 6)),
    ]


def test_vector_functions(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = frame.select(
        vector.unit(F.col("a")).alias("u"), vector.dot(F.col("a"), F.col("b")).alias("d"), vector.norm(F.col("a")).alias("n")
    ).collect()
    assert [(r.u, r.d, r.n) for r in rows] == [([0.6, 0.8], 24.0, 5.0), ([0.0, 0.0], 0.0, 0.0)]
    assert frame.limit(1).select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.96)


def test_short_passages_are_searched_in_blocks(spark, monkeypatch):
    """More passages than a block holds, repeated ids, a passage in all texts, and none at all."""
    from vitrine.plans import views

    monkeypatch.setattr(views, "SHORT_PASSAGES", 7)
    passages = [(f"g{n}", t) for n, t in enumerate(["e t", "the", "w1 w", "zz", "", ".", "a%b", "w12 w3"] * 5)] + [("g1", "w5")]
    texts = [(f"d{n}", f"the w{n} w{n % 4} a%b" + "." * (n % 2)) for n in range(30)] + [("none", None)]
    asked = spark.createDataFrame(passages, "question_id string, text string")
    docs = spark.createDataFrame(texts, "id string, text string")
    expected = sorted((q, i) for q, p in passages for i, t in texts if t is not None and p in t)
    assert sorted(map(tuple, views._containing(docs, asked).collect())) == expected
    assert views._containing(docs, asked.limit(0)).count() == 0


@pytest.mark.parametrize("scheme, brute", [("bm25", bm25), ("tfidf", tfidf)])
def test_grid_equals_brute_force(spark, library, scheme, brute, monkeypatch):
    """Groups of a few words meet groups of blocks, hits are dropped early; no pair of question and block is a row."""
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    index = lexical.build_index(corpus, scheme, per_block=150)
    monkeypatch.setattr(lexical, "JOINED", -1)
    monkeypatch.setattr(lexical, "WORDS_PER_GROUP", 40)
    monkeypatch.setattr(blocks, "_GATHERED", 0)

    def joined(*_):
        raise AssertionError("bounds were joined")

    monkeypatch.setattr(lexical, "_prune", joined)
    for k in (2, 70):
        assert_same(ranked(lexical.search(index, asked, k)), top(brute(questions, docs), k))


def test_grid_of_filtered_and_updated_texts(spark, library, monkeypatch):
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    monkeypatch.setattr(lexical, "JOINED", -1)
    index = lexical.build_index(corpus.withColumn("kind", F.substring("id", 1, 1)), per_block=200, facets=("kind",))
    scores = {(q, i): s for (q, i), s in bm25(questions, docs).items() if i[0] == "x"}
    assert_same(ranked(lexical.search(index, asked, 4, "kind = 'x'")), top(scores, 4))
    index = lexical.build_index(corpus, per_block=200)
    index = lexical.update_index(index, corpus.where("id = 'd001'").withColumn("text", F.lit("the w1")), corpus.where("id < 'd001'").select("id"))
    docs = {i: "the w1" if i == "d001" else t for i, t in docs.items() if not i < "d001"}
    assert_same(ranked(lexical.search(index, asked, 4)), top(bm25(questions, docs), 4))


def test_places_and_fusion_by_look_up(spark, library):
    """Ranks counted without writing the lists, copies by their ids; the fusion equals that of whole lists."""
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    indexes = [lexical.build_index(corpus, scheme, per_block=200) for scheme in ("bm25", "tfidf")]
    whole = [top(brute(questions, docs), 1000) for brute in (bm25, tfidf)]
    some = [(q, i) for q in questions for i in list(docs)[::7]]
    pairs = spark.createDataFrame(some, "question_id string, id string")
    for index, rows in zip(indexes, whole):
        expected = {(q, i): n for q, n, i, _ in rows}
        got = {(r.question_id, r.id): r["rank"] for r in lexical.places(index, asked, pairs).collect()}
        assert got == {p: expected[p] for p in some if p in expected}
    searches = [lambda a, n, i=i: lexical.search(i, a, n, prune=False) for i in indexes]
    places = [lambda a, p, i=i: lexical.places(i, a, p) for i in indexes]
    lists = [spark.createDataFrame([r[:3] for r in rows], "question_id string, rank int, id string") for rows in whole]
    for damping in (1, 60):
        got = ranked(fusion.fuse_looked_up(*searches, *places, asked, 3, damping))
        assert_same(got, ranked(fusion.reciprocal_rank_fusion(*lists, 3, damping)))


def test_vector_grid_equals_pairs(spark, monkeypatch):
    """More queries than a group holds; copies, filters, and vectors of no length."""
    draw = np.random.default_rng(4)
    points = [*draw.normal(size=(150, 8)), *[draw.normal(size=8)] * 60, np.zeros(8)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, embedding array<double>")
    asked = vectors.withColumnRenamed("id", "question_id")
    index = dense.build_index(vectors, per_block=20)
    for where in (None, "id % 2 = 1"):
        monkeypatch.setattr(dense, "PAIRS", 10**9)
        expected = ranked(dense.search_index(index, asked, 4, where))
        monkeypatch.setattr(dense, "PAIRS", -1)
        monkeypatch.setattr(dense, "GROUP_BYTES", 2000)
        assert_same(ranked(dense.search_index(index, asked, 4, where)), expected)


def test_fusion_by_look_up_of_repeated_ids(spark):
    """Copies of ids fill the first ranks of both lists; an id has its best rank, as in whole lists."""
    texts = [("a", "w x")] * 90 + [("b", "w y y z")] * 2 + [(f"c{n:02d}", "w " + "z " * n) for n in range(1, 20)]
    corpus = spark.createDataFrame(texts, "id string, text string")
    asked = spark.createDataFrame([("q1", "w x z"), ("q2", "y z"), ("q3", "none")], "question_id string, query string")
    indexes = [lexical.build_index(corpus, scheme, per_block=60) for scheme in ("bm25", "tfidf")]
    searches = [lambda a, n, i=i: lexical.search(i, a, n, prune=False) for i in indexes]
    places = [lambda a, p, i=i: lexical.places(i, a, p) for i in indexes]
    got = fusion.fuse_looked_up(*searches, *places, asked)
    assert_same(ranked(got), ranked(fusion.fuse_whole_lists(*searches, asked)))


def test_words_that_make_most_products_are_scored_as_rows():
    """A word in 12 of 60 texts that all questions ask becomes a dense row, a word nobody asks does not; scores stay."""
    draw = np.random.default_rng(5)
    held = {"all": range(0, 60, 5), "one": [3, 4], "none": range(10, 20)}
    rows = pa.Table.from_pylist(
        [{"kind": 0, "term": None, "ids": [f"d{n:02d}" for n in range(60)], "numbers": [], "weights": []}]
        + [{"kind": 3, "term": t, "ids": [], "numbers": list(n), "weights": draw.random(len(n)).tolist()} for t, n in held.items()],
        pa.schema([("kind", pa.int32()), ("term", pa.string()), ("ids", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))]),
    )
    asked = pa.table({"question_id": ["q0", "q1"], "terms": [["all", "one"], ["all", "unknown"]], "weights": [[2.0, 1.0], [3.0, 9.0]]})
    block, questions = lexical._Block(rows, None), lexical._Asked(asked, 3)
    of = {t: np.zeros(60) for t in held}
    for row in rows.to_pylist()[1:]:
        of[row["term"]][row["numbers"]] = row["weights"]
    scores = np.zeros((2, 60))
    for numbers, found in questions.scored(block, lambda part, bound: bound > 0):
        scores[numbers] = found
    assert np.allclose(scores, [2 * of["all"] + of["one"], 3 * of["all"]])
    dense = {t for t, row in zip(block.terms.to_pylist(), block.dense_row) if row >= 0}
    assert dense == {"all"}  # the rows have at most four times as many cells as there are postings


def test_cells_that_are_no_number_are_no_hits_under_a_floor():
    scores = np.array([[np.nan, 2.0, 1.0, np.nan], [np.nan, -np.inf, 5.0, 4.0]])
    row, column = blocks.top_cells(scores, 2, at_least=np.array([-np.inf, 4.5]))
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 2)]


def test_texts_move_once_into_an_index_with_facets(spark, library, monkeypatch):
    """The facets are counted beside the words, so that the texts meet neither the corpus nor a second shuffle."""
    questions, docs = library
    asked, corpus = frames(spark, questions, docs)
    corpus = corpus.withColumn("kind", F.substring("id", 1, 1))
    stored, store = [], lexical.materialise
    monkeypatch.setattr(lexical, "materialise", lambda df, name: (stored.append((name, df)), store(df, name))[1])
    index = lexical.build_index(corpus, per_block=200, facets=("kind",))
    moved = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for name, df in stored if name in ("placed-texts", "postings")]
    assert sum(moved) == 1
    assert_same(ranked(lexical.search(index, asked, 3, "kind = 'd'")), top({p: s for p, s in bm25(questions, docs).items() if p[1][0] == "d"}, 3))


def test_texts_of_no_id_are_counted_but_no_hits_with_facets(spark):
    corpus = spark.createDataFrame([("1", "a b", "x"), (None, "a c", "x"), ("2", "b", "y")], "id string, text string, kind string")
    index = lexical.build_index(corpus, facets=("kind",))
    asked = spark.createDataFrame([("q", "a c")], "question_id string, query string")
    assert index.n_docs == 3 and [r[2] for r in ranked(lexical.search(index, asked, 3))] == ["1"]


def test_index_has_a_row_a_block_of_texts_alike(spark, monkeypatch):
    """Blocks are rows of narrow numbers; texts of two languages lie in blocks of their own, and early blocks give floors."""
    random.seed(11)
    vocabulary = {"a": ["the", *[f"a{n}" for n in range(30)]], "b": ["und", *[f"b{n}" for n in range(30)]]}
    docs = {f"{n:03d}": " ".join([vocabulary["ab"[n % 2]][0]] * 5 + random.choices(vocabulary["ab"[n % 2]], k=12)) for n in range(200)}
    questions = {f"q{n}": " ".join(random.choices(vocabulary["ab"[n % 2]], k=4)) for n in range(10)}
    asked, corpus = frames(spark, questions, docs)
    index = lexical.build_index(corpus, per_block=100)
    rows = index.packed.select("block", "ids", F.split("words", "\n").alias("words")).collect()
    assert len({r.block for r in rows}) == len(rows) <= index.n_blocks
    assert sorted(i for r in rows for i in r.ids) == sorted(docs)
    assert sum({"the", "und"} <= set(r.words) for r in rows) <= 1
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", 2)
    for scheme, brute in (("bm25", bm25), ("tfidf", tfidf)):
        index = lexical.build_index(corpus, scheme, per_block=100)
        assert index.n_blocks >= 8
        assert_same(ranked(lexical.search(index, asked, 3, prune=False)), top(brute(questions, docs), 3))


@pytest.mark.parametrize("floor", [-np.inf, 0.1, 1.5])
def test_texts_that_reach_a_floor_have_exact_scores(floor):
    draw = np.random.default_rng(6)
    held = {f"w{t}": np.flatnonzero(draw.random(300) < f) for t, f in enumerate(np.linspace(0.01, 0.9, 25))}
    of = {t: np.zeros(300) for t in held}
    for t, n in held.items():
        of[t][n] = draw.random(len(n))
    rows = pa.Table.from_pylist(
        [{"kind": 0, "term": None, "ids": [f"d{n:03d}" for n in range(300)], "numbers": [], "weights": []}]
        + [{"kind": 3, "term": t, "ids": [], "numbers": n.tolist(), "weights": of[t][n].tolist()} for t, n in held.items()],
        pa.schema([("kind", pa.int32()), ("term", pa.string()), ("ids", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))]),
    )
    terms = [["w0", "w3", "w24", "unknown"], ["w1", "w2"], list(held)]
    weights = [draw.random(len(t)).tolist() for t in terms]
    asked = pa.table({"question_id": ["q0", "q1", "q2"], "terms": terms, "weights": weights, "floor": [floor] * 3})
    block, questions = lexical._Block(rows, None), lexical._Asked(asked, 3)
    questions.search(block)
    found = [tuple(r.values()) for part in questions.best.rows(questions.keys) for r in part.to_pylist()]
    exact = {(f"q{q}", f"d{n:03d}"): s for q in range(3) for n, s in enumerate(sum(w * of.get(t, np.zeros(300)) for t, w in zip(terms[q], weights[q])))}
    expected = [(q, i, s) for q, _, i, s in top({p: s for p, s in exact.items() if s > 0}, 3) if s >= floor - 2e-6]
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1.1e-6)

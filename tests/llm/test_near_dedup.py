import random

import numpy as np
from hypothesis import given, settings, strategies as st

from vitrine.llm import near_dedup as N
from vitrine.llm.components import components, merged
from vitrine.session import Scratch
from tests.llm.conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25), st.integers(0, 12))
def test_band(a, b, most):
    d = distance(a, b)
    assert N.edit_distance_within(np.array(a, np.int64), np.array(b, np.int64), most) == (d if d <= most else None)


def test_sketches_see_order():
    words = np.random.default_rng(1).integers(0, 1 << 62, 400).astype(np.uint64)
    swapped = np.concatenate((words[200:], words[:200]))
    same = (N.order_sketches(words) == N.order_sketches(words)).mean()
    assert same == 1 and (N.order_sketches(words) == N.order_sketches(swapped)).mean() < 0.8
    repeated = np.tile(words[:7], 5)
    assert len(set(N.labelled_shingles(repeated).tolist())) == len(repeated) - N.SHINGLE + 1


def test_sketches_in_stretches(monkeypatch):
    words = np.random.default_rng(2).integers(0, 1 << 62, 900).astype(np.uint64)
    whole = N.order_sketches(words)
    monkeypatch.setattr(N, "_COLUMNS", 64)
    assert (N.order_sketches(words) == whole).all()


def classes_of(docs, **options):
    rows = N.classes(docs, **options).collect()
    return {r.doc_id: r.class_id for r in rows}, len(rows)


def edited(text, seed, share=0.04):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[draw.randrange(len(words))] = f"z{draw.randrange(10**6)}"
    return " ".join(words)


def test_groups(spark):
    base = [prose(100 + i, 120) for i in range(6)]
    common = prose(999, 60)
    rows, truth = [], {}
    for g, text in enumerate(base):
        for copy in range(40 if g == 0 else 4):  # one group larger than a bucket that is paired whole
            rows.append((len(rows), edited(text, len(rows)) if copy else text))
            truth[len(rows) - 1] = g
    for i in range(60):  # a passage that many different texts share
        rows.append((len(rows), common + " " + prose(5000 + i, 60)))
        truth[len(rows) - 1] = 100 + i
    got, _ = classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    by_class = {}
    for i, c in got.items():
        by_class.setdefault(c, set()).add(truth[i])
    assert all(len(x) == 1 for x in by_class.values())
    assert len(by_class) == len(set(truth.values()))
    assert all(c == min(i for i, d in got.items() if d == c) for c in by_class)


def test_odd_rows(spark, odd_docs, odd_rows, clashing, no_docs):
    got, n = classes_of(odd_docs)
    assert n == len(odd_rows)
    assert got[1] == got[2] == got[11] == 1 and got[3] == got[4] == 3 and got[5] == 5 and got[7] == 7
    assert got[None] is None
    kept = N.without_near_copies(odd_docs).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 3, 5, 6, 7, 8, 9, 10]
    assert classes_of(clashing)[0] == got and classes_of(no_docs) == ({}, 0)
    again = spark.createDataFrame([(1, "same words here now ok"), (1, "same words here now ok")], "doc_id long, text string")
    assert N.without_near_copies(again).count() == 1


def test_bags_bound_edits():
    draw = np.random.default_rng(5)
    texts = [draw.integers(0, 40, draw.integers(1, 30)).astype(np.uint64) for _ in range(25)]
    bags = np.stack([np.frombuffer(N.bag_of(t), np.uint8) for t in texts])
    least = N.least_edits(bags, bags)
    assert all(least[i, j] <= distance(a.tolist(), b.tolist()) for i, a in enumerate(texts) for j, b in enumerate(texts))


def test_many_edited_copies_of_one_text(spark):
    original = prose(800, 150)
    rows = [(0, original)]
    for i in range(1, 1001):  # each 0.87 like the original, about 0.76 like another
        words, draw = original.split(), random.Random(i)
        for at in draw.sample(range(150), 20):
            words[at] = f"z{i}y{at}"
        rows.append((i, " ".join(words)))
    got, n = classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    # sketches are samples: a few copies may share no bucket with a text similar to them
    assert n == 1001 and list(got.values()).count(0) >= 900


def test_pairs_inside_a_template(spark):
    draw = random.Random(3)
    frame = [f"t{i}" for i in range(100)]
    rows = []
    for g in range(60):  # 60 pairs of near copies, all in one template of two thirds of the words
        words = [w for i, x in enumerate(frame) for w in ([x, f"g{g}w{i}"] if i % 2 else [x])]
        other = list(words)
        for at in draw.sample(range(150), 6):
            other[at] = f"e{g}x{at}"
        rows += [(2 * g, " ".join(frame[:40] + words)), (2 * g + 1, " ".join(frame[:40] + other))]
    got, _ = classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == {i: i - i % 2 for i in range(120)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=N.SHORT - 1), st.lists(st.integers(0, 9), min_size=1, max_size=N.SHORT - 1))
def test_short_texts_always_meet(a, b):
    if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
        keys = [set(N.rest_keys(N.mix(np.array(x, np.uint64) + np.uint64(1))).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_all_links_of_short_texts(spark):
    draw, rows = random.Random(11), []
    for g in range(150):  # as many edits as the similarity allows
        words = [f"w{g}x{i}" for i in range(draw.randrange(5, N.SHORT))]
        other = list(words)
        for at in draw.sample(range(len(words)), len(words) // 5):
            other[at] = f"e{g}x{at}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    got, _ = classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == {i: i - i % 2 for i in range(300)}


def test_blocks_hold_every_pair_of_classes(spark):
    draw = random.Random(12)
    rows = [("b", 90, i == 0, bytes([i]), 50, bytes([0 if i < 60 else i // 3])) for i in range(90)]
    left = spark.createDataFrame(rows, "bucket string, n long, leads boolean, node binary, n_words int, class binary")
    bags = spark.createDataFrame([(bytes([i]), bytes(N.BAG)) for i in range(90)], "node binary, bag binary")
    dealt = N.dealt_blocks(left, bags, size=draw.randrange(4, 9))
    got = N.block_pairs(dealt, 0.8).collect()
    want = {(a[3], b[3]) for a in rows for b in rows if a[3] < b[3] and a[5] != b[5]}
    assert {(bytes(r.a), bytes(r.b)) for r in got} == want and len(got) == len(want)
    group = {r[3]: r[5] for r in rows}
    one = [{group[bytes(r.a)], group[bytes(r.b)]} for r in N.block_pairs(dealt, 0.8, best=True).collect()]
    assert {frozenset(x) for x in one} == {frozenset((group[a], group[b])) for a, b in want} and len(one) == len(set(map(frozenset, one)))


def test_many_rows_without_an_id(spark):
    rows = [(None, prose(3000 + i, 40)) for i in range(800)] + [(None, prose(3000, 40))] * 300
    kept = N.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(kept) == 800 and {r.text for r in kept} == {t for _, t in rows}


def test_rows_with_null_or_repeated_ids_stay(spark):
    text = prose(700, 60)
    rows = [(1, text), (None, edited(text, 1, 0.02)), *[(None, prose(710 + i, 60)) for i in range(4)]]
    rows += [(8, prose(720, 60)), (8, prose(721, 60)), (8, edited(text, 2, 0.02)), (9, prose(722, 60)), (9, prose(722, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in N.without_near_copies(docs).collect())
    assert kept == sorted((str(i), t) for i, t in [rows[0], *rows[2:8], rows[9]])


def test_components_of_random_links(spark):
    draw = random.Random(4)
    for nodes, links in ((60, 45), (300, 280), (40, 300)):
        edges = [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(links)]
        want = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in range(nodes):
            for a, b in edges:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        frame = spark.createDataFrame(edges, "a long, b long")
        rows = components(frame).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
        half = spark.createDataFrame(edges[: links // 2], "a long, b long")
        rows = merged(components(half), spark.createDataFrame(edges[links // 2 :], "a long, b long"), Scratch(spark, "test")).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import collections
import hashlib
import random

import numpy as np
import pytest

from vitrine.llm import substring_dedup as D
from vitrine.llm.suffix_sort import SuffixSorter


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    draw = random.Random(3)
    noise = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [noise(draw.randint(30, 120)) for _ in range(5)]
    texts = []
    for _ in range(70):
        parts = [draw.choice([noise(draw.randint(0, 60)), draw.choice(passages), draw.choice(passages)[draw.randint(0, 20) :]]) for _ in range(draw.randint(0, 5))]
        texts.append("".join(parts))
    return [*texts, None, "", texts[3], texts[3], "a" * 300, "a" * 25, "ab" * 100, noise(50)]


@pytest.mark.parametrize("shard_rows", [256, 3])
def test_equals_brute_force(spark, shard_rows):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(D.deduplicate(docs, length=24, gram=8, shard_rows=shard_rows).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 24)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in rows)


def test_equal_pieces_of_a_hot_passage_go_on_as_one(spark, monkeypatch):
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passage = noise(90)
    texts = [noise(12) + passage + noise(12) for _ in range(60)]
    made, cut = [], D.cut

    def counted(*args):
        made.append(D.materialise(cut(*args), "counted"))
        return made[-1]

    monkeypatch.setattr(D, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(D.deduplicate(docs, length=24, gram=8, shard_rows=3).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 24)
    # only pieces at the passage's ends differ: its other starts are no rows of their own (1,243 rows with them)
    assert made and sum(m.count() for m in made) < 1000


def test_odd_rows(odd_docs, odd_rows, clashing, no_docs):
    expected = sorted(brute([r[1] for r in odd_rows], 200))
    for docs in (odd_docs, clashing):
        rows = D.deduplicate(docs).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == expected
    assert D.deduplicate(no_docs).count() == 0


def test_runs_in_stretches(monkeypatch):
    raw = np.frombuffer(("abcab" * 200 + "xyz" * 100).encode(), np.uint8)
    covered = lambda runs: sorted(s for a, n in zip(runs[0].tolist(), runs[1].tolist()) for s in range(a, a + n))
    whole = covered(D.runs_of(raw, 24, 8))
    monkeypatch.setattr(D, "STRETCH_BITS", 8)
    assert covered(D.runs_of(raw, 24, 8)) == whole == list(range(len(raw) - 23))


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_sorter(block):
    rows = np.random.default_rng(1).integers(97, 99, (700, 12)).astype(np.uint8)
    sorter = SuffixSorter(12, block=block, open_runs=3)
    for i in range(0, 700, 50):
        sorter.add(rows[i : i + 50], np.arange(i, i + 50))
    parts = [p for p in sorter.sorted() if len(p[1])]
    got = [(bytes(r), s) for p in parts for r, s in zip(p[0], p[2].tolist())]
    assert [g[0] for g in got] == sorted(bytes(r) for r in rows)
    assert sorted(t for p in parts for t in p[1].tolist()) == list(range(700))
    for (a, _), (b, shared) in zip(got, got[1:]):
        assert shared == next((i for i in range(12) if a[i] != b[i]), 12)

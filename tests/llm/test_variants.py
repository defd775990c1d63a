"""Spelling variants against comparing all words with each other."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from vitrine.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    """By the table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {a: [b for b in n if abs(len(a) - len(b)) < 2 and distance_one(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-n[b], b), default=None)
        if best and n[best] >= 2 * n[a]:
            form[a] = best

    def root(a):
        return root(form[a]) if a in form else a

    return sorted((a, form.get(a), root(a), n[a], len(near[a]), n[form[a]] if a in form else None) for a in n)


def found(docs):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs).collect()))


def words_of(draw, stems, n):
    """Words around a few stems, so that many are near each other; some stems are far more frequent."""
    out = []
    for _ in range(n):
        word = draw.choice(stems)
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            at = draw.randrange(len(word))
            word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("abeéñz") + word[at:], word[:at] + draw.choice("aceéß×") + word[at + 1 :]])
        out.append(word)
    return out


@pytest.mark.parametrize("piece", [5, 40_000])
def test_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(variants, "PIECE", piece)
    monkeypatch.setattr(variants.near_words, "__defaults__", (piece,))
    monkeypatch.setattr(variants, "ASKING", 11 if piece == 5 else 40_000)
    monkeypatch.setattr(variants, "BLOCK", 16 if piece == 5 else 1 << 16)
    monkeypatch.setattr(variants, "COUNTED", 20 if piece == 5 else 200_000)
    draw = random.Random(piece)
    stems = ["garden", "señora", "walking", "waking", "river", "aaaaaa", "über" * 3, "niño's", "Straße", "TITLE"]
    rows = [(i, " ".join(words_of(draw, stems, 120))) for i in range(40)]
    rows += [(None, "garden gardens gardén 漢 river"), (3, None), (4, ""), (5, "garden " * 3000), (5, "garden " * 3000)]
    rows += [(6, ("x" * 3000 + " ") * 4 + ("x" * 2999 + " ") * 9), (7, "abcde× abcd÷× 1abcde2")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_path(spark, monkeypatch):
    """A third of all words share one path of counts: pieces, and leaves looked up by strings with a hole."""
    monkeypatch.setattr(variants.near_words, "__defaults__", (50,))
    monkeypatch.setattr(variants, "COMPARED", 9)
    draw = random.Random(4)
    same = {"".join(draw.sample("stones", 6)) for _ in range(300)}
    other = {w[:at] + c + w[at + cut :] for w in sorted(same)[:60] for at, c, cut in [(draw.randrange(6), draw.choice("sxa"), draw.randrange(2))]}
    rows = [(None, " ".join(f"{w} {w} {w}" + f" {w}" * draw.randrange(9) for w in sorted(same | other)))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_edit():
    @settings(max_examples=300, deadline=None)
    @given(st.text("abé", max_size=6), st.text("abé", max_size=6))
    def same(a, b):
        assert variants.one_edit(a.encode("latin-1"), b.encode("latin-1")) == distance_one(a, b)

    same()


def test_odd_rows(spark, odd_docs, odd_rows, clashing, no_docs):
    expected = brute([r[:2] for r in odd_rows])
    assert found(odd_docs) == expected and found(clashing) == expected
    assert found(no_docs) == []
    near = variants.near_words(spark.createDataFrame([("garden", 3), ("gardens", 9)], "word string, n long")).collect()
    assert sorted((r.word, r.n_near, r.best, r.best_n) for r in near) == [("garden", 1, "gardens", 9), ("gardens", 1, "garden", 3)]


def test_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "w37")]
    roots = variants.follow(spark.createDataFrame(links, "word string, form string")).collect()
    assert len(roots) == len(links) and {r.root for r in roots} == {"w37"}

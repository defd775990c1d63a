import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import langid

SAMPLES = {
    "en": "the house and the river with the letters that were under this stone",
    "de": "das haus und der fluss mit den briefen die unter diesem stein nicht waren",
    "fr": "la maison et le fleuve avec les lettres qui étaient sous cette pierre",
    "es": "la casa y el río con las cartas que estaban debajo de esta piedra ñandú",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for lang, text in SAMPLES.items():
        words = text.split()
        for i in range(40):
            turn = words[i % len(words) :] + words[: i % len(words)]
            rows.append((len(rows), " ".join(turn[: 6 + i % 6]), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    held = F.col("doc_id") % 4 == 2
    model = langid.fit(labelled, ~held)
    assert set(model.families) == {"germanic", "romance"} and len(model.pairs) == 2
    found = langid.predict(labelled.drop("lang"), model).join(labelled.select("doc_id", "lang"), "doc_id").where(held)
    rows = found.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(labelled, odd_docs, clashing, no_docs):
    model = langid.fit(labelled, F.lit(True))
    rows = {r.doc_id: r for r in langid.predict(odd_docs, model).collect()}
    for i in (3, 4, 5, 6):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[9].lang_pred != "und" and rows[10].lang_pred in SAMPLES
    assert langid.predict(clashing, model).count() == clashing.count()
    assert langid.predict(no_docs, model).count() == 0
    assert langid.fit(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}


def test_sample_is_bounded_and_languages_alone_work(spark, labelled):
    assert langid.learning_rows(labelled, F.lit(True), per_language=10).count() < 80
    one = langid.fit(labelled.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(labelled, one).collect()} == {"en"}


def exact(x, sign, steps=400, c=langid.C):
    """One SVM on arrays in memory."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w = np.zeros(x.shape[1])
    ahead = w
    for step in range(steps):
        slope = ahead / c - 2 * x.T @ (weight * np.maximum(0, 1 - sign * (x @ ahead)) * sign)
        moved = ahead - slope / (1 / c + 2)
        ahead, w = moved + step / (step + 3) * (moved - w), moved
    return w


def test_all_rows_teach(spark, labelled):
    # more rows of a language than the former bound of 400; the last ones alone hold some words
    texts = [(i, f"{SAMPLES['en']} {i}" + " zqzq wkwk" * (i > 880), "en") for i in range(900)]
    texts += [(1000 + i, f"{SAMPLES['de']} {i}", "de") for i in range(30)] + [(2000 + i, SAMPLES["fr"], "fr") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5)
    assert langid.learning_rows(docs, F.lit(True)).count() == len(texts)
    model = langid.fit(docs, F.lit(True))
    held = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("held")).collect()
    held = {r.doc_id: r.held for r in held}
    taught = [t for t in texts if not held[t[0]]]
    x = np.stack([langid.features(np.frombuffer(t[1].encode(), np.uint8)) for t in taught])
    kin = np.array([1 if t[2] != "fr" else -1 for t in taught])
    pair = np.array([{"de": 1, "en": -1, "fr": 0}[t[2]] for t in taught])
    assert model.families == ["germanic", "romance"] and model.pairs == [(0, 1)]
    for column, side in ((0, kin), (2, pair)):
        w = exact(x[side != 0], side[side != 0])
        assert np.abs(model.weights[:, column] - w).max() < 0.01 * np.abs(w).max()


def test_long_text_is_read_whole(monkeypatch):
    text = np.frombuffer(("abc déf " * 500).encode(), np.uint8)
    whole = langid.features(text)
    monkeypatch.setattr(langid, "STRETCH", 64)
    assert np.allclose(whole, langid.features(text))

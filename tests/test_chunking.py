from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from vitrine.functions import text as TX
from vitrine.operators import corpus


def packed(pieces, size, overlap):
    """Greedy packing of pieces, written piece by piece."""
    chunks, run = [], []
    for piece in pieces:
        if run and sum(map(len, run)) + len(piece) > size:
            chunks.append("".join(run))
            while run and (sum(map(len, run)) > overlap or sum(map(len, run)) + len(piece) > size):
                run.pop(0)
        run.append(piece)
    chunks.append("".join(run))
    return chunks


def expected_chunks(text, size=512, overlap=64, separators=("\n\n", "\n", " ", "")):
    separator = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(separator) + 1 :]
    if separator:
        head, *others = text.split(separator)
        pieces = [p for p in [head, *(separator + o for o in others)] if p]
    else:
        pieces = list(text)
    chunks, run = [], []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            chunks += packed(run, size, overlap)
            run = []
        chunks += expected_chunks(piece, size, overlap, finer)
    if run:
        chunks += packed(run, size, overlap)
    return [c for c in (c.strip() for c in chunks) if c]


def recursive(spark, texts, size=512, overlap=64):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    pieces = TX.recursive_chunks(F.col("text"), size, overlap)
    return [r.c or [] for r in frame.select("n", pieces.alias("c")).orderBy("n").collect()]


WORDY = "The quick brown fox – jümps over the lazy dog. "


def test_known_shapes(spark):
    texts = [
        "",
        "short",
        "x" * 511,
        "x" * 512,
        "x" * 513,
        "x" * 1500,
        WORDY * 40,
        (WORDY * 3 + "\n") * 15,
        (WORDY * 6 + "\n\n") * 9,
        "head\n\n" + "y" * 700 + "\n\ntail " + WORDY * 30,
        "a\n\n\nb\n \n" * 150,
        " " * 600,
        "w " * 700 + "z" * 511 + " end",
        "\n".join("line %d" % i for i in range(300)),
    ]
    assert recursive(spark, texts) == [expected_chunks(t) if t else [] for t in texts]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.sampled_from(["a", "bb", "ccccc", "ß" * 9, "e" * 30, " ", "  ", "\n", "\n\n", "\n\n\n", " f", "\t"]), max_size=60).map("".join),
        min_size=30,
        max_size=40,
    )
)
def test_any_mixture_of_separators(spark, texts):
    assert recursive(spark, texts, 24, 7) == [expected_chunks(t, 24, 7) if t else [] for t in texts]


def test_fixed_windows_reassemble(spark):
    texts = ["", "ab", "x" * 512, "äöü" * 171, WORDY * 300]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    rows = corpus.document_chunks(frame, TX.fixed_chunks(F.col("text"))).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.payload.policy_id == str(i)), key=lambda r: r.payload.chunk_index)
        assert [r.id for r in own] == [f"{i}_chunk_{n}" for n in range(len(own))]
        assert all(len(r.text) <= 512 for r in own)
        assert "".join([own[0].text, *(r.text[64:] for r in own[1:])] if own else []) == text


def test_corpus_is_the_union_of_both_kinds(spark, shop):
    docs = spark.createDataFrame([("guide", WORDY * 30)], "id string, text string")
    rows = corpus.corpus(shop, docs).collect()
    assert sum(r.source_type == "product" for r in rows) == 8
    chunks = [r for r in rows if r.source_type == "policy"]
    assert [r.text for r in sorted(chunks, key=lambda r: r.payload.chunk_index)] == expected_chunks(WORDY * 30)
    assert all(r.payload.sku is None and r.payload.policy_id == "guide" for r in chunks)


def test_lookup_and_excerpt(spark):
    docs = spark.createDataFrame([("a", "x" * 400), ("b", "short")], "id string, text string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("it's",)], "id string")
    found = {r.id: r.text for r in corpus.lookup_documents(asked, docs).collect()}
    assert found == {"a": "x" * 400, "b": "short", "it's": "Policy 'it's' not found."}
    cut = {r.id: r.excerpt for r in corpus.excerpts(docs).collect()}
    assert cut == {"a": "x" * 300 + "...", "b": "short..."}

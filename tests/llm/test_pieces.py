"""Piece ids against the library's own, and the round trip."""

import hashlib
import os

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from vitrine.llm import pieces
from vitrine.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", "ing", " ", "  ", " " * 17, "▁", "▁▁", "\n", "\t", "\x00", "\xa0", "1", "23", "é", "ß", "漢", "字", "👍", "́", "tion", "ción", "er", "x" * 70, "<s>", "</s>", "<unk>", "<0x41>", "\r\n", "a.", "'s"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def encoder(model):
    return pieces.Encoder(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(encoder, text):
    return memoryview(encoder.packed(text)).cast("i").tolist()


def test_encodes_as_the_library(encoder, library):
    @settings(max_examples=500, deadline=None)
    @given(st.one_of(TEXT, st.text(st.characters(exclude_categories=["Cs"]), max_size=60)))
    def same(text):
        ids = ids_of(encoder, text)
        assert ids == library.encode(text)
        assert encoder.decoded(ids) == library.decode(ids)

    same()


def test_decodes_any_ids_as_the_library(encoder, library, model):
    few = [0, 1, 2, 3, 35, 68, 100, 197, 230, 258, 259, 300, 29871]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(few), st.integers(0, len(model.pieces) - 1)), max_size=12))
    def same(ids):
        assert encoder.decoded(ids) == library.decode(ids)

    same()


def test_control_ids_part_bytes(encoder, library):
    for ids in ([197, 1, 131], [197, 131], [1, 197, 2, 131, 131], [1], [], [29871, 1, 29871]):
        assert encoder.decoded(ids) == library.decode(ids)


def test_words_against_plain_merges(encoder):
    @settings(max_examples=300, deadline=None)
    @given(st.text("abcdeinrstou", min_size=1, max_size=30))
    def same(word):
        found = [encoder.text_of[t] for t in encoder.tokens(pieces.MARK + word)]
        assert found == encoder.merges.merge(pieces.MARK + word)

    same()


def test_long_stretches_and_memos(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 7)
    encoder = pieces.Encoder(model)
    for text in (" ".join(f"w{i} some words" for i in range(80)), "x" * 50_000, " " * 50_000, "ab▁" * 9000, "漢" * 3000):
        assert ids_of(encoder, text) == library.encode(text)


def test_small_models():
    """Pieces inside which a mark or an own character stands alone, and no byte pieces."""
    names = ["<unk>", "<s>", MARK := pieces.MARK, "a", "b", "ab", f"b{MARK}a", "qu", f"{MARK}a"]
    model = pieces.Model(names, [0, 0, -9, -9, -9, -1, -2, -3, -1.5], [2, 3, 1, 1, 1, 1, 1, 1, 1], " ⁇ ")
    encoder = pieces.Encoder(model)
    assert ids_of(encoder, "ab a") == [2, 5, 8]
    assert ids_of(encoder, "b a") == [2, 6]
    assert ids_of(encoder, "quqz") == [2, 7, 0, 0]
    assert ids_of(encoder, "") == [] and encoder.decoded([]) == ""


def test_rows(odd_docs, clashing, no_docs, model, library):
    for docs in (odd_docs, clashing):
        rows = pieces.decode(pieces.encode(docs, model), model).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    both = pieces.encode(odd_docs, model, decoded="back").collect()
    assert all(r.back == (r.text or "") for r in both)
    assert pieces.encode(no_docs, model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_piece_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digest)

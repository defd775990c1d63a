import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vitrine.llm import bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "23", "é", "ß", "漢", "́", "'s", "'", "!!", "…", "👍", "Σ", "İ", "J̌", "x" * 70, "<|endoftext|>", "\r\n", "a.", "\x00"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(words):
    return tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=words.ranks, special_tokens={})


def test_bpe_equals_merges(words, reference):
    encoder = bpe.Encoder(words)

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def same(text):
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == reference.encode_ordinary(text)

    same()


def test_bpe_pieces_against_plain_merges(words):
    encoder = bpe.Encoder(words)

    @settings(max_examples=300, deadline=None)
    @given(st.binary(min_size=1, max_size=40))
    def same(piece):
        plain = [words.ranks[p] for p in bpe._merge(piece, words.ranks, bpe._NEVER)]
        assert encoder.encode_piece(piece) == plain

    same()
    assert len(encoder.encode_piece(b"a" * 100_000)) < 100_000  # linear, not quadratic


def test_bpe_memo_is_no_limit(words, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    encoder = bpe.Encoder(words)
    text = " ".join(f"w{i} some words" for i in range(50))
    assert np.frombuffer(encoder.packed(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_round_trip(odd_docs, clashing, no_docs, words, reference):
    both = bpe.encode(odd_docs, words, decoded="back").collect()
    assert all(bytes(r.back).decode() == (r.text or "") for r in both)
    for docs in (odd_docs, clashing):
        rows = bpe.decode(bpe.encode(docs, words), words).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(r.text or "")
            assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(no_docs, words).count() == 0


def test_chunks_equal_whole_texts():
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    encoder = token_files.ChunkEncoder(open(WORDS).read(), True)

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def same(text):
        assert np.frombuffer(encoder.packed([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store(spark, odd_docs, odd_rows, tmp_path, encoding):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    path = f"{tmp_path}/store"
    token_files.write(token_files.tokenize(odd_docs, WORDS, 4), path, encoding=encoding, row_group_bytes=1 << 20)
    rows = token_files.with_start(token_files.checksums(token_files.read_tokens(spark, path)), spark.read.parquet(path)).collect()
    rows.sort(key=lambda r: r.start)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in rows] == [r[0] for r in ordered]
    start = 0
    for row, (_, text, *_) in zip(rows, ordered):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    few = token_files.read_tokens(spark, path, [7])
    assert few.count() == 1 and "doc_id" in few._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in token_files.read_metadata(spark, path).columns


def test_store_of_nothing(spark, no_docs, clashing, tmp_path):
    token_files.write(token_files.tokenize(no_docs, WORDS, 2), f"{tmp_path}/none")
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0
    token_files.write(token_files.tokenize(clashing, WORDS, 2), f"{tmp_path}/clash")
    assert token_files.read_metadata(spark, f"{tmp_path}/clash").count() == clashing.count()


def test_store_has_page_indexes(odd_docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = f"{tmp_path}/pages"
    token_files.write(token_files.tokenize(odd_docs, WORDS, 1), path)
    column = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata.row_group(0)
    tokens = [column.column(i) for i in range(column.num_columns) if column.column(i).path_in_schema.startswith("tokens")][0]
    assert tokens.has_offset_index and any("DICTIONARY" in e for e in tokens.encodings)


def test_latin_words_are_encoded_many_at_a_time(monkeypatch):
    with open(WORDS) as lines:
        encoder = token_files.ChunkEncoder(lines.read(), True)
    reference = Tokenizer.from_file(WORDS)
    text = " ".join(["Élan", "été.", "ÀÉÎ", "Cionado", "straße,", "ªº", "µm", "Ñandú", "ÿ", "Þorn", "naïf", "plain", "x×y", "Ÿes", "ét"])
    alone, whole = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda x: alone.append(x) or whole(x))
    assert np.frombuffer(encoder.packed([text])[0], "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert set(alone) <= {".", ",", "x×y", "ét"}  # not a call for each word

"""Token ids as Parquet list columns, for selective reads of tokens and of metadata.

A tokenizers file encodes every whole text; the end id closes each document.  Documents are
ordered by id: the files of a token store, taken by name, hold ascending id ranges, and
rows ascend within a file.  Ids are stored as a list column with dictionary pages (default)
or delta packing (format 2), in row groups and pages of chosen sizes.  The writer adds page
indexes, so a read of some documents skips the pages, and a read of metadata columns never
touches the token column.

Metadata per document: the file's number, the ids before it in that file, and its count.
The ids of earlier files are summed from one row per file at read time.

Null and empty texts have only the end id.  Rows with equal or null document ids are all
kept; nulls come first and rows of equal ids are ordered by text.  Extra input columns are
stored too; those with the store's own names are replaced.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import slices

END_ID = 2
#: Chunks, and as many words, in each of the two generations that a worker remembers.
MEMO = 250_000
FIELDS = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("start_in_part", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
    ]
)
# Python splits at these four, the tokenizer's white space does not hold them
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ENDING = string.punctuation


def _latin(word: str) -> bool:
    """Whether these are letters up to U+00FF: composed, with one lower-case letter each."""
    return max(word) < "\u0100" and word.isalpha()


class _Generations:
    """A memo of two generations: when the young one is full it becomes the old one, from which entries return on use."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, keys: set[str]) -> set[str]:
        """The keys of neither generation; all others are in the young one afterwards."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > MEMO:
            self.old, self.young = self.young, {}
            new = keys
        if self.old:
            back = [key for key in new if key in self.old]
            if back:
                self.young.update(zip(back, map(self.old.__getitem__, back)))
                new = new.difference(back)
        return set(new)


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks are encoded once while the memo holds them.

    The tokenizer drops white space and its pattern never matches across it, so the ids of
    a text are those of its chunks in order; ASCII letters are lower-cased before, as the tokenizer
    does.  ``split_chunks`` is for tokenizers of that
    kind only; others encode each text whole.
    """

    def __init__(self, content: str, split_chunks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        self.split_chunks = split_chunks
        self.memo, self.words = _Generations(), _Generations()
        # for lower-case ASCII and Latin-1 words, which normalising leaves alone; the latter are spelled in bytes
        self.letters = Tokenizer(self.tokenizer.model) if split_chunks else None
        self.latin = Tokenizer(self.tokenizer.model) if split_chunks else None
        if split_chunks:
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), in_bytes])
        suffix = json.loads(content)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.split_chunks:
            return [self._encode(x) for x in texts]
        plain = [not _ODD_SPACE.search(x) for x in texts]
        chunks = [(x.lower() if x.isascii() else x).split() if p else [] for x, p in zip(texts, plain)]
        new = self.memo.unknown(set().union(*chunks))
        if new:
            self._learn(new)
        of = self.memo.young.__getitem__
        return [b"".join(map(of, c)) if p else self._encode(x) for x, p, c in zip(texts, plain, chunks)]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """A chunk that ends in plain punctuation after a letter or digit is its word and its ending."""
        halves: dict[str, tuple[str, str]] = {}
        for chunk in chunks:
            word = chunk.rstrip(_ENDING)
            split = len(word) < len(chunk) and word[-1:].isalnum() and (word[-1].isascii() or _latin(word[-1]))
            halves[chunk] = (word, chunk[len(word) :]) if split else (chunk, "")
        new = self.words.unknown({x for pair in halves.values() for x in pair})
        known = self.words.young
        new.discard("")
        known[""] = b""
        # words of letters alone are one token run each, which ends where a token ends a word
        words = [x for x in new if x.isalpha()]
        self._encode_words([x for x in words if x.isascii() and x.islower()], self.letters, known)
        latin: dict[str, list[str]] = {}
        for word in filter(_latin, new.difference(known).intersection(words)):
            latin.setdefault(word.lower(), []).append(word)
        small: dict[str, bytes] = {}
        self._encode_words(list(latin), self.latin, small)
        known.update((word, ids) for low, ids in small.items() for word in latin[low])
        self._encode_words([x for x in words if not x.isascii() and x not in known], self.tokenizer, known)
        for word in new.difference(known):
            known[word] = self._encode(word)
        memo = self.memo.young
        for chunk, (word, ending) in halves.items():
            memo[chunk] = known[word] + known[ending]


    def _encode_words(self, words: list[str], tokenizer, known: dict[str, bytes]) -> None:
        """One call for many words; left to the caller if the ids can't be told apart."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):
                packed, first = ids.tobytes(), 0
                for word, end in zip(some, ends):
                    known[word] = packed[4 * first : 4 * end]
                    first = end


_encoders: dict[tuple[int, bool], ChunkEncoder] = {}


def _encoder(content: str, split_chunks: bool) -> ChunkEncoder:
    key = (hash(content), split_chunks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(content, split_chunks)
    return _encoders[key]


def tokenize(
    docs: DataFrame,
    tokenizer_path: str,
    parts: int,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    split_chunks: bool = True,
) -> DataFrame:
    """Rows in ascending key order over ``parts`` partitions, the text replaced by ``FIELDS``."""
    docs = docs.drop(*FIELDS.names)
    with open(tokenizer_path) as lines:
        content = docs.sparkSession.sparkContext.broadcast(lines.read())
    ordered = (
        docs.repartitionByRange(parts, F.col(key).asc_nulls_first())
        .sortWithinPartitions(F.col(key).asc_nulls_first(), text)
        .withColumn("part", F.spark_partition_id())
    )
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, *FIELDS.fields])
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, split_chunks)
        before = 0
        for batch in slices(batches):
            packed = [ids + closing for ids in encoder.packed([x or "" for x in batch.column(text).to_pylist()])]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            ends = np.cumsum(counts)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    batch.column("part").cast(pa.int32()),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    tokens,
                ],
                names=schema.names,
            )
            before += int(ends[-1])

    return ordered.mapInArrow(run, schema)


def write(
    tokens: DataFrame,
    path: str,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 128 << 10,
    page_rows: int = 2000,
) -> None:
    """One file per partition of ``tokens``, in the partitions' order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    delta = encoding == "delta"
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "v2" if delta else "v1")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the tokens, with ``start``: the number of ids of all documents before."""
    return with_start(spark.read.parquet(path).drop("tokens"), spark.read.parquet(path))


def read_tokens(spark: SparkSession, path: str, keys: list | None = None, key: str = "doc_id") -> DataFrame:
    """All rows, or those of some keys, whose row groups and pages alone are read."""
    rows = spark.read.parquet(path)
    return rows if keys is None else rows.where(F.col(key).isin(keys))


def with_start(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``start`` from the totals of the files, one row each."""
    totals = store.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (
        rows.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("start_in_part") + F.col("_before"))
        .drop("_before")
    )


def checksums(rows: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``: the CRC of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "tokens"], T.StructField("ids_crc32", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in schema.names[:-1]], pa.array(sums, pa.int64())], names=schema.names
            )

    return rows.mapInArrow(run, schema)

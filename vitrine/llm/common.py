"""Helpers shared by the operators: tables, Arrow batches, and hashing of words with NumPy.

Texts are hashed as arrays, never word by word: one pass of NumPy over the UTF-8 bytes of
a text yields the hashes of all of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MASK = (1 << 64) - 1
#: A text is hashed in stretches of about so many bytes, cut between words.
STRETCH = 1 << 21


#: Rows of an Arrow batch between the JVM and a worker; whole texts are large.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows, which bounds the memory of a worker and its task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that keep a worker's Python objects few; empty batches are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row as an array that shares the batch's memory; a null is empty."""
    if column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = column.cast(pa.string())
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if data is None:
        for _ in range(n):
            yield np.empty(0, np.uint8)
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].tolist()
    everything = np.frombuffer(data, np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(n):
        yield everything[ends[i] : ends[i + 1]] if valid is None or valid[i] else everything[:0]


#: Summands are rounded to multiples of this before they are added, so that a sum does not depend on their order.
_UNIT = 2.0**-36
#: Tasks that add up what the other tasks have added.
_ADDERS = 8


def fixed(values: np.ndarray) -> np.ndarray:
    """Numbers under 2 ** 26 as integers, for exact sums."""
    return np.rint(values / _UNIT).astype(np.int64)


def added(sums: DataFrame) -> np.ndarray | None:
    """The sum of the arrays ``fixed`` of a column of bytes, a row of each task; a few partial sums reach the driver."""
    name = sums.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(name):
                one = np.frombuffer(row.as_py(), np.int64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[name])

    rows = sums.repartition(F.spark_partition_id() % _ADDERS).mapInArrow(run, sums.schema).collect()
    return sum(np.frombuffer(r[0], np.int64) for r in rows) * _UNIT if rows else None


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def _word_table() -> np.ndarray:
    """Byte -> lower-case byte of a word, or 0 between words: digits, ASCII letters, all bytes above 0x7F."""
    kind = np.zeros(256, np.uint8)
    for low, high, shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 0x20), (0x80, 0xFF, 0)):
        kind[low : high + 1] = np.arange(low, high + 1) + shift
    return kind


WORD_BYTE = _word_table()


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and 64-bit hash of every word of a text; words differ only by A-Z case if hashes agree."""
    if len(text) <= STRETCH:
        return _stretch_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        if end < len(text):  # go on to the end of the word
            rest = WORD_BYTE[text[end - 1 : end - 1 + STRETCH]] == 0
            while not rest.any() and end + STRETCH < len(text):
                end += STRETCH
                rest = WORD_BYTE[text[end - 1 : end - 1 + STRETCH]] == 0
            end = end - 1 + int(rest.argmax()) if rest.any() else len(text)
            end = max(end, at + 1)
        s, e, h = _stretch_hashes(text[at:end])
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def _stretch_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    lower = WORD_BYTE[text]
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = lower != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[lower] * powers(_BASE, n), out=total[1:])
        return start, end, mix((total[end] - total[start]) * powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))


_STEP = np.uint64(0xD1342543DE82EF95)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by their words' hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:count].copy()
        for i in range(1, n):
            total *= _STEP
            total += words[i : i + count]
    return mix(total)

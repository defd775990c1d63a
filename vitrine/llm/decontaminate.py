"""Benchmark decontamination: windows of benchmark words, looked up in every text.

The windows of all benchmark items form a hash set.  While their measured size stays under
``max_broadcast_bytes`` the set goes to every task and one pass over the texts finds the
hits; a larger set is joined to the windows of the texts by a shuffle instead, with the
same result.  A hit counts only if the words agree, not just their hash.

Words are runs of digits, letters a-z (A-Z is lower-cased first) and non-ASCII characters.
A null or empty text has no words, no hits and no items; an item without words has no
window; an item shorter than the window is one window of its own length.  Rows that
repeat get the same result each; the input's columns are kept, and one named as a result
is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import WORD_BYTE, gram_hashes, utf8_rows, word_hashes

WIDTH = 10
MAX_BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Copies of each window in a join, over which its places in texts are dealt.
SALTS = 8
#: Bytes of a window's objects in a task, beside its characters.
OBJECTS = 600

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
            False,
        ),
    ]
)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id") -> DataFrame:
    """(window, n, item): the distinct windows of each item, words joined by a space."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    n = F.least(F.lit(width), F.size("words"))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    return (
        benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", "words", n.alias("n"), starts.alias("at"))
        .select(F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("window"), "n", "item")
        .distinct()
    )


class WindowSet:
    """The windows by hash: a bit table turns most words away, the words themselves decide."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.known: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
        hashes: dict[int, set[int]] = defaultdict(set)
        for window, n, item in rows:
            raw = window.encode()
            value = int(gram_hashes(word_hashes(np.frombuffer(raw, np.uint8))[2], n)[0])
            hashes[n].add(value)
            self.known[value][raw].append(item)
        self.known = {k: dict(v) for k, v in self.known.items()}
        self.hashes = {n: np.array(sorted(v), np.uint64) for n, v in hashes.items()}

    def tables(self) -> dict[int, np.ndarray]:
        out = {}
        for n, values in self.hashes.items():
            out[n] = np.zeros(1 << self.BITS, bool)
            out[n][values >> np.uint64(64 - self.BITS)] = True
        return out


def _words_of(text: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(WORD_BYTE[text[start[i] : end[i]]].tobytes() for i in range(at, at + n))


def _covered(n_words: int, places: list[tuple[int, int]]) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int32)
    for at, n in places:
        steps[at] += 1
        steps[at + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def _spans(covered: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of covered words, from the first word's start to the last one's end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return [(int(start[a]), int(end[b - 1])) for a, b in zip(edges[::2], edges[1::2])]


def _result(n_words, start, end, places, items) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    if not places:
        return n_words, 0, [], []
    covered = _covered(n_words, places)
    return n_words, int(covered.sum()), sorted(items), _spans(covered, start, end)


def _scan(text: np.ndarray, known: WindowSet, tables: dict[int, np.ndarray]):
    start, end, words = word_hashes(text)
    places, items = [], set()
    for n, table in tables.items():
        grams = gram_hashes(words, n)
        near = np.flatnonzero(table[grams >> np.uint64(64 - known.BITS)])
        for at in near[np.isin(grams[near], known.hashes[n])].tolist() if len(near) else ():
            found = known.known[int(grams[at])].get(_words_of(text, start, end, at, n))
            if found:
                places.append((at, n))
                items.update(found)
    return _result(len(start), start, end, places, items)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    spans = [[{"start": a, "end": b} for a, b in r[3]] for r in rows]
    return [
        pa.array([r[0] for r in rows], kinds[0]),
        pa.array([r[1] for r in rows], kinds[1]),
        pa.array([r[2] for r in rows], kinds[2]),
        pa.array(spans, kinds[3]),
    ]


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    text: str = "text",
    item: str = "item_id",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Every input row with ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``spans`` (bytes, end exclusive)."""
    docs = docs.drop(*RESULT.names, "_text", "_key", "_places", "_items")
    windows = benchmark_windows(benchmark, width, text=text if text in benchmark.columns else "text", item=item)
    size = windows.select(F.sum(F.octet_length("window") + F.octet_length("item") + OBJECTS)).head()[0] or 0
    if size <= max_broadcast_bytes:
        return _by_broadcast(docs, windows, text)
    return _by_shuffle(docs, windows, text)


def _by_broadcast(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in windows.collect()]))
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = known.value
        tables = sets.tables()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [_scan(t, sets, tables) for t in utf8_rows(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *_columns(rows)], names=[*batch.schema.names, *RESULT.names]
            )

    return docs.mapInArrow(run, schema)


def _by_shuffle(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The same by joins; texts are told apart by their digest, so copies are looked up once.

    A first join finds the places whose hash is one of a window.  Their words are then read from
    the texts and joined to the windows themselves, so a hash alone never decides.  In both joins
    places are dealt over ``SALTS`` copies of the windows, as many texts may hold the same one.
    """
    keyed = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_key", F.sha2("_text", 256))
    distinct = keyed.groupBy("_key").agg(F.first("_text").alias("_text"))
    sizes = [r[0] for r in windows.select("n").distinct().collect()]  # at most `width` numbers
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = F.pmod(F.xxhash64("_key", "at"), F.lit(SALTS)).cast("int").alias("salt")

    def of_windows(batches):
        for batch in batches:
            sizes_here = batch.column("n").to_pylist()
            out = [int(gram_hashes(word_hashes(raw)[2], n).view(np.int64)[0]) for raw, n in zip(utf8_rows(batch.column("window")), sizes_here)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(out, pa.int64())], names=["n", "hash"])

    def of_texts(batches):
        for batch in batches:
            for key, raw in zip(batch.column("_key"), utf8_rows(batch.column("_text"))):
                words = word_hashes(raw)[2]
                for n in sizes:
                    one = gram_hashes(words, n).view(np.int64)
                    if len(one):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([key.as_py()] * len(one), pa.string()),
                                pa.array(np.arange(len(one)), pa.int32()),
                                pa.array(np.full(len(one), n), pa.int32()),
                                pa.array(one),
                            ],
                            names=["_key", "at", "n", "hash"],
                        )

    def words_at(batches):
        for batch in batches:
            for key, raw, places in zip(batch.column("_key"), utf8_rows(batch.column("_text")), batch.column("near").to_pylist()):
                start, end, _ = word_hashes(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * len(places), pa.string()),
                        pa.array([p["at"] for p in places], pa.int32()),
                        pa.array([p["n"] for p in places], pa.int32()),
                        pa.array([_words_of(raw, start, end, p["at"], p["n"]).decode() for p in places], pa.string()),
                    ],
                    names=["_key", "at", "n", "window"],
                )

    hashes = windows.select("window", "n").distinct().mapInArrow(of_windows, "n int, hash long").distinct().select("n", "hash", copies)
    grams = distinct.mapInArrow(of_texts, "_key string, at int, n int, hash long").select("_key", "at", "n", "hash", dealt)
    near = grams.join(hashes, ["n", "hash", "salt"], "left_semi").groupBy("_key").agg(F.collect_list(F.struct("at", "n")).alias("near"))
    places = near.join(distinct, "_key").mapInArrow(words_at, "_key string, at int, n int, window string").select("*", dealt)
    hits = places.join(windows.select("window", "n", "item", copies), ["window", "n", "salt"])
    found = hits.groupBy("_key").agg(
        F.collect_set(F.struct("at", "n")).alias("_places"), F.sort_array(F.collect_set("item")).alias("_items")
    )
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    kept_names = docs.columns
    joined = keyed.join(found, "_key", "left").select(*kept_names, "_places", "_items")

    def finish(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for raw, places, items in zip(
                utf8_rows(batch.column(text)), batch.column("_places").to_pylist(), batch.column("_items").to_pylist()
            ):
                start, end, _ = word_hashes(raw)
                rows.append(_result(len(start), start, end, [(p["at"], p["n"]) for p in places or ()], items or ()))
            kept = [batch.column(c) for c in kept_names]
            yield pa.RecordBatch.from_arrays([*kept, *_columns(rows)], names=[*kept_names, *RESULT.names])

    return joined.mapInArrow(finish, schema)


def without_documents(hits: DataFrame) -> DataFrame:
    """The documents without any hit."""
    return hits.where(F.col("n_hit") == 0).drop(*RESULT.names)


def without_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    kept = hits.drop(*RESULT.names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for value, raw, spans in zip(
                batch.column(text).is_valid().to_pylist(), utf8_rows(batch.column(text)), batch.column("spans").to_pylist()
            ):
                at, parts = 0, []
                for span in spans:
                    parts.append(raw[at : span["start"]].tobytes())
                    at = span["end"]
                cut.append((b"".join(parts) + raw[at:].tobytes()).decode() if value else None)
            columns = [pa.array(cut, pa.string()) if f.name == text else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept.names)

    return hits.mapInArrow(run, kept)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

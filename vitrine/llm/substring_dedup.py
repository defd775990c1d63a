"""Removal of every byte covered by a long string that also starts elsewhere.

Texts are UTF-8 bytes, the length is ``LENGTH``.  The work goes down a recursion of named
substrings, as in induced suffix sorting, where only names that repeat go on:

1. Every start belongs to the run of starts whose windows share their least k-gram (the
   anchor).  Equal windows have equal anchors at equal offsets, so a run whose anchor occurs
   once has no repeated window and drops out; runs with equal names repeat as a whole.
2. Runs that share an anchor but differ go, one copy of each, to the shard of their anchor,
   where a disk-backed sorter orders their suffixes and carries common-prefix values; a start
   repeats if it shares ``LENGTH`` bytes with a neighbour.
3. The runs of an anchor with more than ``SHARD_ROWS`` different ones are cut into pieces of
   fewer starts first, and named by the core that all windows of a piece share, so that a
   passage common to many documents is spread over many shards; equal pieces repeat as a whole
   and go on as one; pieces of one start are named by the window itself and only counted.

Names are 64-bit hashes together with the anchor's 64 bits.  Texts are known by 96 bits of
hashes, so that copies share one list of places.  Counts are partial per task, joins can be
split by Spark, and no group is gathered beyond one text's places or ``SHARD_ROWS`` runs.

Null and empty texts keep nothing and lose nothing.  Repeated rows are documents of their
own: all their windows repeat.  The input's other columns are kept; those named as a result
or a helper column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import mix, powers, slices, utf8_rows
from vitrine.llm.suffix_sort import SuffixSorter
from vitrine.session import materialise

LENGTH = 200
GRAM = 64
SHARD_ROWS = 256
PIECES = (16, 4, 1)
STRETCH_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_OWN = ("k1", "k2", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "_places", "_done", "_text", "_segments", "_more")
PLACE = "struct<at:int,n:int,repeated:boolean,send:boolean,anchor:bigint>"
SEGMENT = "struct<shard:bigint,at:int,n:int,open:boolean,text:binary>"


class Rolling:
    """Hashes of any substrings of a text from one pass."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.total = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(_BASE, self.n), out=self.total[1:])

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        with np.errstate(over="ignore"):
            return mix((self.total[size:] - self.total[:-size]) * powers(_INVERSE, self.n - size + 1))

    def __call__(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            length = np.asarray(end - start).astype(np.uint64)
            return mix((self.total[end] - self.total[start]) * powers(_INVERSE, self.n + 1)[start] + length)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    out, width = keys, 1
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs_of(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor, name) of the runs of a text; stretches keep memory bounded."""
    starts = len(text) - length + 1
    if starts <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    window = length - gram + 1
    low = np.uint64((1 << STRETCH_BITS) - 1)
    step = (1 << STRETCH_BITS) - length
    parts = []
    for first in range(0, starts, step):
        count = min(step, starts - first)
        piece = text[first : first + count + length - 1]
        rolling = Rolling(piece)
        hashes = rolling.grams(gram)
        i = np.arange(len(hashes))
        # the first of equal grams: the least place breaks ties
        chosen = (_least((hashes & ~low) | i.astype(np.uint64), window) & low).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        n = np.diff(np.append(begin, len(chosen)))
        parts.append((begin + first, n, hashes[chosen[begin]], rolling(begin, begin + n + length - 1)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """Documents with two hashes that stand for their text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(whole)).withColumn("k2", F.hash(whole, F.lit("second")))


def runs(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(k1, k2, at, n, anchor, name) of all runs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [runs_of(raw, length, gram) for raw in utf8_rows(batch.column(text))]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            flat = [np.concatenate(x) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(take),
                    batch.column("k2").take(take),
                    pa.array(flat[0].astype(np.int32)),
                    pa.array(flat[1].astype(np.int32)),
                    pa.array(flat[2].view(np.int64)),
                    pa.array(flat[3].view(np.int64)),
                ],
                names=["k1", "k2", "at", "n", "anchor", "name"],
            )

    return docs.select("k1", "k2", text).mapInArrow(run, "k1 long, k2 int, at int, n int, anchor long, name long")


def places(found: DataFrame) -> DataFrame:
    """(k1, k2, _places): the runs of each text whose anchor occurs again."""
    counts = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    again = counts.where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    hits = materialise(found.join(again, "anchor"), "hits")
    place_hash = F.xxhash64("k1", "k2", "at")  # one place of a name sends its text; two with equal hashes do no harm
    names = (
        hits.where("mixed")
        .groupBy("anchor", "name")
        .agg(F.count("*").alias("c"), F.min(place_hash).alias("first"))
    )
    differing = hits.where("mixed").join(names, ["anchor", "name"]).select(
        "k1", "k2", "at", "n", (F.col("c") > 1).alias("repeated"), (F.col("first") == place_hash).alias("send"), "anchor"
    )
    alike = hits.where("not mixed").select(
        "k1", "k2", "at", "n", F.lit(True).alias("repeated"), F.lit(False).alias("send"), "anchor"
    )
    place = F.struct("at", "n", "repeated", "send", F.when(F.col("send"), F.col("anchor")).alias("anchor"))
    return differing.union(alike).groupBy("k1", "k2").agg(F.collect_set(place).alias("_places"))


def _covered(n_bytes: int, starts: list[tuple[int, int]], length: int) -> np.ndarray:
    """Whether each byte lies in a window of one of the starts, given as (first, number)."""
    steps = np.zeros(n_bytes + 1, np.int32)
    if starts:
        first, n = np.array(starts, np.int64).T
        np.add.at(steps, first, 1)
        np.add.at(steps, first + n + length - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _outcome(raw: np.ndarray, starts: list[tuple[int, int]], length: int) -> dict:
    covered = _covered(len(raw), starts, length)
    kept = raw[~covered].tobytes()
    spans = int(np.count_nonzero(np.diff(np.concatenate(([0], covered.astype(np.int8)))) == 1)) if len(raw) else 0
    return {"n_removed": int(covered.sum()), "n_spans": spans, "kept": kept}


_DONE = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
)
_DONE_ARROW = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _done(outcome: dict, with_text: bool) -> dict:
    return {
        "n_removed": outcome["n_removed"],
        "n_spans": outcome["n_spans"],
        "kept_sha256": hashlib.sha256(outcome["kept"]).hexdigest(),
        "kept": outcome["kept"] if with_text else None,
    }


def first_pass(rows: DataFrame, text: str, kept: list[T.StructField], length: int, with_text: bool) -> DataFrame:
    """Results of texts without open runs; text, places and the shards' segments of the others."""
    schema = T.StructType(
        [
            *kept,
            T.StructField("k1", T.LongType()),
            T.StructField("k2", T.IntegerType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("_done", _DONE),
            T.StructField("_text", T.BinaryType()),
            T.StructField("_places", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))),
            T.StructField("_segments", T.ArrayType(T._parse_datatype_string(SEGMENT))),
        ]
    )
    segment = pa.struct([("shard", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("open", pa.bool_()), ("text", pa.binary())])
    pair = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            done, texts, starts, segments, sizes = [], [], [], [], []
            for raw, listed in zip(utf8_rows(batch.column(text)), batch.column("_places").to_pylist()):
                sizes.append(len(raw))
                listed = listed or []
                again = [(p["at"], p["n"]) for p in listed if p["repeated"]]
                sent = [p for p in listed if p["send"]]
                if all(p["repeated"] for p in listed):
                    done.append(_done(_outcome(raw, again, length), with_text))
                    texts.append(None)
                    starts.append(None)
                else:
                    done.append(None)
                    texts.append(raw.tobytes())
                    starts.append([{"at": a, "n": n} for a, n in again])
                segments.append(
                    [
                        {
                            "shard": p["anchor"],
                            "at": p["at"],
                            "n": p["n"],
                            "open": not p["repeated"],
                            "text": raw[p["at"] : p["at"] + p["n"] + length - 1].tobytes(),
                        }
                        for p in sent
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array(sizes, pa.int64()),
                    pa.array(done, _DONE_ARROW),
                    pa.array(texts, pa.binary()),
                    pa.array(starts, pair),
                    pa.array(segments, pa.list_(segment)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


_SEGMENTS = "k1 long, k2 int, shard long, at int, n int, open boolean, text binary, whole long"


def cut(segments: DataFrame, starts: int, length: int, gram: int) -> DataFrame:
    """Segments cut into pieces of at most ``starts`` starts, named by the core that the windows of a piece share.

    Pieces lie alike in all texts that share the anchor: their borders are counted from it.  ``whole`` hashes all of a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            take, columns = [], [[], [], [], [], []]
            for i, (at, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "n", "text")))):
                rolling = Rolling(np.frombuffer(raw, np.uint8))
                grams = rolling.grams(gram)[: length - gram + 1]
                low = np.uint64((1 << STRETCH_BITS) - 1)
                anchor = int(np.argmin(grams & ~low))  # the least gram of the first window is that of all
                block = (anchor - np.arange(n)) // starts
                first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
                begin = anchor - block[first] * starts
                end = begin - starts + 1 + length
                with np.errstate(over="ignore"):
                    core = mix(rolling(begin, end) + block[first].astype(np.uint64) * np.uint64(_BASE))
                number = np.diff(np.append(first, n))
                whole = rolling(first, first + number + length - 1)
                take += [i] * len(first)
                columns[0] += core.view(np.int64).tolist()
                columns[1] += (at + first).tolist()
                columns[2] += number.tolist()
                columns[3] += [raw[f : f + k + length - 1] if starts > 1 else b"" for f, k in zip(first.tolist(), number.tolist())]
                columns[4] += whole.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(take, pa.int64())),
                    batch.column("k2").take(pa.array(take, pa.int64())),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int32()),
                    batch.column("open").take(pa.array(take, pa.int64())),
                    pa.array(columns[3], pa.binary()),
                    pa.array(columns[4], pa.int64()),
                ],
                names=["k1", "k2", "shard", "at", "n", "open", "text", "whole"],
            )

    return segments.mapInArrow(run, _SEGMENTS)


def unlike(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pieces, the open starts (k1, k2, at, n) of those that occur again as a whole; and the segments left, one of equal ones.

    What occurs again is not open any more: its copy goes on only for others that share a part of it.
    """
    place = F.xxhash64("k1", "k2", "at")
    names = pieces.groupBy("shard", "whole", "n").agg(F.count("*").alias("c"), F.min(place).alias("least"))
    again = names.where("c > 1")
    known = materialise(pieces.join(again, ["shard", "whole", "n"], "left"), "pieces")
    repeated = known.where("c is not null and open").select("k1", "k2", "at", "n")
    left = known.where(F.col("c").isNull() | (place == F.col("least")))
    return repeated, left.select("k1", "k2", "shard", "at", "n", (F.col("open") & F.col("c").isNull()).alias("open"), "text")


def repeated_starts(shard: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(k1, k2, at, n) of the open starts of one shard that share ``length`` bytes with a neighbour in suffix order."""
    sorter = SuffixSorter(length)
    for i, (_, _, _, n, _, raw) in enumerate(shard):
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
        sorter.add(windows[:n], np.arange(n, dtype=np.int64) | (i << 16))
    again, last = [], None
    for _, tags, shared in sorter.sorted():
        if not len(tags):
            continue
        same = shared >= length
        if last is not None and same[0]:
            again.append([last])
        again.append(tags[same])
        again.append(tags[:-1][same[1:]])
        last = int(tags[-1])
    tags = np.unique(np.concatenate(again)) if again else np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(tags) != 1)))  # runs of starts; segments end at gaps too
    rows = []
    for tag, n in zip(tags[first].tolist(), np.diff(np.append(first, len(tags))).tolist()) if len(tags) else ():
        k1, k2, at, _, open_, _ = shard[tag >> 16]
        if open_:
            rows.append((k1, k2, at + (tag & 0xFFFF), n))
    return rows


def sort_shards(segments: DataFrame, length: int) -> DataFrame:
    """The repeated starts of all shards, one shard after the other; a shard beyond a block of tuples goes to disk."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, rows = None, [], []
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("shard", "k1", "k2", "at", "n", "open", "text"))
            for name, *segment in zip(*columns):
                if name != current and shard:
                    rows += repeated_starts(shard, length)
                    shard = []
                current = name
                shard.append(tuple(segment))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["k1", "k2", "at", "n"]
                )
                rows = []
        if shard:
            rows = repeated_starts(shard, length)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["k1", "k2", "at", "n"]
            )

    return segments.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "k1 long, k2 int, at int, n int")


def resolve(segments: DataFrame, length: int, gram: int, shard_rows: int) -> DataFrame:
    """(k1, k2, at, n): the starts of open segments whose windows occur elsewhere."""
    found = None
    for starts in PIECES:
        sizes = segments.groupBy("shard").agg(F.count("*").alias("c"), F.max("open").alias("any")).where("c > 1 and any")
        sized = materialise(segments.join(sizes.select("shard", "c"), "shard"), "segments")
        part = sort_shards(sized.where(F.col("c") <= shard_rows).drop("c"), length)
        found = part if found is None else found.union(part)
        large = sized.where(F.col("c") > shard_rows).drop("c")
        if not large.limit(1).count():
            return found
        # the last pieces are single windows: those not alone repeat as a whole, and nothing is left to sort
        repeated, segments = unlike(materialise(cut(large, starts, length, gram), "cut"))
        found = found.union(repeated)
    return found


def last_pass(rows: DataFrame, kept: list[T.StructField], length: int, with_text: bool) -> DataFrame:
    """Results of the texts that had open runs."""
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("_done", _DONE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            done = []
            for raw, first, more in zip(*(batch.column(c).to_pylist() for c in ("_text", "_places", "_more"))):
                starts = [(p["at"], p["n"]) for p in (first or []) + (more or [])]
                done.append(_done(_outcome(np.frombuffer(raw, np.uint8), starts, length), with_text))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], batch.column("n_bytes"), pa.array(done, _DONE_ARROW)], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def deduplicate(
    docs: DataFrame,
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    shard_rows: int = SHARD_ROWS,
    with_text: bool = True,
) -> DataFrame:
    """Every row without its text, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes)."""
    docs = docs.drop(*[c for c in _OWN if c != text])
    kept = [f for f in docs.schema.fields if f.name != text]
    rows = keyed(docs, text)
    listed = places(runs(rows, text, length, gram))
    first = materialise(first_pass(rows.join(listed, ["k1", "k2"], "left"), text, kept, length, with_text), "first-pass")
    segments = first.select("k1", "k2", F.explode("_segments").alias("s")).select("k1", "k2", "s.*")
    # copies of a text send the same segments
    single = segments.groupBy("k1", "k2", "shard", "at").agg(
        F.first("n").alias("n"), F.first("open").alias("open"), F.first("text").alias("text")
    )
    found = resolve(single, length, gram, shard_rows)
    more = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("_more"))
    waiting = first.where(F.col("_done").isNull()).join(more, ["k1", "k2"], "left")
    both = (
        first.where(F.col("_done").isNotNull())
        .select(*[f.name for f in kept], "n_bytes", "_done")
        .union(last_pass(waiting, kept, length, with_text))
    )
    names = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    return both.select(*[f.name for f in kept], "n_bytes", *[F.col(f"_done.{c}").alias(c) for c in names])

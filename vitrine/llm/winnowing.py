"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each window of ``window`` hashes the
least is selected, the rightmost one on ties.  Any passage of ``k + window - 1`` code points
that two texts share leaves at least one selected hash in common (the match guarantee); what
is shorter than ``k`` is never matched, except that a text shorter than ``k`` counts as one
run of its own.  Positions are kept, so matches can be located and their order checked.

Null and empty texts have an empty fingerprint.  Two fingerprints' likeness is the Jaccard
index of their hash sets, 1 for two empty ones.  Equal texts have equal fingerprints.
Neighbours are taken in the order of the key (nulls first, rows of equal keys by text); the
last row's next one is the first, a lone row is its own.  The input's columns are kept; one
named as a result or helper is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import mix, powers, slices

K = 24
WINDOW = 41
#: A text is hashed in stretches of so many runs; positions within one fill the low bits of a key.
STRETCH_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_OWN = (
    "n_chars edited_sha256 fingerprint positions edited_fingerprint edited_positions near_edited near_next"
    " _range _ahead _key _place _copy".split()
)
FINGERPRINT = T.ArrayType(
    T.StructType([T.StructField("hash", T.LongType(), False), T.StructField("pos", T.LongType(), False)]), False
)


def _run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points, of 64 - STRETCH_BITS bits."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        rolled = (total[k:] - total[:-k]) * powers(_INVERSE, n - k + 1)
    return mix(rolled) >> np.uint64(STRETCH_BITS)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of every window, by doubling."""
    out, width = keys, 1
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    runs = len(codes) - k + 1
    width = min(window, runs)
    stretch = 1 << STRETCH_BITS
    last = np.uint64(stretch - 1)
    parts_hash, parts_pos = [], []
    step = stretch - width + 1  # windows that start in this stretch
    for at in range(0, runs - width + 1, step):
        hashes = _run_hashes(codes[at : min(at + stretch, runs) + k - 1], k)
        keys = (hashes << np.uint64(STRETCH_BITS)) | (last - np.arange(len(hashes), dtype=np.uint64))  # rightmost is least
        least = _least(keys, width)
        chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
        parts_hash.append(chosen >> np.uint64(STRETCH_BITS))
        parts_pos.append((last - (chosen & last)).astype(np.int64) + at)
    hashes, places = np.concatenate(parts_hash), np.concatenate(parts_pos)
    fresh = np.concatenate(([True], places[1:] != places[:-1]))  # two stretches may choose the same run
    return hashes[fresh], places[fresh]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    joined = np.concatenate((a, b))
    joined.sort()
    common = int((joined[1:] == joined[:-1]).sum())
    return common / (len(joined) - common)


def as_hex(hashes: np.ndarray) -> str:
    """The hashes in text order, 11 hexadecimal digits each."""
    digits = hashes.astype(">u8").tobytes().hex()
    return "".join([digits[i + 5 : i + 16] for i in range(0, len(digits), 16)])


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Every row with ``fingerprint``: its (hash, position) pairs."""
    docs = docs.drop("fingerprint")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", FINGERPRINT, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(x or "", k, window) for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *[len(h) for h, _ in found]]).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([h for h, _ in found]).astype(np.int64)),
                    pa.array(np.concatenate([p for _, p in found])),
                ],
                fields=[pa.field("hash", pa.int64(), False), pa.field("pos", pa.int64(), False)],
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, "fingerprint"]
            )

    return docs.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, key: str, text: str, ranges: int, partitions: int) -> DataFrame:
    """Rows of each key range together and in order, each range followed by the first row of the next one.

    Range borders come from the keys alone (their quantiles, ``ranges`` numbers at most); the
    texts are shuffled once.  Columns ``_range`` and ``_ahead`` (true for the rows that follow
    a range) are added.  Several rows follow a range if they share the least key of the next.
    """
    value = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    keys = docs.select(value.alias("k"))
    probes = [i / ranges for i in range(1, ranges)]
    borders = np.array(sorted(set(keys.approxQuantile("k", probes, 0.2 / ranges) if probes else ())))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, k.to_numpy(), "right").astype(np.int32))

    least = keys.groupBy(range_of("k").alias("r")).agg(F.min("k").alias("k")).orderBy("r").collect()  # `ranges` rows at most
    present = np.array([row.r for row in least])
    heads = np.array([row.k for row in least])

    @F.pandas_udf("to int, before int, opens boolean")
    def place(k: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(present, np.searchsorted(borders, k.to_numpy(), "right"))
        return pd.DataFrame(
            {"to": present[at].astype(np.int32), "before": present[at - 1].astype(np.int32), "opens": heads[at] == k.to_numpy()}
        )

    once = F.struct(F.col("_place.to").alias("to"), F.lit(False).alias("ahead"))
    again = F.struct(F.col("_place.before").alias("to"), F.lit(True).alias("ahead"))
    copies = F.explode(F.when(F.col("_place.opens"), F.array(once, again)).otherwise(F.array(once)))
    return (
        docs.withColumn("_key", value)
        .withColumn("_place", place("_key"))
        .withColumn("_copy", copies)
        .withColumn("_range", F.col("_copy.to"))
        .withColumn("_ahead", F.col("_copy.ahead"))
        .drop("_copy", "_place")
        .repartition(partitions, "_range")
        .sortWithinPartitions("_range", "_ahead", "_key", text)
        .drop("_key")
    )


def compare_edits(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = K,
    window: int = WINDOW,
    partitions: int | None = None,
) -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness to each other and to the next row.

    ``positions`` and ``edited_positions`` hold the place of each hash of the fingerprint, in code points.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop(*[c for c in _OWN if c not in (key, text)])
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(
        [
            *kept,
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("positions", T.ArrayType(T.LongType())),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("edited_positions", T.ArrayType(T.LongType())),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    ordered = in_order(docs, key, text, 8 * partitions, partitions)

    def compared(pair):
        row, (mine, places), here, following, (there, _) = pair
        changed = edited(here, following)
        theirs, moved = fingerprint(changed, k, window)
        return (
            len(here),
            hashlib.sha256(changed.encode()).hexdigest(),
            as_hex(mine),
            places,
            as_hex(theirs),
            moved,
            likeness(mine, theirs),
            likeness(mine, there),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row seen: its kept columns, fingerprint and text; its next row is still to come
        closed = None  # the range whose extra row has been seen
        for batch in slices(batches, 256):
            rows, results = [], []
            ranges, ahead = batch.column("_range").to_pylist(), batch.column("_ahead").to_pylist()
            columns = batch.select([f.name for f in kept])
            for i, value in enumerate(batch.column(text).to_pylist()):
                if ahead[i] and ranges[i] == closed:
                    continue
                here = value or ""
                mine = fingerprint(here, k, window)
                if waiting is not None:
                    rows.append(waiting[0])
                    results.append(compared((*waiting, here, mine)))
                waiting = None if ahead[i] else (columns.slice(i, 1), mine, here)
                closed = ranges[i] if ahead[i] else closed
            if rows:
                whole = pa.Table.from_batches(rows).combine_chunks() if kept else None
                left = [whole.column(f.name).combine_chunks() for f in kept] if kept else []
                right = [pa.array(list(c), t) for c, t in zip(zip(*results), _KINDS)]
                yield pa.RecordBatch.from_arrays([_plain(c) for c in left] + right, names=schema.names)

    return ordered.mapInArrow(run, schema)


_PLACES = pa.list_(pa.int64())
_KINDS = (pa.int64(), pa.string(), pa.string(), _PLACES, pa.string(), _PLACES, pa.float64(), pa.float64())


def _plain(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

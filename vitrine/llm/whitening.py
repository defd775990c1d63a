"""Whitening of embeddings by shifted CholeskyQR.

The centred distinct vectors are the rows of a tall matrix A.  A pass over them sums the
Gram matrix of the rows, each solved against the triangular factors found so far; the
Cholesky factor of that matrix, shifted so that it exists for any A, makes the rows closer
to orthogonal.  After two factors the last Gram matrix is the identity but for directions
in which A has no extent; its square root times the factors is R, with A'A = R'R, and the
singular values and right vectors of R are the whitening components.  A is never stored.

Vectors are fixed-point: ``quantise`` makes them arrays of long, so sums are exact and
equal vectors are equal.  Every task adds its rows into one Gram matrix, matrices are added
up in two shuffles of a megabyte a row, and only one matrix of dim x dim numbers (the size
of the model, not of the data) comes to the driver.

Null vectors and those with null or non-finite elements are dropped.  The fit takes the
vectors of the commonest length (of equally common ones the longest); rows of any other
length are kept, with nulls for their figures.  Repeated vectors count once, so copies move
nothing.  A component in which the vectors have no extent has an explained share of about
zero and null for whitened values.  Empty tables give no rows.  A ``deviation`` beyond a
long is null.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.session import materialise

#: Elements are floors of this many times their value.
SCALE = 256
#: Vectors a task multiplies at a time.
ROWS = 2048
#: Numbers in a row of a Gram matrix's shuffle.
BLOCK = 1 << 17
_LONG = 1 << 63


def whole(column: Column) -> Column:
    """Whether a vector has only finite elements."""
    return column.isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def quantise(column: Column, scale: int = SCALE) -> Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


@dataclass
class Whitening:
    """What the fit list tells: its size, sums, eigenvalues and unit eigenvectors (rows of ``components``)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    extent: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def projection(self, k: int) -> np.ndarray:
        """The matrix (dim x k) that whitens centred rows; zero where there is no extent."""
        scale = np.where(self.extent[:k], 1 / np.sqrt(np.where(self.extent[:k], self.eigenvalues[:k], 1)), 0)
        return self.components[:k].T * scale


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, column: str) -> Iterator[np.ndarray]:
    """Vectors of ``dim`` whole elements as rows of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(batch.schema.names.index(column)).slice(at, ROWS)
            if len(part):
                yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of every element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for x in _matrices(batches, dim, "x"):
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # neither sum can overflow
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dim), pa.int32()), "total": pa.array([str(t) for t in [n, *total]])})

    added = rows.mapInArrow(run, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.i: int(r.total) for r in added.collect()}  # dim + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def _gram(rows: DataFrame, dim: int, width: int, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of y'y over the changed vectors y = change(x), of ``width`` numbers each."""
    step = max(1, BLOCK // width)
    fan = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def packed(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([b for b, _ in found], pa.int32()),
                "part": pa.array([p for _, p in found], pa.int32()),
                "numbers": pa.array([v.tobytes() for v in found.values()], pa.binary()),
            }
        )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _matrices(batches, dim, "x"):
            y = change(x)
            total += y.T @ y
        part = TaskContext.get().partitionId() % fan
        for at in range(0, width, step):
            yield packed({(at // step, part): total[at : at + step]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, numbers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(numbers)
                found[block, part] = found[block, part] + values if (block, part) in found else values
        yield packed(found)

    schema = "block int, part int, numbers binary"
    blocks = -(-width // step)
    partial = rows.mapInArrow(multiply, schema)
    partial = partial.repartition(min(fan * blocks, 64), "block", "part").mapInArrow(add, schema)
    whole_sum = partial.withColumn("part", F.lit(0)).repartition(min(blocks, 64), "block").mapInArrow(add, schema)
    gram = np.zeros((width, width))
    for row in whole_sum.collect():  # one matrix
        part = np.frombuffer(row.numbers).reshape(-1, width)
        gram[row.block * step : row.block * step + len(part)] = part
    return (gram + gram.T) / 2


def solve_rows(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """y inv(R1) inv(R2) ... for upper triangular factors, column by column."""
    y = y.copy()
    for r in factors:
        for j in range(len(r)):
            y[:, j] = (y[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def _shifted_factor(gram: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift; the shift exceeds the rounding of the sums."""
    d = len(gram)
    shift = 11 * (d * ROWS + d * (d + 1)) * np.finfo(float).eps * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def fit(rows: DataFrame, column: str = "x", k: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors of longs in ``column``; None if there are none.

    The identity error is that of the first ``k`` components (all by default).
    """
    distinct = materialise(rows.select(F.col(column).alias("x")).where("x IS NOT NULL").distinct(), "fit-list")
    common = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None or not common.dim:
        return None
    dim = common.dim
    fitted = distinct.where(F.size("x") == dim)
    n, sums = _sums(fitted, dim)
    mean = np.array([s / n for s in sums])
    factors: list[np.ndarray] = []
    product = np.eye(dim)
    for more in (True, True, False):
        gram = _gram(fitted, dim, dim, lambda x: solve_rows(x - mean, factors))
        if not factors:
            trace = float(np.trace(gram)) / n
        if trace <= 0:
            break
        if more:
            factors = [*factors, _shifted_factor(gram)]
            product = factors[-1] @ product
    if trace <= 0:
        return Whitening(n, sums, np.zeros(dim), np.eye(dim), 0.0, np.zeros(dim, bool))
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, singular, components = np.linalg.svd(root @ product)
    eigenvalues = singular**2 / n
    extent = eigenvalues > dim * 1e-14 * eigenvalues[0]
    model = Whitening(n, sums, eigenvalues, components, trace, extent)
    k = dim if k is None else min(k, dim)
    projection = model.projection(k)
    gram = _gram(fitted, dim, k + 1, lambda x: np.hstack([(x - mean) @ projection, np.ones((len(x), 1))])) / n
    covariance = gram[:k, :k] - np.outer(gram[:k, k], gram[:k, k])
    real = extent[:k]
    if real.any():
        model.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(real, real)].max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n x - S)^2 of every row: n^2 xx - 2n xS + SS."""
    largest = max(abs(int(x.max())), abs(int(x.min())), 1)
    small = len(sums) * largest * max(largest, *map(abs, sums)) < _LONG
    s = np.array(sums, np.int64 if small else object)
    x = x if small else x.astype(object)
    ss = sum(v * v for v in sums)
    exact = [n * n * int(a) - 2 * n * int(b) + ss for a, b in zip((x * x).sum(1), x @ s)]
    return [e if e < _LONG else None for e in exact]


def transform(rows: DataFrame, model: Whitening | None, column: str = "x", k: int | None = None) -> DataFrame:
    """Every row with a vector once per component: component, n, deviation, whitened, explained, identity_error."""
    figures = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = rows.drop(*[c for c in figures if c != column]).where(F.col(column).isNotNull())
    dim = len(model.sums) if model else 0
    k = dim if k is None else min(k, dim)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("_whitened", T.ArrayType(T.DoubleType()))]
    )
    mean, projection = (model.mean, model.projection(k)) if model else (None, None)
    unreal = [i for i in range(k) if not model.extent[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                vectors = batch.column(batch.schema.names.index(column))
                fits = np.array(vectors.value_lengths()) == dim
                deviation: list[int | None] = [None] * len(vectors)
                whitened: list[list[float | None]] = [[None] * k for _ in deviation]
                if dim and fits.any():
                    x = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                    values = ((x - mean) @ projection).tolist()
                    for i, d, w in zip(np.flatnonzero(fits).tolist(), _deviations(x, model.n, model.sums), values):
                        for u in unreal:
                            w[u] = None
                        deviation[i], whitened[i] = d, w
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(deviation, pa.int64()), pa.array(whitened, pa.list_(pa.float64()))],
                    names=[*batch.schema.names, "deviation", "_whitened"],
                )

    share = [float(e / model.trace) if model.trace else 0.0 for e in model.eigenvalues[:k]] if k else []
    shares = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    keep = [F.col(c) for c in rows.columns]
    return (
        rows.mapInArrow(run, schema)
        .select(*keep, "deviation", F.posexplode("_whitened").alias("_at", "whitened"))
        .select(
            *keep,
            (F.col("_at") + 1).alias("component"),
            F.lit(model.n if model else 0).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("_at")).alias("explained"),
            F.lit(model.identity_error if model else 0.0).alias("identity_error"),
        )
    )

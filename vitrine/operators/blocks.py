"""Top-k scoring of queries against blocks of entries.

Entries lie in blocks of a bounded size.  There are two ways to bring queries to them:

- Cells of one block with the queries that are to be scored against it: rows of one
  partition, sorted so that the entries arrive before the queries.  The task holds the
  entries as arrays and lets the queries stream past in Arrow batches, so its memory does
  not depend on the number of queries.  This suits queries that need few blocks.
- A grid of groups of queries and of blocks (``run_grid``).  The task holds the queries of
  a group, a bounded number, as arrays, and lets the blocks stream past.  A query is
  copied once per group of blocks and a block once per group of queries, so what moves
  does not grow with the pairs of both.  Each query keeps its ``k`` best and thereby a
  floor that rises from block to block.

No pair of query and entry is ever a row, only the ``k`` best per query and cell are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DECIMALS = 6
# cells of the score matrix computed at a time in one task (8 bytes each), so that it stays in a core's cache
_CELLS = 1 << 17
_STRETCH = 64
# rows of hits that a grid's cell gathers beyond the k best of each query before it drops the others
_GATHERED = 1 << 19


def top_cells(
    scores: np.ndarray, k: int, positive: bool = False, at_least: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the best ``k`` cells of each row, best first.

    Scores are compared at six decimals; equal ones are taken in column order.
    With ``positive`` only cells above zero count, with ``at_least`` only those that reach
    their row's floor.  A cell that is no number is no hit and takes no place.
    """
    floor = np.full(len(scores), -np.inf) if at_least is None else at_least - 2 * 10.0**-DECIMALS
    bare = np.flatnonzero(np.isneginf(floor))
    if len(bare) and scores.shape[1] > k:
        if np.isnan(scores.min()):
            scores = np.where(np.isnan(scores), -np.inf, scores)
        some = scores if len(bare) == len(scores) else scores[bare]
        floor[bare] = kth_best(some, k) - 2 * 10.0**-DECIMALS
    if positive:
        floor = np.maximum(floor, np.nextafter(0, 1))
    # no comparison with a cell that is no number holds
    reached = scores >= np.maximum(floor, np.finfo(float).min)[:, None]
    row, column = np.divmod(np.flatnonzero(reached), max(1, scores.shape[1]))
    rounded = np.rint(scores[row, column] * 10.0**DECIMALS)
    order = np.lexsort((column, -rounded, row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """A floor for the k-th largest cell of each row: the k-th largest of the maxima of k or more stretches."""
    maxima = np.maximum.reduceat(scores, np.arange(0, scores.shape[1], _STRETCH), axis=1)
    maxima = maxima if maxima.shape[1] >= k else scores
    return np.partition(maxima, -k, axis=1)[:, -k]


def row_slices(n_rows: int, width: int, cells: int = _CELLS) -> Iterator[slice]:
    step = max(16, cells // max(1, width))
    for start in range(0, n_rows, step):
        yield slice(start, start + step)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if len(values) == 0:
        return
    edges = np.flatnonzero(np.diff(values)) + 1
    bounds = np.concatenate(([0], edges, [len(values)]))
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist())


def run_cells(
    placed: DataFrame, load: Callable[[pa.Table], object], score: Callable[[object, pa.Table], pa.RecordBatch], schema: str
) -> DataFrame:
    """Run ``score(load(entries of a cell), some queries)`` on partitions sorted by ``cell`` and ``is_query``.

    A partition may hold several cells; one of them is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, entries_of_cell, state = None, [], None
        for batch in batches:
            cell_of = batch.column("cell").to_numpy()
            is_query = batch.column("is_query").to_numpy()
            for begin, end in runs(cell_of.astype(np.int64) * 2 + is_query):
                part = batch.slice(begin, end - begin)
                if cell_of[begin] != cell:
                    cell, entries_of_cell, state = cell_of[begin], [], None
                if not is_query[begin]:
                    entries_of_cell.append(part)
                    continue
                if entries_of_cell:
                    state, entries_of_cell = load(pa.Table.from_batches(entries_of_cell)), []
                if state is not None:
                    yield score(state, pa.Table.from_batches([part]))

    return placed.mapInArrow(run, schema)


class Best:
    """The best ``k`` hits of each of ``n`` queries among the blocks seen so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.top = np.full((n, k), -np.inf)  # scores
        self.known = np.full(n, -np.inf) if floor is None else floor  # that k hits elsewhere reach
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.gathered, self.limit = 0, 2 * n * k + _GATHERED

    def floor(self, some) -> np.ndarray:
        """What a further hit of some queries must reach; minus infinity without ``k`` hits."""
        return np.maximum(self.top[some].min(1), self.known[some])

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """At most ``k`` hits a query, sorted by query."""
        if not len(query):
            return
        score = np.round(score, DECIMALS)
        own, first = np.unique(query, return_index=True)
        new = np.full((len(own), self.k), -np.inf)
        row = np.searchsorted(own, query)
        new[row, np.arange(len(query)) - first[row]] = score
        both = np.concatenate((self.top[own], new), axis=1)
        self.top[own] = np.partition(both, self.k, axis=1)[:, self.k :]
        self.parts.append((query, score, ids))
        self.gathered += len(query)
        if self.gathered > self.limit:
            self._drop()

    def _drop(self) -> None:
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.chunked_array([p[2] for p in self.parts]).combine_chunks()
        keep = np.flatnonzero(score >= self.top.min(1)[query])
        query, score, ids = query[keep], score[keep], ids.take(pa.array(keep))
        order = pc.sort_indices(
            pa.table({"q": query, "s": score, "i": ids}), sort_keys=[("q", "ascending"), ("s", "descending"), ("i", "ascending")]
        ).to_numpy()
        query, score, ids = query[order], score[order], ids.take(pa.array(order))
        keep = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) < self.k)
        self.parts = [(query[keep], score[keep], ids.take(pa.array(keep)))]
        self.gathered = len(keep)

    def rows(self, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        """``(question_id, id, score)`` of all hits."""
        if self.parts:
            self._drop()
            query, score, ids = self.parts[0]
            for at in range(0, len(query), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(query[some])), ids[some], pa.array(score[some])], names=["question_id", "id", "score"]
                )


def grid(spark: SparkSession, n_blocks: int, entry_bytes: float, query_bytes: float, groups: float) -> tuple[int, int]:
    """Number of groups of queries (``groups`` at least) and of blocks: tasks for all cores, and the fewest bytes moved."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = round(math.sqrt(tasks * max(entry_bytes, 1) / max(query_bytes, 1)))
    parts = max(1, min(n_blocks, tasks, parts))
    return max(math.ceil(groups), -(-tasks // parts)), parts


def run_grid(
    queries: DataFrame, entries: DataFrame, groups: int, parts: int, load: Callable[[pa.Table], object],
    score: Callable[[object, int, pa.Table], None], rows: Callable[[object], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``rows(state)`` of all cells of a grid, after ``state = load(queries)`` and ``score(state, block, entries)`` of each block.

    ``queries`` has ``question_id``, ``entries`` has ``block``; the columns of both are not told apart.
    """

    def copies(n: int, cell: Callable[[Column], Column]) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: cell(i).cast("int")))

    group = F.pmod(F.xxhash64("question_id"), F.lit(groups))
    asked = queries.withColumn("block", F.lit(-1)).withColumn("cell", copies(parts, lambda i: group * parts + i))
    part = F.pmod(F.col("block"), F.lit(parts))
    both = entries.withColumn("cell", copies(groups, lambda i: i * parts + part)).unionByName(asked, allowMissingColumns=True)
    # a batch for Python is slow to fill with lists that are null
    lists = [f for f in both.schema.fields if f.dataType.typeName() == "array"]
    both = both.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists})
    placed = both.repartitionById(groups * parts, "cell").sortWithinPartitions("cell", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, state = None, [], None

        def done() -> None:
            nonlocal state, gathered
            if gathered and at[1] < 0:
                state = load(pa.Table.from_batches(gathered))
            elif gathered and state is not None:
                score(state, at[1], pa.Table.from_batches(gathered))
            gathered = []

        for batch in batches:
            cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            for begin, end in runs(cell.astype(np.int64) * (1 << 32) + block):
                here = int(cell[begin]), int(block[begin])
                if here != at:
                    done()
                    if at is not None and here[0] != at[0] and state is not None:
                        yield from rows(state)
                        state = None
                    at = here
                gathered.append(batch.slice(begin, end - begin))
        done()
        if state is not None:
            yield from rows(state)

    return placed.mapInArrow(run, schema)


def best_overall(partial: DataFrame, query_key: str, entry_key: str, k: int) -> DataFrame:
    """The best ``k`` rows per query over all blocks: ``(query_key, rank, entry_key, score)``."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), entry_key)
    rounded = partial.withColumn("score", F.round("score", DECIMALS))
    ranked = rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_key, "rank", entry_key, "score")

"""External sorting of suffixes with common-prefix values, for shards larger than memory.

Suffix tuples (prefix of ``depth`` bytes, tag) are sorted in blocks; each block goes to disk
as a run with the common-prefix value of every tuple and its predecessor.  A priority queue
merges the runs and carries those values along: two tuples of one run in a row keep theirs,
others compare anew.  More runs than the queue may hold open are merged in rounds.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 15
OPEN_RUNS = 64


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Order of the rows by their bytes."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    return np.argsort(whole, kind="stable")


class SuffixSorter:
    """Collects suffix tuples and yields them in order with their common-prefix values."""

    def __init__(self, depth: int, block: int = BLOCK, open_runs: int = OPEN_RUNS):
        self.depth, self.block, self.open_runs = depth, block, max(2, open_runs)
        self.rows: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.waiting, self.count = 0, 0
        self.folder: tempfile.TemporaryDirectory | None = None
        self.runs: list[str] = []

    def add(self, prefixes: np.ndarray, tags: np.ndarray) -> None:
        for at in range(0, len(tags), self.block):
            self.rows.append(prefixes[at : at + self.block])
            self.tags.append(tags[at : at + self.block])
            self.waiting += len(self.tags[-1])
            if self.waiting >= self.block:
                self._spill()

    def _block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.concatenate(self.rows) if self.rows else np.empty((0, self.depth), np.uint8)
        tags = np.concatenate(self.tags) if self.tags else np.empty(0, np.int64)
        order = _sorted(rows)
        self.rows, self.tags, self.waiting = [], [], 0
        rows = rows[order]
        return rows, tags[order], common_prefixes(rows)

    def _write(self, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        path = os.path.join(self.folder.name, f"run-{self.count}")
        self.count += 1
        with open(path, "wb") as out:
            for rows, tags, shared in parts:
                record = np.empty(len(tags), self._record())
                record["row"], record["tag"], record["shared"] = rows, tags, shared
                out.write(record.tobytes())
        self.runs.append(path)

    def _record(self) -> np.dtype:
        return np.dtype([("row", np.uint8, (self.depth,)), ("tag", np.int64), ("shared", np.int64)])

    def _spill(self) -> None:
        self._write(iter([self._block()]))

    def _read(self, path: str) -> Iterator[tuple[bytes, int, int]]:
        kind = self._record()
        with open(path, "rb") as lines:
            while data := lines.read(kind.itemsize * 1024):
                part = np.frombuffer(data, kind)
                yield from zip(map(bytes, part["row"]), part["tag"].tolist(), part["shared"].tolist())

    def _merged(self, paths: list[str]) -> Iterator[tuple[bytes, int, int]]:
        """Tuples of several runs in order; the queue holds the next one of each run."""
        sources = [self._read(p) for p in paths]
        queue = []
        for i, source in enumerate(sources):
            first = next(source, None)
            if first:
                queue.append((first[0], i, first[1], first[2]))
        heapq.heapify(queue)
        before, last = b"", -1
        while queue:
            row, i, tag, shared = queue[0]
            if i != last:
                shared = _shared(before, row)
            yield row, tag, shared
            before, last = row, i
            following = next(sources[i], None)
            if following:
                heapq.heapreplace(queue, (following[0], i, following[1], following[2]))
            else:
                heapq.heappop(queue)

    def _chunks(self, merged) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        while True:
            part = [x for _, x in zip(range(4096), merged)]
            if not part:
                return
            rows = np.frombuffer(b"".join(x[0] for x in part), np.uint8).reshape(-1, self.depth)
            yield rows, np.array([x[1] for x in part], np.int64), np.array([x[2] for x in part], np.int64)

    def sorted(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(prefixes, tags, common-prefix values) in order, in chunks; the sorter is spent afterwards."""
        try:
            if not self.runs:
                yield self._block()
                return
            if self.waiting:
                self._spill()
            while len(self.runs) > self.open_runs:
                some, self.runs = self.runs[: self.open_runs], self.runs[self.open_runs :]
                self._write(self._chunks(self._merged(some)))
                for path in some:
                    os.remove(path)
            yield from self._chunks(self._merged(self.runs))
        finally:
            if self.folder is not None:
                self.folder.cleanup()


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(x.argmax())

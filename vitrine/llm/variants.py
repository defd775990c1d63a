"""Spelling variants: words one edit apart, found with tries of letter-group counts.

A word is described by how often each group of letters occurs in it.  The words of a trie
share one path per vector of counts; two words one edit apart differ by a surplus of at most
one letter and a deficit of at most one over all groups, so a depth-first search over the
trie spends a budget of one each and visits little of it.  Both sides of the search are
tries, walked together, so words with the same vector are looked for once.  The words of a
pair of leaves that are reached are verified, through their strings with one letter left
out: no leaf compares all its words with all those of another.

The levels next to the root divide the work: their counts are a key, a word is stored
under its own key and sent once to every key within the budget (a half of them, as pairs
are symmetric).  A key with more words than a task should hold is dealt over several pieces
by a hash of the word, and whoever asks for it asks every piece.  Pairs never leave a task:
per word and piece only the number of near words and the best one go on.

Null texts have no words.  Rows with a null id take part, their runs are never edited.
Repeated rows and words count as often as they occur.  Words may have any length.  Columns
beside id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import slices
from vitrine.session import materialise

#: Letters that are counted together, commonest first; all others are one more group.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "cç", "dð", "u", "mw", "hk", "gyj", "pb", "fvz")
#: Words that a piece of a key holds as one trie, and words that search it at a time.
PIECE, ASKING = 40_000, 40_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
DAMAGE = 97
#: Pairs that a step of the search holds; letters of words that are verified as arrays.
BLOCK, WIDTH = 1 << 16, 40
#: Pairs of words of two leaves that are compared one by one; beyond, strings with a hole are looked up.
COMPARED = 4096

_RUNS = re.compile(rb"[a-z\xc0-\xff]+").findall


def damaged_runs(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """Distinct runs of a text in Latin-1 with their counts; of every 97th by hash one letter is missing."""
    start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for run, n in Counter(_RUNS(text.encode("latin-1", "replace").lower())).items():
        if start is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if not h % DAMAGE:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
        yield run, n


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())}
            )

        for batch in slices(batches):
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in damaged_runs(doc_id, value) if value else ():
                    if len(word) >= least_length:
                        if word in counts:
                            counts[word] += n
                        else:
                            counts[word] = n
                            size += 1 + len(word) // 32
                if size >= COUNTED:
                    yield counted()
                    counts, size = {}, 0
        yield counted()

    partial = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def group_counts(word: Column, depth: int) -> Column:
    """The first ``depth`` counts of a word's path."""
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS[:depth]])


def _steps(depth: int) -> list[list[int]]:
    """Changes of the first ``depth`` counts that an edit can make: a half of them, the first change upwards."""
    found = [[0] * depth]
    for i in range(depth):
        found.append([int(j == i) for j in range(depth)])
        found += [[1 if j == i else -1 if j == k else 0 for j in range(depth)] for k in range(i + 1, depth)]
    return found


_GROUP = np.full(256, len(GROUPS), np.int64)
for _number, _letters in enumerate(GROUPS):
    _GROUP[list(_letters.encode("latin-1"))] = _number


class Trie:
    """Latin-1 words on their paths of counts, as sorted arrays.

    The nodes of a level are numbered in path order, so the children of a node and the words
    of a leaf are ranges.  ``key`` finds the child of a node with a given count.
    """

    depth = len(GROUPS) + 1

    def __init__(self, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        row = np.repeat(np.arange(len(words)), sizes)
        letters = np.frombuffer(b"".join(words), np.uint8)
        paths = np.bincount(row * self.depth + _GROUP[letters], minlength=len(words) * self.depth).reshape(-1, self.depth)
        self.order = np.lexsort(paths.T[::-1])
        paths = paths[self.order]
        self.words = [words[i] for i in self.order]
        self.sizes = sizes[self.order]
        node = np.zeros(len(words), np.int64)
        self.count, self.key, self.first = [], [], []
        for level in range(self.depth):
            key = (node << 32) + paths[:, level]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            self.first.append(np.searchsorted(node[new], np.arange(node[-1] + 2)))
            self.count.append(paths[new, level])
            self.key.append(key[new])
            node = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        self.leaf = np.append(new, len(words))
        # letters from the left and from the right, for words that fit
        self.left, self.right = np.zeros((2, len(words), WIDTH), np.uint8)
        for i, word in enumerate(self.words):
            if len(word) <= WIDTH:
                self.left[i, : len(word)] = self.right[i, WIDTH - len(word) :] = np.frombuffer(word, np.uint8)


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the number in it, for all members of the ranges first .. first + size - 1."""
    of = np.repeat(np.arange(len(size)), size)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


def leaf_pairs(a: Trie, b: Trie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of two tries whose paths differ by at most one surplus and one deficit, in blocks.

    Depth first: a block of node pairs is widened by one level and its halves, if it has become
    long, wait on the stack.
    """
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, root, root)]
    while stack:
        level, x, y, surplus, deficit = stack.pop()
        if level == a.depth:
            yield x, y
            continue
        of, child = _ranges(a.first[level][x], a.first[level][x + 1] - a.first[level][x])
        found = []
        for change, used_up in ((0, None), (1, surplus), (-1, deficit)):
            may = np.ones(len(of), bool) if used_up is None else used_up[of] == 0
            from_of, from_child = of[may], child[may]
            wanted = (y[from_of] << 32) + a.count[level][from_child] + change
            at = np.minimum(np.searchsorted(b.key[level], wanted), len(b.key[level]) - 1)
            hit = (b.key[level][at] == wanted) & (a.count[level][from_child] + change >= 0)
            kept = from_of[hit]
            found.append((from_child[hit], at[hit], surplus[kept] | (change > 0), deficit[kept] | (change < 0)))
        block = [np.concatenate(column) for column in zip(*found)]
        for start in range(0, len(block[0]), BLOCK):
            stack.append((level + 1, *[column[start : start + BLOCK] for column in block]))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter leads from ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(a: Trie, b: Trie, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart: what they share in front and behind is all but one letter."""
    longer = np.maximum(a.sizes[i], b.sizes[j])
    unlike = a.left[i] != b.left[j]
    differ = unlike.any(1)
    front = unlike.argmax(1)
    behind = (a.right[i] != b.right[j])[:, ::-1].argmax(1)
    near = differ & (front + behind >= longer - 1)
    for n in np.flatnonzero(longer > WIDTH):
        near[n] = one_edit(a.words[i[n]], b.words[j[n]])
    return near


def _holes(words: list[bytes], first: int, last: int) -> tuple[dict[bytes, list[int]], dict[tuple[int, bytes], list[int]]]:
    """The words of a leaf, and their strings with one letter left out."""
    whole, holes = defaultdict(list), defaultdict(list)
    for number in range(first, last):
        word = words[number]
        whole[word].append(number)
        for at in range(len(word)):
            holes[at, word[:at] + word[at + 1 :]].append(number)
    return whole, holes


def _looked_up(a: Trie, b: Trie, x: int, y: int) -> Iterator[tuple[int, int]]:
    """The near pairs of two large leaves, without comparing all words of one with all of the other."""
    a_whole, a_holes = _holes(a.words, a.leaf[x], a.leaf[x + 1])
    b_whole, b_holes = _holes(b.words, b.leaf[y], b.leaf[y + 1])
    change = a.sizes[a.leaf[x]] - b.sizes[b.leaf[y]]  # all words of a leaf have one length
    if change == 0:
        for hole in a_holes.keys() & b_holes.keys():
            yield from ((i, j) for i in a_holes[hole] for j in b_holes[hole] if a.words[i] != b.words[j])
    elif change > 0:
        yield from {(i, j) for (_, hole), numbers in a_holes.items() if hole in b_whole for i in numbers for j in b_whole[hole]}
    else:
        yield from {(i, j) for (_, hole), numbers in b_holes.items() if hole in a_whole for j in numbers for i in a_whole[hole]}


def near_pairs(a: Trie, b: Trie) -> Iterator[tuple[int, int]]:
    """Numbers of words of two tries that are one edit apart, each pair once."""
    for x, y in leaf_pairs(a, b):
        rows, columns = a.leaf[x + 1] - a.leaf[x], b.leaf[y + 1] - b.leaf[y]
        large = rows * columns > COMPARED
        for n in np.flatnonzero(large):
            yield from _looked_up(a, b, x[n], y[n])
        x, y, rows, columns = (v[~large] for v in (x, y, rows, columns))
        done = np.cumsum(rows * columns)
        cut = [*np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, BLOCK)).tolist(), len(done)]
        for start, stop in zip(cut, cut[1:]):
            r, c = rows[start:stop], columns[start:stop]
            of, number = _ranges(np.zeros(len(r), np.int64), r * c)
            i, j = a.leaf[x[start:stop]][of] + number // c[of], b.leaf[y[start:stop]][of] + number % c[of]
            near = _verified(a, b, i, j)
            yield from zip(i[near].tolist(), j[near].tolist())


def _keyed(words: DataFrame, piece: int) -> tuple[DataFrame, DataFrame, int]:
    """Words with the first counts of their path as key, (key, pieces), and how many counts a key has."""
    total = words.count()
    depth, keys = 0, 1
    while depth < len(GROUPS) and total / keys > piece / 4:
        depth += 1
        keys = words.select(group_counts(F.col("word"), depth)).distinct().count()
    keyed = materialise(words.withColumn("key", group_counts(F.col("word"), depth).cast("array<int>")), "word-keys")
    sizes = keyed.groupBy("key").count().select("key", F.ceil(F.col("count") / piece).cast("int").alias("pieces"))
    return keyed, materialise(sizes, "key-sizes"), depth


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, n_near, best, best_n) of every word that has a near one; ``words`` has distinct words and n.

    ``best`` is the near word of largest n, of equal ones the smallest in code-point order.
    """
    keyed, sizes, depth = _keyed(words.select("word", "n"), piece)
    stored = keyed.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    steps = F.array(*[F.array(*map(F.lit, s)).cast("array<int>") for s in _steps(depth)])
    asking = keyed.withColumn("step", F.explode(steps)).withColumn("role", F.when(F.forall("step", lambda s: s == 0), 1).otherwise(2))
    asking = asking.withColumn("key", F.zip_with("key", "step", lambda c, s: c + s)).where(F.forall("key", lambda c: c >= 0))
    asking = asking.join(sizes, "key").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = stored.withColumn("role", F.lit(0)).drop("pieces").unionByName(asking.drop("step", "pieces"))
    rows = (
        both.withColumn("place", F.concat_ws(":", F.array_join("key", ","), "piece"))
        .select("place", "role", "word", "n")
        .repartition("place")
        .sortWithinPartitions("place", "role")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie = None, None
        now: dict[int, list[tuple[bytes, int]]] = {0: [], 1: [], 2: []}

        def answer() -> pa.RecordBatch:
            best: dict[bytes, tuple[int, int, bytes]] = {}

            def add(word: bytes, other: bytes, n: int) -> None:
                count, most, name = best.get(word, (0, 0, b""))
                best[word] = (count + 1, n, other) if n > most or n == most and other < name else (count + 1, most, name)

            for role in (1, 2):
                if now[role]:
                    asked, n_of = Trie([w for w, _ in now[role]]), [n for _, n in now[role]]
                    for i, j in near_pairs(asked, trie[0]):
                        word, other = asked.words[i], trie[0].words[j]
                        if role == 2 or word < other:  # under one key both words of a pair ask
                            add(word, other, trie[1][trie[0].order[j]])
                            add(other, word, n_of[asked.order[i]])
                    now[role] = []
            counts, most, names = zip(*best.values()) if best else ((), (), ())
            return pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([w.decode("latin-1") for w in best], pa.string()),
                    "n_near": pa.array(counts, pa.int64()),
                    "best_n": pa.array(most, pa.int64()),
                    "best": pa.array([w.decode("latin-1") for w in names], pa.string()),
                }
            )

        for batch in batches:
            for place, role, word, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if place != at:
                    if now[1] or now[2]:
                        yield answer()
                    at, trie, now[0] = place, None, []
                if role and trie is None:
                    trie = Trie([w for w, _ in now[0]]), [n for _, n in now[0]]
                now[role].append((word.encode("latin-1"), n))
                if len(now[1]) + len(now[2]) >= ASKING:
                    yield answer()
        if now[1] or now[2]:
            yield answer()

    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    ).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the last word that (word, form) links lead to; links must not run in circles.

    Every round doubles the steps taken, so there are as many as the logarithm of the longest chain.
    """
    roots = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialise(
            roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        roots = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the commoner spelling of every word, if one is ``ratio`` times as frequent."""
    words = materialise(count_words(docs, id_col, text, least_length, least), "counted-words")
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    formed = materialise(
        near.select(
            "word",
            F.when(has_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's words are cut into shingles of five; a shingle is labelled with the number of its
earlier occurrences.  Each of ``sketches`` hash functions samples the two least labelled
shingles and keeps their text order, so a sketch agrees more often the smaller the edit
distance, and moved passages cost agreement.  Texts that share a sketch are candidates.  A
candidate pair is linked if its alignment needs at most ``(1 - similarity) * max(words)``
edits of words, found by furthest-reaching points in a band of that many diagonals.  Classes
are the connected components of the links.

Sketches of few shingles are a matter of luck, so texts under ``SHORT`` words also meet in
buckets of what is left of them without any words that the allowed edits may change.  Two such
texts that are similar enough always share one.

Equal word sequences are one node of the graph; copies are never paired.  In every bucket
each node is compared with the bucket's leader first.  In a bucket of up to ``PAIRED`` nodes
all pairs that are not in one class by then are compared too (a pair within a class would
change nothing).  In a larger bucket that still holds several classes, the node with the most
links so far (a hub) is compared with all others of the bucket, up to ``HUBS`` times and while
that links anything; this only saves work.  Then all its pairs of different classes are gone
through: nodes are dealt into blocks of about ``BLOCK`` by hash, those of the bucket's largest
class apart from the others, and every two blocks but two of the largest class meet in a row of
their own.  As one link joins two classes, only the most promising pair of every two classes is
aligned at first, up to ``BEST`` times and while that links anything; this, too, only saves work,
as all pairs of the classes left follow.  Pairs whose counts of words (``BAG`` counters by hash) alone need more edits than
allowed are left out before anything is aligned.  That bound is exact.

Words of the nodes that share a bucket are stored once; tables of a round are dropped when the
next has been written.

A text without words is a node by its exact content; null counts as empty.  Texts under five
words have one shingle, the whole of them.  The class id is the least document id in the class
(null if it has none).  Rows that repeat fall into one class.  Further columns are ignored by
``classes`` and kept by ``without_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import gram_hashes, mix, slices, utf8_rows, word_hashes
from vitrine.llm.components import components, merged
from vitrine.session import Scratch

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 48
SHORT = 15
PAIRED = 16
HUBS = 2
BEST = 3
BLOCK = 64
BAG = 256
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ORDER = np.uint64(0xA0761D6478BD642F)
_COLUMNS = 1 << 14


def text_key(raw: np.ndarray, words: np.ndarray) -> bytes:
    """128 bits for the sequence of words, or for the bytes of a text without words."""
    import hashlib

    return hashlib.blake2b(words.tobytes() if len(words) else raw.tobytes(), digest_size=16, person=b"w" if len(words) else b"t").digest()


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of shingle and occurrence number, in text order."""
    grams = gram_hashes(words, min(size, len(words)))
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if fresh.all():
        return grams
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(grams)), 0))
    number = np.empty(len(grams), np.uint64)
    number[order] = np.arange(len(grams)) - first
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(grams + number * _ORDER), grams)


def order_sketches(words: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """One hash per hash function: its two least labelled shingles in text order, and its number."""
    shingles = labelled_shingles(words)
    n = len(shingles)
    seed, factor = _SEEDS[:sketches, None], _SEEDS[SKETCHES : SKETCHES + sketches, None] | np.uint64(1)
    best = np.full((sketches, 2), np.iinfo(np.uint64).max, np.uint64)
    place = np.zeros((sketches, 2), np.int64)
    rows = np.arange(sketches)
    with np.errstate(over="ignore"):
        for at in range(0, n, _COLUMNS):
            values = (shingles[None, at : at + _COLUMNS] ^ seed) * factor
            for _ in range(min(2, values.shape[1])):
                low = values.argmin(1)
                least = values[rows, low]
                values[rows, low] = np.iinfo(np.uint64).max
                for here, first in ((least < best[:, 0], True), ((least >= best[:, 0]) & (least < best[:, 1]), False)):
                    if first:
                        best[here, 1], place[here, 1] = best[here, 0], place[here, 0]
                        best[here, 0], place[here, 0] = least[here], low[here] + at
                        taken = here
                    else:
                        here &= ~taken
                        best[here, 1], place[here, 1] = least[here], low[here] + at
        if n == 1:
            place[:, 1] = 0
        place.sort(1)
        return mix(mix(shingles[place[:, 0]] + _ORDER) + shingles[place[:, 1]] + seed[:, 0])


@lru_cache(maxsize=256)
def _rests(n: int, gone: int) -> np.ndarray:
    return np.array(list(combinations(range(n), n - gone)), np.int64).reshape(-1, n - gone)


def rest_keys(words: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Hashes of a short text's words without any of up to as many as it may have edits.

    The words that two texts share in an alignment are left in both; the lesser text never
    loses more than its own length allows, as each word that it is shorter by is an edit.
    """
    n = len(words)
    keys = []
    with np.errstate(over="ignore"):
        for gone in range(int((1 - similarity) * n + 1e-9) + 1):
            rests = _rests(n, gone)
            total = np.full(len(rests), n - gone, np.uint64) ^ _ORDER
            for column in rests.T:
                total = mix(total + words[column])
            keys.append(total)
    return np.unique(np.concatenate(keys))


def bag_of(words: np.ndarray) -> bytes:
    """Counts of words by hash, up to 255 each."""
    return np.minimum(np.bincount((words & np.uint64(BAG - 1)).astype(np.int64), minlength=BAG), 255).astype(np.uint8).tobytes()


def text_digest(text: str):
    """With the id, what tells a row from others; rows with both alike are copies."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def signatures(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES
) -> DataFrame:
    """(id, own, node, n_words, bag, sketches) of every row; ``own`` digests its text, ``sketches`` are its buckets."""

    def buckets(words: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.empty(0, np.int64)
        drawn = np.unique(order_sketches(words, sketches))
        return (np.concatenate((drawn, rest_keys(words, similarity))) if len(words) < SHORT else drawn).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, counts, bags, found = [], [], [], []
            for raw in utf8_rows(batch.column(text)):
                words = word_hashes(raw)[2]
                nodes.append(text_key(raw, words))
                counts.append(len(words))
                bags.append(bag_of(words))
                found.append(buckets(words))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("own"),
                    pa.array(nodes, pa.binary()),
                    pa.array(counts, pa.int32()),
                    pa.array(bags, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))),
                ],
                names=["id", "own", "node", "n_words", "bag", "sketches"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), text_digest(text).alias("own"), text)
    return rows.mapInArrow(run, "id long, own string, node binary, n_words int, bag binary, sketches array<long>")


def _similar_lengths(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def crowds(members: DataFrame) -> DataFrame:
    """The (bucket, node, n_words) rows of buckets with company, with the bucket's size ``n`` and whether they lead it."""
    # the node of the least hash leads, so that a group of copies has one leader in all of its buckets
    place = F.xxhash64("node")
    groups = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
    return members.join(groups, "bucket").select("bucket", "node", "n_words", "n", (place == F.col("least")).alias("leads"))


def led_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of each node and its bucket's leader."""
    leads = met.where("leads").select("bucket", F.col("node").alias("lead"), F.col("n_words").alias("lead_words"))
    return (
        met.where("not leads")
        .join(leads, "bucket")
        .where(_similar_lengths("n_words", "lead_words", similarity))
        .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
        .distinct()
    )


def remaining_pairs(left: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different classes in the buckets of ``left``, which are small."""
    other = left.select("bucket", F.col("node").alias("b"), F.col("n_words").alias("nb"), F.col("class").alias("other"))
    return (
        left.join(other, "bucket")
        .where((F.col("node") < F.col("b")) & (F.col("class") != F.col("other")) & _similar_lengths("n_words", "nb", similarity))
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )


def mixed(met: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, n, leads, node, n_words, class) of the buckets that still hold several classes."""
    placed = met.join(labels, "node", "left").select("bucket", "n", "leads", "node", "n_words", F.coalesce("component", "node").alias("class"))
    placed = scratch.store(placed, "placed")
    name = F.xxhash64("class")
    several = placed.groupBy("bucket").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low != high")
    left = scratch.store(placed.join(several.select("bucket"), "bucket"), "mixed")
    scratch.drop(placed)
    return left


def hubs(left: DataFrame, links: DataFrame, asked: DataFrame | None) -> DataFrame:
    """(bucket, hub): the node of each bucket with the most links, among those that neither lead nor were asked before."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
    open_ = left.where("not leads").join(degrees, "node")
    if asked is not None:
        open_ = open_.join(asked, ["bucket", "node"], "left_anti")
    return open_.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n_words", "class")).alias("hub"))


def hub_pairs(left: DataFrame, best: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of each node and its bucket's hub, where they are in different classes."""
    return (
        left.join(best, "bucket")
        .where((F.col("class") != F.col("hub.class")) & _similar_lengths("n_words", "hub.n_words", similarity))
        .select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
        .distinct()
    )


def least_edits(bags: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Edits that every two texts need at least, by their bags."""
    apart = (np.maximum(bags[:, None], others[None]) - np.minimum(bags[:, None], others[None])).sum(2, dtype=np.int64)
    extra = np.abs(bags.sum(1, dtype=np.int64)[:, None] - others.sum(1, dtype=np.int64)[None])
    return (apart + extra) // 2  # words that one lacks, or the other: whichever are more


def dealt_blocks(left: DataFrame, bags: DataFrame, size: int = BLOCK) -> DataFrame:
    """(bucket, block, others, blocks, nodes): the nodes of each bucket, those of its largest class in the last blocks."""
    sizes = left.groupBy("bucket", "class").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "class")).alias("largest"))
    others, same = F.ceil((F.col("n") - F.col("largest.c")) / size).cast("int"), F.ceil(F.col("largest.c") / size).cast("int")
    place = F.xxhash64("node")
    block = F.when(F.col("class") == F.col("largest.class"), others + F.pmod(place, same)).otherwise(F.pmod(place, others))
    return (
        left.join(largest, "bucket")
        .join(bags, "node")
        .select("bucket", block.cast("int").alias("block"), others.alias("others"), (others + same).alias("blocks"), "node", "n_words", "class", "bag")
        .groupBy("bucket", "block")
        .agg(F.max("others").alias("others"), F.max("blocks").alias("blocks"), F.collect_list(F.struct("node", "n_words", "class", "bag")).alias("nodes"))
    )


def block_pairs(dealt: DataFrame, similarity: float, best: bool = False) -> DataFrame:
    """All pairs (a, b) of different classes in a bucket that their lengths and bags leave possible.

    With ``best``, one pair of every two classes: that of the least bound of edits.
    """
    # every two blocks have a key of their own, the first not of the largest class; a block also meets itself
    here = dealt.where("block < others").select(
        "bucket", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), "nodes"
    )
    there = dealt.select(
        "bucket", F.explode(F.expr("sequence(0, least(block, others - 1))")).alias("i"), F.col("block").alias("j"), F.col("nodes").alias("others")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows):
            nodes, bags = rows.field("node").to_pylist(), rows.field("bag").to_pylist()
            counts = np.frombuffer(b"".join(bags), np.uint8).reshape(len(nodes), BAG)
            return nodes, rows.field("n_words").to_numpy().astype(np.int64), rows.field("class").to_pylist(), counts

        for batch in slices(batches, 16):
            rows = []
            for mine, theirs in zip(batch.column("nodes"), batch.column("others")):
                a, la, ca, bag_a = block(mine.values)
                b, lb, cb, bag_b = block(theirs.values)
                number = {c: k for k, c in enumerate(sorted({*ca, *cb}))}
                ka, kb = np.array([number[c] for c in ca]), np.array([number[c] for c in cb])
                longest = np.maximum(la[:, None], lb[None])
                most = ((1 - similarity) * longest + 1e-9).astype(np.int64)
                apart = (ka[:, None] != kb[None]) & (np.abs(la[:, None] - lb[None]) <= most)
                if not apart.any():
                    continue
                bound = least_edits(bag_a, bag_b)
                i, j = np.nonzero(apart & (bound <= most))
                if best:
                    classes = np.minimum(ka[i], kb[j]) * len(number) + np.maximum(ka[i], kb[j])
                    order = np.lexsort((bound[i, j], classes))
                    order = order[np.unique(classes[order], return_index=True)[1]]
                    i, j = i[order], j[order]
                for x, y, edits in zip(i.tolist(), j.tolist(), bound[i, j].tolist()):
                    rows.append((min(a[x], b[y]), max(a[x], b[y]), min(ca[x], cb[y]), max(ca[x], cb[y]), edits))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (*[pa.binary()] * 4, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["a", "b", "low", "high", "bound"])

    met = here.join(there, ["bucket", "i", "j"]).select("nodes", "others")
    found = met.mapInArrow(run, "a binary, b binary, low binary, high binary, bound long")
    if best:
        found = found.groupBy("low", "high").agg(F.min(F.struct("bound", "a", "b")).alias("best")).select("best.a", "best.b")
    return found.select("a", "b").distinct()


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences, or None beyond ``most``."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if not n:
        rest = max(len(a), len(b))
        return rest if rest <= most else None
    apart = np.flatnonzero(a[-n:][::-1] != b[-n:][::-1])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        rest = max(len(a), len(b))
        return rest if rest <= most else None
    # words of one text that the other lacks need an edit each
    mine, counts = np.unique(a, return_counts=True)
    theirs, others = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - int(np.minimum(counts[i], others[j]).sum()) > most:
        return None
    return _band(a, b, most)


def _run_length(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """How far both sequences agree from x and y on."""
    at, width = 0, 32
    while True:
        n = min(width, len(a) - x - at, len(b) - y - at)
        if n <= 0:
            return at
        apart = a[x + at : x + at + n] != b[y + at : y + at + n]
        if apart.any():
            return at + int(apart.argmax())
        at, width = at + n, width * 2


def _band(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Furthest points by diagonal (place in b less place in a) for 0, 1, 2, ... edits."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return None
    reach = np.full(2 * most + 3, -2, np.int64)  # diagonal k is at k + most + 1
    middle = most + 1
    reach[middle] = _run_length(a, b, 0, 0)
    if goal == 0 and reach[middle] >= n:
        return 0
    for edits in range(1, most + 1):
        low, high = max(-edits, goal - (most - edits)), min(edits, goal + (most - edits))
        if low > high:
            return None
        k = np.arange(low, high + 1)
        at = k + middle
        x = np.maximum(np.maximum(reach[at - 1], reach[at] + 1), reach[at + 1] + 1)
        x = np.minimum(np.minimum(x, n), m - k)
        open_ = np.flatnonzero((x >= 0) & (x + k >= 0) & (x < n) & (x + k < m))
        for _ in range(3):
            open_ = open_[a[x[open_]] == b[x[open_] + k[open_]]]
            x[open_] += 1
            open_ = open_[(x[open_] < n) & (x[open_] + k[open_] < m)]
            if not len(open_):
                break
        for i in open_.tolist():
            x[i] += _run_length(a, b, int(x[i]), int(x[i] + k[i]))
        reach[at] = np.where(x + k >= 0, x, -2)
        if low <= goal <= high and reach[goal + middle] >= n:
            return edits
    return None


def verified(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose alignment is similar enough; ``words`` has (node, words) of every node in them."""
    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(
        words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            first, second = batch.column("wa"), batch.column("wb")
            fv, sv = first.values.to_numpy(), second.values.to_numpy()
            fo, so = first.offsets.to_numpy().tolist(), second.offsets.to_numpy().tolist()
            for i in range(batch.num_rows):
                x, y = fv[fo[i] : fo[i + 1]], sv[so[i] : so[i + 1]]
                most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                if edit_distance_within(x, y, most) is not None:
                    keep.append(i)
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], names=["a", "b"])

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def words_of_nodes(docs: DataFrame, carriers: DataFrame, key: str, text: str) -> DataFrame:
    """(node, words) of the nodes in ``carriers`` (node, id, own): words as 32-bit hashes, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(word_hashes(raw)[2] >> np.uint64(32)).astype(np.uint32).view(np.int32) for raw in utf8_rows(batch.column(text))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=["node", "words"]
            )

    rows = docs.select(F.col(key).cast("long").alias("_id"), text_digest(text).alias("_own"), text)
    carrier = carriers.select("node", F.col("id").alias("_node_id"), F.col("own").alias("_node_own"))
    joined = rows.join(carrier, (F.col("_own") == F.col("_node_own")) & F.col("_id").eqNullSafe(F.col("_node_id"))).select("node", text)
    # only rows that repeat, id and text, are more than one of a node
    return joined.mapInArrow(run, "node binary, words array<int>").dropDuplicates(["node"])


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES
) -> DataFrame:
    """(doc_id, class_id) of every row; ``doc_id`` by the name of ``key``."""
    placed = placed_rows(docs, key, text, similarity, sketches)
    least = placed.groupBy("class").agg(F.min("id").alias("class_id"))
    return placed.join(least, "class").select(F.col("id").alias(key), "class_id")


def placed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES
) -> DataFrame:
    """(id, own, class) of every row, stored."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = scratch.store(signatures(docs, key, text, similarity, sketches), "signatures")
    nodes = rows.groupBy("node").agg(
        F.min(F.struct("id", "own")).alias("carrier"), F.first("n_words").alias("n_words"), F.first("bag").alias("bag"), F.first("sketches").alias("sketches")
    )
    nodes = scratch.store(nodes.select("node", "carrier.id", "carrier.own", "n_words", "bag", "sketches"), "nodes")
    met = scratch.store(crowds(nodes.select("node", "n_words", F.explode("sketches").alias("bucket"))), "met")
    company = met.select("node").distinct()
    words = scratch.store(words_of_nodes(docs, nodes.select("node", "id", "own").join(company, "node"), key, text), "words")
    links, known, labels = None, None, None

    def compare(pairs: DataFrame) -> bool:
        """Verifies pairs not compared before and brings the classes up to date; whether a link was found."""
        nonlocal links, known, labels
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = scratch.store(pairs, "pairs")
        known = pairs if known is None else known.union(pairs)
        found = scratch.store(verified(pairs, words, similarity), "verified")
        if labels is None:
            links, labels = found, scratch.store(components(found), "labels")
            return True
        if not found.limit(1).count():
            return False
        before, links = labels, links.union(found)
        labels = merged(before, found, scratch)
        scratch.drop(before)
        return True

    def remix(table: DataFrame) -> DataFrame:
        """The buckets of ``table`` that are still mixed; the table goes."""
        fresh = mixed(table, labels, scratch)
        scratch.drop(table)
        return fresh

    compare(led_pairs(met, similarity))
    left = remix(met)
    small = left.where(F.col("n") <= PAIRED)
    large = scratch.store(left.where(F.col("n") > PAIRED), "large")
    if small.limit(1).count():
        compare(remaining_pairs(small, similarity))
    scratch.drop(left)
    large, asked = remix(large), None
    for _ in range(HUBS):
        best = scratch.store(hubs(large, links, asked), "hubs")
        if not best.limit(1).count() or not compare(hub_pairs(large, best, similarity)):
            break
        called = best.select("bucket", "hub.node")
        asked = called if asked is None else asked.union(called)
        large = remix(large)
    for best in (*[True] * BEST, False):
        if not large.limit(1).count():
            break
        dealt = scratch.store(dealt_blocks(large, nodes.select("node", "bag")), "blocks")
        found = compare(block_pairs(dealt, similarity, best))
        if best and not found:  # the classes are as before
            compare(block_pairs(dealt, similarity))
        if not (best and found):
            break
        large = remix(large)
        scratch.drop(dealt)
    placed = rows.select("id", "own", "node").join(labels, "node", "left").select("id", "own", F.coalesce("component", "node").alias("class"))
    placed = scratch.store(placed, "classes")
    scratch.drop_others(placed)
    return placed


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of every class: that of the least id (null last), then of the least digest, and one of equal rows."""
    placed = placed_rows(docs, key, text, **options)
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "own")).alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("own") == F.col("first.own"))
    gone = placed.join(first, "class").where(~stays).select(F.col("id").alias("_gone"), F.col("own").alias("_gone_own")).distinct()
    row, digest = F.col(key).cast("long"), text_digest(text)
    kept = docs.join(gone, row.eqNullSafe(F.col("_gone")) & (digest == F.col("_gone_own")), "left_anti")
    repeated = placed.groupBy("id", "own").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    names = [f"_same{i}_{'_'.join(docs.columns)}" for i in range(2)]  # no column's name
    return kept.withColumn(names[0], row).withColumn(names[1], digest).dropDuplicates(names).drop(*names)

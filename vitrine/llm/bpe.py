"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

The bytes of a piece are mapped to Latin-1 characters, so that an Aho-Corasick automaton
over the vocabulary gives the longest token at every place in one pass.  The encoder takes
longest tokens from left to right; a token may follow another only if no merge would have
crossed their border (memoised per pair), else it tries the next shorter token, and steps
back over the last one where none is left.  A place left that way is never tried again, so
the work stays linear in the piece.  The result is that of the merges, token for token.

Pieces are the matches of the pattern.  Texts are cut before single spaces first, where no
match of the pattern can straddle, and equal cuttings are encoded once per worker (a bounded
memo, not a bound on the work).

Null and empty texts have no ids and decode to no bytes.  Repeated rows repeat their ids.
The input's columns are kept; one named as a result is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.common import slices

#: Entries in each generation of a worker's memos of cuttings and pieces, and in its memo of token pairs.
MEMO, PAIRS = 200_000, 400_000
_NEVER = 1 << 40
_NOTHING: dict[int, bool] = {}
_SPACES = re.compile(r" \s")
_CUT = re.compile(r"(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The plain definition: merge the adjacent pair of least rank until no pair is a token below ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks with the halves of every token; small enough to broadcast, as the vocabulary file is."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.whole: set[int] = set()  # tokens that the merges never make, only a piece that equals them
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            if len(token) > 1:
                halves = _merge(token, ranks, rank)
                if len(halves) == 2 and all(h in ranks for h in halves):
                    self.left[rank], self.right[rank] = ranks[halves[0]], ranks[halves[1]]
                else:
                    self.whole.add(rank)


class Encoder:
    """Encodes pieces; one per worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.ranks.items():
            if rank not in vocabulary.whole:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.size_of = [len(token) for token in vocabulary.bytes_of]
        self.fitting: dict[int, dict[int, bool]] = {}
        self.n_fitting = 0
        self.shorter: dict[int, int] = {}
        self.pieces = _Generations(self._pack_piece)
        self.memo = _Generations(self._pack_cutting)

    def fits(self, left: int, right: int) -> bool:
        """Whether the tokens can stand side by side: going back through their merges, latest first,
        no pair across the border may have been a token of lower rank than the merges still to come.
        Kept for the next time."""
        if self.n_fitting >= PAIRS:
            self.fitting, self.n_fitting = {}, 0
        known = self._fits(left, right)
        self.fitting.setdefault(left, {})[right] = known
        self.n_fitting += 1
        return known

    def _fits(self, left: int, right: int) -> bool:
        v, bound = self.v, _NEVER
        while True:
            if v.ranks.get(v.bytes_of[left] + v.bytes_of[right], _NEVER) < bound:
                return False
            first = left > right
            if first and v.left[left] >= 0 or not first and v.left[right] < 0 <= v.left[left]:
                bound, left = left, v.right[left]
            elif v.left[right] >= 0:
                bound, right = right + 1, v.left[right]
            else:
                return True

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.shorter.get(token)
        if known is None:
            raw, known = self.v.bytes_of[token], -1
            for n in range(len(raw) - 1, 0, -1):
                rank = self.v.ranks.get(raw[:n], -1)
                if rank >= 0 and rank not in self.v.whole:
                    known = rank
                    break
            self.shorter[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size_of = len(piece), self.size_of
        longest = [-1] * (n + 1)
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # later ends are longer
        out: list[int] = []
        dead, any_dead = bytearray(n + 1), False
        at, token, beside = 0, longest[0], None
        while at < n:
            # beside: what is known of tokens after the last one; None at the start, where any may stand
            while token >= 0:
                stop = at + size_of[token]
                if not (any_dead and dead[stop]):
                    if beside is None:
                        break
                    fitting = beside.get(token)
                    if fitting or fitting is None and self.fits(out[-1], token):
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, beside, token = stop, self.fitting.get(token, _NOTHING), longest[stop]
            elif out:
                dead[at], any_dead = 1, True
                token = out.pop()
                at -= size_of[token]
                beside = self.fitting.get(out[-1], _NOTHING) if out else None
                token = self.next_shorter(token)
            else:
                raise ValueError("a byte of the text is not in the vocabulary")
        return out

    def rest(self) -> None:
        """Between tasks a worker keeps the young generations only."""
        self.pieces.old, self.memo.old = {}, {}

    def _pack_piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def _pack_cutting(self, cutting: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(cutting)))

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if text[-1] == " " or _SPACES.search(text):
            cuttings = _CUT.split(text)
        else:
            first, *others = text.split(" ")
            cuttings = [first, *[" " + x for x in others]]
        return b"".join(map(self.memo.__getitem__, cuttings))


class _Generations(dict):
    """A memo of two generations: a full one becomes the old one, from which entries come back on use."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_vocabularies: dict[tuple[str, str], Vocabulary] = {}
_encoders: dict[int, Encoder] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(read_ranks(path), pattern)
    return _vocabularies[path, pattern]


def _encoder(known) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; workers are reused between tasks."""
    if known.id not in _encoders:
        _encoders.clear()
        _encoders[known.id] = Encoder(known.value)
    return _encoders[known.id]


class _Shared:
    """A broadcast variable with an id of its own that the workers can tell apart."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _share(df: DataFrame, words: Vocabulary) -> _Shared:
    broadcast = df.sparkSession.sparkContext.broadcast(words)
    return _Shared(broadcast, broadcast._jbroadcast.id())


def decode_ids(ids: bytes | None, words: Vocabulary) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(words.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(docs: DataFrame, words: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Every row with the binary column ``ids``: little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded in the same pass, into that column, as ``decode`` would.
    """
    added = [ids] if decoded is None else [ids, decoded]
    docs = docs.drop(*added)
    shared = _share(docs, words)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.BinaryType(), False) for name in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in slices(batches):
            packed = [encoder.packed(x or "") for x in batch.column(text).to_pylist()]
            found = [packed] if decoded is None else [packed, [decode_ids(x, encoder.v) for x in packed]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x, pa.binary()) for x in found]], names=[*batch.schema.names, *added]
            )
        encoder.rest()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, words: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the binary column ``decoded``: the bytes that its ids stand for."""
    rows = rows.drop(decoded)
    shared = _share(rows, words)
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            texts = [decode_ids(x, known) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, decoded]
            )

    return rows.mapInArrow(run, schema)

"""SentencePiece BPE encoding by longest matches and backtracking, and decoding.

The model's merges join the adjacent pair of highest score, leftmost first, until no
joined pair is a piece.  Here the same result comes without merging: an Aho-Corasick
automaton over the pieces gives the longest piece at every place in one pass, and pieces
are taken from left to right.  A piece may follow another only if merging the two strings
again leaves exactly these two (memoised per pair); else the next shorter one is tried, and
where none is left the last piece is taken back.  A place given up that way is marked in a
bitfield and never tried again, so the work stays linear in the text.

White space becomes the mark of a word start, with one mark before the text.  No piece holds
a mark behind another character, so no merge crosses the start of a word; texts are cut
there and equal words are encoded once per worker (a bounded memo, not a bound on the work).
A model whose pieces break this rule is encoded in one stretch.  A character that no piece
holds becomes the ids of its UTF-8 bytes, or the unknown id if the model has no byte pieces.

Null and empty texts have no ids and decode to the empty string.  Repeated rows repeat
their ids.  The input's columns are kept; one named as a result is replaced.
"""

from __future__ import annotations

import codecs
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.common import slices

MARK = "▁"
#: Entries in each generation of a worker's memo of words, and in its memo of piece pairs.
WORDS, PAIRS = 250_000, 400_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = 1 << 40
_NOTHING: dict[int, bool] = {}


@dataclass
class Model:
    """Pieces with scores and kinds; as small as its file, so that it can be broadcast."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unknown_text: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


_models: dict[str, Model] = {}


def read_model(path: str) -> Model:
    """The BPE model of a file; one that changes texts before the merges is refused."""
    if path not in _models:
        from sentencepiece import sentencepiece_model_pb2 as files

        proto = files.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trained, normal = proto.trainer_spec, proto.normalizer_spec
        if trained.model_type != 2 or trained.treat_whitespace_as_suffix:
            raise ValueError("not a BPE model with marks before words")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
            raise ValueError("the model rewrites characters or white space")
        kinds = [p.type for p in proto.pieces]
        if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model has pieces defined by its user, or unused ones")
        _models[path] = Model([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kinds, trained.unk_surface)
    return _models[path]


class Merges:
    """The plain definition, and what follows from it for single pieces."""

    def __init__(self, model: Model):
        normal = [i for i, kind in enumerate(model.kinds) if kind == _NORMAL]
        self.pieces = model.pieces
        self.id_of = {model.pieces[i]: i for i in normal}
        levels = {score: n for n, score in enumerate(sorted({model.scores[i] for i in normal}, reverse=True))}
        self.rank = {model.pieces[i]: levels[model.scores[i]] for i in normal}
        count = np.bincount(list(self.rank.values()), minlength=1)
        self.tied = {p for p, r in self.rank.items() if count[r] > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.unmade: set[str] = set()
        for piece in sorted(self.rank, key=lambda p: (self.rank[p], len(p))):
            if len(piece) > 1:
                last: list[tuple[str, str]] = []
                if self.merge(piece, last) == [piece]:
                    self.halves[piece] = last[-1]
                else:
                    self.unmade.add(piece)

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Join the pair of least rank, leftmost first, until no pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
            if rank == _NONE:
                break
            if steps is not None:
                steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` again leaves the two.

        Only merges across the border can spoil that.  The merges of both sides are undone
        latest first; at each state no pair across the border may come before the merge
        just undone.  Pieces of equal rank are merged in full, as places decide then.
        """
        if left in self.tied and right in self.tied:
            return self.merge(left + right) == [left, right]
        bound, strict = _NONE, True
        while True:
            across = self.rank.get(left + right, _NONE)
            # of equal ranks the leftmost pair goes first: the border, if the undone merge was on its right
            if across < bound or not strict and across == bound:
                return False
            a, b = (self.rank[p] if p in self.halves else -1 for p in (left, right))
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal ranks the right one was merged later
                bound, left, strict = a, self.halves[left][1], True
            else:
                bound, right, strict = b, self.halves[right][0], False


class Encoder:
    """Encodes and decodes; one per worker process."""

    def __init__(self, model: Model):
        self.merges = m = Merges(model)
        self.pieces = model.pieces
        # characters that occur only inside pieces take part in merges, and have no id when left alone
        inner = sorted({c for p in m.rank for c in p} - set(m.rank))
        self.text_of = [*model.pieces, *inner]
        self.size_of = [len(t) for t in self.text_of]
        byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == _BYTE}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == _UNKNOWN), 0)
        self.alone = {len(model.pieces) + n: self.fallback(c) for n, c in enumerate(inner)}
        self.taken = {p: i for p, i in m.id_of.items() if p not in m.unmade} | {c: len(model.pieces) + n for n, c in enumerate(inner)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.taken.items():
            self.automaton.add_word(piece, (i, len(piece) - 1))
        if self.taken:
            self.automaton.make_automaton()
        marked = any(MARK in p.lstrip(MARK) for p in m.rank)
        self.cut = (lambda text: [text]) if marked else re.compile(f"{MARK}+[^{MARK}]*").findall
        self.fitting: dict[int, dict[int, bool]] = {}
        self.n_fitting = 0
        self.shorter: dict[int, int] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else model.unknown_text.encode() if k == _UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(model.pieces, model.kinds)
        ]
        self.opening = [k == _NORMAL for k in model.kinds]

    def fallback(self, char: str) -> list[int]:
        return [self.unknown] if self.byte_ids is None else [self.byte_ids[b] for b in char.encode()]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; kept for the next time."""
        if self.n_fitting >= PAIRS:
            self.fitting, self.n_fitting = {}, 0
        known = self.merges.fit(self.text_of[left], self.text_of[right])
        self.fitting.setdefault(left, {})[right] = known
        self.n_fitting += 1
        return known

    def next_shorter(self, token: int) -> int:
        """The longest piece that is a proper prefix, or -1."""
        known = self.shorter.get(token)
        if known is None:
            text = self.text_of[token]
            known = self.shorter[token] = next((self.taken[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.taken), -1)
        return known

    def tokens(self, word: str) -> list[int]:
        """Pieces of a stretch of text by number; ``~code point`` for characters of no piece."""
        whole = self.taken.get(word)
        if whole is not None:
            return [whole]
        n, size_of = len(word), self.size_of
        longest = [-1] * (n + 1)
        for end, (token, back) in self.automaton.iter(word) if self.taken else ():
            longest[end - back] = token  # later ends are longer
        out: list[int] = []
        failed, any_failed = bytearray(n // 8 + 1), False
        at, token, beside = 0, longest[0], None
        while at < n:
            # beside: what is known of pieces after the last one; None where any may follow
            while token >= 0:
                stop = at + size_of[token]
                if not (any_failed and failed[stop >> 3] >> (stop & 7) & 1):
                    if beside is None:
                        break
                    fitting = beside.get(token)
                    if fitting or fitting is None and self.fits(out[-1], token):
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, beside, token = stop, self.fitting.get(token, _NOTHING), longest[stop]
                continue
            if longest[at] < 0:  # no piece crosses such a character
                out.append(~ord(word[at]))
                at, beside = at + 1, None
                token = longest[at]
                continue
            failed[at >> 3] |= 1 << (at & 7)
            any_failed = True
            last = out.pop()
            at -= size_of[last]
            token = self.next_shorter(last)
            beside = self.fitting.get(out[-1], _NOTHING) if out and out[-1] >= 0 else None
        return out

    def word_ids(self, word: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(word):
            if token < 0:
                ids += self.fallback(chr(~token))
            elif token in self.alone:
                ids += self.alone[token]
            else:
                ids.append(token)
        return array("i", ids).tobytes()

    def _new(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.word_ids(word)
        if len(word) < 64:
            if len(self.young) >= WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = value
        return value

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        known, new = self.young.get, self._new
        return b"".join([known(word) or new(word) for word in self.cut(MARK + text.replace(" ", MARK))])

    def rest(self) -> None:
        """Between tasks a worker keeps the young generation only."""
        self.old = {}

    def decoded(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, but for the one before the text; a byte that is no UTF-8 becomes U+FFFD."""
        pieces = list(map(self.bytes_of.__getitem__, ids))
        first = next((i for i, piece in enumerate(pieces) if piece), None)
        if first is not None and self.opening[ids[first]] and pieces[first][:1] == b" ":
            pieces[first] = pieces[first][1:] or None
        if b"" not in pieces:
            return b"".join(filter(None, pieces)).decode("utf-8", "one_by_one")
        # bytes on both sides of a control id are no character together
        text, run = [], []
        for piece in (*pieces, b""):
            if piece == b"":
                text.append(b"".join(run).decode("utf-8", "one_by_one"))
                run = []
            elif piece:
                run.append(piece)
        return "".join(text)


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))

_encoders: dict[str, Encoder] = {}


def _encoder(broadcast, key: str) -> Encoder:
    """The worker's encoder of a broadcast model; workers are reused between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(broadcast.value)
    return _encoders[key]


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "i4")))


def encode(docs: DataFrame, model: Model, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Every row with the column ``ids`` (array of int).

    With ``decoded`` the ids are decoded in the same pass, into that column, as ``decode`` would.
    """
    added = [ids] if decoded is None else [ids, decoded]
    docs = docs.drop(*added)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key
    kinds = {ids: T.ArrayType(T.IntegerType(), True), decoded: T.StringType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kinds[name]) for name in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, key)
        for batch in slices(batches):
            packed = [encoder.packed(x or "") for x in batch.column(text).to_pylist()]
            found = [_id_lists(packed)]
            if decoded is not None:
                found.append(pa.array([encoder.decoded(np.frombuffer(p, "i4").tolist()) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *added])
        encoder.rest()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the string column ``decoded``; a null list and an empty one decode to the empty string."""
    rows = rows.drop(decoded)
    shared, key = rows.sparkSession.sparkContext.broadcast(model), model.key
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, key)
        for batch in slices(batches):
            texts = [encoder.decoded(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return rows.mapInArrow(run, schema)

"""Language identification: the family first, then the language within it.

Texts become hashed counts of byte trigrams over letters (square roots, unit length).  One
linear SVM per family, against the rest, picks the family; within it one-versus-one linear
SVMs vote, ties going to the larger sum of margins.  Margins turn into probabilities by a
scale fitted on a held-back fifth of the rows; the score is the family's probability
times the least probability of the language's pairs.

The classifier is fitted on all rows allowed for learning, unless ``per_language`` asks for a
hash sample: their trigram counts are stored once, and every step of an accelerated gradient
descent adds up the slopes of all rows in the tasks that read them.  Prediction reads every
whole text.  Language, source and id are no inputs of a prediction.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
could be learned.  Rows without an id or a language teach nothing.  Repeated rows get equal
results.  The input's columns are kept; one named as a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import STRETCH, added, fixed, slices, utf8_rows
from vitrine.session import Scratch

BINS = 1 << 12
UNDETERMINED = "und"

# ISO 639-1 codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "sinitic": "zh",
    "austronesian": "id jv ms su tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split(" ")}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def _letter_table() -> np.ndarray:
    """Byte -> code: ASCII letters without case 1-26, bytes of other characters above that, the rest 0."""
    codes = np.zeros(256, np.uint32)
    for first in (0x41, 0x61):
        codes[first : first + 26] = np.arange(1, 27)
    codes[0x80:] = np.arange(27, 27 + 128)
    return codes


_LETTER = _letter_table()


def trigram_counts(text: np.ndarray) -> np.ndarray:
    """Hashed trigram counts of a whole text."""
    counts = np.zeros(BINS)
    for at in range(0, max(len(text) - 2, 1), STRETCH):
        codes = _LETTER[text[at : at + STRETCH + 2]]
        if len(codes) < 3:
            codes = np.concatenate((codes, np.zeros(3 - len(codes), np.uint32)))
        triple = (codes[:-2] * np.uint32(160) + codes[1:-1]) * np.uint32(160) + codes[2:]
        some = triple[triple != 0]
        counts += np.bincount((some * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    return counts


def features(text: np.ndarray) -> np.ndarray:
    """The counts of a text, square-rooted and of unit length."""
    counts = trigram_counts(text)
    root = np.sqrt(counts)
    size = np.sqrt(counts.sum())
    return (root / size if size else root).astype(np.float32)


def has_letter(text: np.ndarray) -> bool:
    codes = _LETTER[text]
    if ((codes > 0) & (codes < 27)).any():
        return True
    return bool(codes.any()) and any(c.isalpha() for c in text.tobytes().decode())


@dataclass
class Model:
    families: list[str]
    languages: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a column per family, then one per pair
    scales: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights
        sure = 1 / (1 + np.exp(-np.clip(margins * self.scales, -60, 60)))
        n = len(self.families)
        family = margins[:, :n].argmax(1)
        score = sure[np.arange(len(x)), family]
        votes = np.zeros((len(x), len(self.languages)))
        sums, least = np.zeros_like(votes), np.ones_like(votes)
        for k, (a, b) in enumerate(self.pairs, n):
            votes[:, a] += margins[:, k] > 0
            votes[:, b] += margins[:, k] <= 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
            least[:, a] = np.minimum(least[:, a], sure[:, k])
            least[:, b] = np.minimum(least[:, b], 1 - sure[:, k])
        within = np.array([self.families.index(family_of(x)) for x in self.languages])
        standing = np.where(within[None, :] == family[:, None], votes + np.tanh(sums) / 4, -np.inf)
        best = standing.argmax(1)
        return [self.languages[i] for i in best], score * least[np.arange(len(x)), best]


# regularisation of the SVMs, and steps of the descent, each a pass over the stored counts
C = 8.0
STEPS = 24
_SCALES = np.geomspace(0.5, 32, 25)


def _tasks(languages: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """The families, the pairs of languages within them, and the side (1, -1 or 0) of every language in every SVM."""
    families = sorted({family_of(c) for c in languages})
    sides = [[1 if family_of(c) == f else -1 for c in languages] for f in families]
    pairs = []
    for a in range(len(languages)):
        for b in range(a + 1, len(languages)):
            if family_of(languages[a]) == family_of(languages[b]):
                pairs.append((a, b))
                sides.append([1 if i == a else -1 if i == b else 0 for i in range(len(languages))])
    return families, pairs, np.array(sides, np.float32).T


def learning_rows(docs: DataFrame, allowed: Column, per_language: int | None = None) -> DataFrame:
    """The allowed rows with an id, a language and a text, or a hash sample of about ``per_language`` of each language."""
    known = docs.where(allowed & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if per_language is None:
        return known
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(part)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.where(draw < part)


def _counted(rows: DataFrame) -> DataFrame:
    """``(lang, held, bins, counts)`` of every text with a letter; the lists hold the trigrams that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, bins, counts = [], [], []
            for i, text in enumerate(utf8_rows(batch.column("text"))):
                if has_letter(text):
                    all_counts = trigram_counts(text)
                    some = np.flatnonzero(all_counts)
                    keep.append(i)
                    bins.append(some.astype(np.uint16).tobytes())
                    counts.append(all_counts[some].astype(np.uint32).tobytes())
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(kept), batch.column("held").take(kept), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())],
                names=["lang", "held", "bins", "counts"],
            )

    held = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("held")
    return rows.select("lang", held, "text").mapInArrow(run, "lang string, held boolean, bins binary, counts binary")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Stored counts as ``features``."""
    x = np.zeros((batch.num_rows, BINS), np.float32)
    for row, bins, counts in zip(x, batch.column("bins").to_pylist(), batch.column("counts").to_pylist()):
        values = np.frombuffer(counts, np.uint32)
        row[np.frombuffer(bins, np.uint16)] = np.sqrt(values) / np.sqrt(max(1, values.sum(dtype=np.int64)))
    return x


def _summed(rows: DataFrame, languages: list[str], weights: np.ndarray, each: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``each(vectors, languages' numbers, margins)`` over all stored rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            if batch.num_rows:
                x = _vectors(batch)
                number = np.searchsorted(languages, batch.column("lang").to_pylist())
                one = fixed(each(x, number, x @ shared.value).ravel())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = added(rows.select("lang", "bins", "counts").mapInArrow(run, "sums binary"))
    shared.destroy()
    return total


def _descended(rows: DataFrame, languages: list[str], sides: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A linear SVM with squared hinge loss per task, a column each; both sides weigh the same.

    Accelerated gradient descent for a function whose curvature lies between those of its two terms.
    """
    total = [np.maximum(1.0, ((sides == side) * counts[:, None]).sum(0)) for side in (1, -1)]
    weight = np.where(sides > 0, 0.5 / total[0], np.where(sides < 0, 0.5 / total[1], 0))

    def slopes(x: np.ndarray, number: np.ndarray, margins: np.ndarray) -> np.ndarray:
        side = sides[number]
        return x.T @ (weight[number] * np.maximum(0, 1 - side * margins) * side).astype(np.float32)

    low, high = 1.0 / C, 1.0 / C + 2.0
    onward = (1 - (low / high) ** 0.5) / (1 + (low / high) ** 0.5)
    w = np.zeros((BINS, sides.shape[1]))
    ahead = w
    for _ in range(STEPS):
        slope = ahead / C - 2 * _summed(rows, languages, ahead.astype(np.float32), slopes).reshape(w.shape)
        moved = ahead - slope / high
        ahead, w = moved + onward * (moved - w), moved
    return w.astype(np.float32)


def _scaled(rows: DataFrame, languages: list[str], sides: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per task, the factor that makes the logistic function of the margin the likeliest probability; 1 without rows."""
    total = (np.abs(sides) * counts[:, None]).sum(0)

    def losses(x: np.ndarray, number: np.ndarray, margins: np.ndarray) -> np.ndarray:
        side = sides[number]
        share = np.abs(side) / np.maximum(1, total)
        return np.stack([(share * np.logaddexp(0, -scale * margins * side)).sum(0) for scale in _SCALES])

    found = _summed(rows, languages, weights, losses) if total.any() else None
    if found is None:
        return np.ones(sides.shape[1])
    return np.where(total > 0, _SCALES[found.reshape(len(_SCALES), -1).argmin(0)], 1.0)


def fit(docs: DataFrame, allowed: Column, per_language: int | None = None) -> Model | None:
    """All SVMs by the rows that may teach, but a held-back fifth, which gives the scales; None without rows.

    Neither texts nor counts reach the driver, only sums over all rows.
    """
    scratch = Scratch(docs.sparkSession, "language")
    rows = scratch.store(_counted(learning_rows(docs, allowed, per_language)), "trigrams")
    counts = {(r.lang, r.held): r["count"] for r in rows.groupBy("lang", "held").count().collect()}  # two rows per language
    model = None
    if counts:
        languages = sorted({lang for lang, _ in counts})
        families, pairs, sides = _tasks(languages)
        own, held = (np.array([counts.get((lang, side), 0) for lang in languages]) for side in (False, True))
        learning = ~F.col("held")
        alone = [lang for lang, n in zip(languages, own) if not n]
        if alone:  # all of its few rows would be held back
            learning |= F.col("lang").isin(alone)
            own, held = np.where(own == 0, held, own), np.where(own == 0, 0, held)
        weights = _descended(rows.where(learning), languages, sides, own)
        model = Model(families, languages, pairs, weights, _scaled(rows.where(~learning), languages, sides, held, weights))
    scratch.drop_others()
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            languages, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            rows, found = [], []
            for i, raw in enumerate(utf8_rows(batch.column(text))):
                if known is not None and has_letter(raw):
                    rows.append(i)
                    found.append(features(raw))
                if found and (len(found) == 512 or i == batch.num_rows - 1):
                    _fill(known, rows, found, languages, scores)
                    rows, found = [], []
            if found:
                _fill(known, rows, found, languages, scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def _fill(model: Model, rows: list[int], found: list[np.ndarray], languages: list[str], scores: np.ndarray) -> None:
    predicted, score = model.predict(np.stack(found))
    for i, language in zip(rows, predicted):
        languages[i] = language
    scores[rows] = score

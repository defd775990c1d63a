"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Base findings are the leftmost non-overlapping matches of three fixed patterns.  Candidates
are all maximal runs of 16 or more characters of keys (letters, digits, ``+/_=-`` and inner
dots) that hold a digit and a letter and lie outside the base findings; of a run that touches
base findings, the parts outside them are candidates if they are such runs themselves.  The
network reads 48 characters of a candidate with 24 characters before and 8 after them, one
column of 32 character kinds each; one convolution of width 5, maximum over the window and over
the value, and a logistic output.  The window slides over a longer candidate in steps of 24
(the last one ends with it), and the candidate counts as its surest window.  It is trained on
labelled findings of the corpus: candidates inside base findings are positive, long runs
elsewhere (addresses, numbers, plain long words) negative, window by window, while parts of runs
beside base findings teach nothing; the context of half of the positives is blanked so that the
value itself must tell.
Margins are calibrated by a logistic fit, and the threshold is the highest that keeps the
asked recall on held-back findings.  It is never raised for precision: the negatives may be
secrets that no pattern knows.  ``Network.recall`` and ``Network.precision`` tell what it
reaches on the held-back findings.

All distinct findings of all rows teach: they are dealt to parts of about ``per_part`` findings
of each label, every part is gone through in each of ``ROUNDS`` rounds that start from the mean of
the networks of the round before, and a fifth of the findings is held back.  A label with fewer
findings fills fewer lists, which several parts share.  Calibration and threshold read all of the
held-back findings; the calibration takes their margins in steps of 0.01, the threshold is exact.
The scan covers every candidate of every whole text.

Null and empty texts have no spans.  Without any positive or negative finding there is
nothing to learn, and only base findings are reported.  Spans are code points, end
exclusive.  Repeated rows repeat their spans.  The input's columns are kept; one named
``findings`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import added, fixed, slices
from vitrine.session import Scratch

KINDS = ("assign", "access", "hex", "model")
# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-])")

BEFORE, VALUE, AFTER = 24, 48, 8
STRIDE = 24
WIDTH = BEFORE + VALUE + AFTER
FILTERS, SPAN, CHANNELS = 24, 5, 32
RECALL = 0.98
# findings of each label in a part, rounds over all parts, and steps of a round in a part, at least
PER_PART = 2000
ROUNDS, STEPS = 8, 50
# values among which the one of a rank is picked in the driver
_PICKED = 10_000

FINDINGS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]),
    False,
)


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(finding: tuple[int, int, str]) -> tuple[int, int]:
    return finding[0], KINDS.index(finding[2])


_HAS_DIGIT = re.compile(r"[0-9]")
_HAS_LETTER = re.compile(r"[A-Za-z]")


def candidates(text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Candidate spans outside the base findings, and those inside them."""
    outside, inside = [], []
    for m in CANDIDATE.finditer(text):
        if any(a < m.end() and m.start() < b for a, b, _ in base):
            inside.append(m.span())
        elif _HAS_DIGIT.search(text, *m.span()) and _HAS_LETTER.search(text, *m.span()):
            outside.append(m.span())
    return outside, inside


def remainders(text: str, base: list[tuple[int, int, str]], inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate spans in the parts of runs that the base findings touching them leave over."""
    found = []
    for start, end in inside:
        at = start
        for a, b in [*((a, b) for a, b, _ in base if a < end and start < b), (end, end)]:
            # the pattern itself trims dots; its look-behind must not see the finding before
            for m in CANDIDATE.finditer(text[at : max(at, a)]):
                if _HAS_DIGIT.search(m[0]) and _HAS_LETTER.search(m[0]):
                    found.append((at + m.start(), at + m.end()))
            at = max(at, b)
    return found


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """Spans of up to ``VALUE`` characters that cover a candidate."""
    if end - start <= VALUE:
        return [(start, end)]
    return [(at, at + VALUE) for at in [*range(start, end - VALUE, STRIDE), end - VALUE]]


def _kind_table() -> np.ndarray:
    """ASCII character -> kind 1-31; other characters are 31, padding 0."""
    table = np.full(128, 30, np.uint8)
    groups = ["0", "123456789"[:4], "56789", "abcdef", "ghijklm", "nopqrs", "tuvwxyz", "ABCDEF", "GHIJKLM", "NOPQRS", "TUVWXYZ"]
    groups += ["+", "/", "_", "=", "-", ".", ",", ":", ";", '"', "'", "@", " ", "\n", "\t", "()[]{}", "<>", "#$%&*!?", "|\\^~`"]
    for i, group in enumerate(groups, 1):
        for c in group:
            table[ord(c)] = i
    return table


_KIND = _kind_table()


def window_of(text: str, start: int, end: int) -> bytes:
    """Character kinds around and in a candidate, ``WIDTH`` of them."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    value = text[start : min(end, start + VALUE)].ljust(VALUE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.frombuffer((before + value + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 128, _KIND[np.minimum(codes, 127)], 31)
    return np.where(codes == 0, 0, kinds).astype(np.uint8).tobytes()


@dataclass
class Network:
    """Convolution, rectifier, maxima over the whole window and over the value, logistic output."""

    filters: np.ndarray  # SPAN * CHANNELS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    slope: float = 1.0  # calibration
    offset: float = 0.0
    threshold: float = 1.0
    recall: float = 0.0  # on held-back findings
    precision: float = 0.0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        one_hot = np.eye(CHANNELS, dtype=np.float32)
        one_hot[0] = 0
        seen = one_hot[x]  # n, WIDTH, CHANNELS
        return np.concatenate([seen[:, i : WIDTH - SPAN + 1 + i] for i in range(SPAN)], 2)

    def _forward(self, x: np.ndarray):
        columns = self._columns(x)
        hidden = np.maximum(columns @ self.filters + self.bias, 0)
        in_value = hidden[:, BEFORE : BEFORE + VALUE - SPAN + 1]
        top, top_value = hidden.argmax(1), in_value.argmax(1) + BEFORE
        pooled = np.concatenate(
            [np.take_along_axis(hidden, top[:, None], 1)[:, 0], np.take_along_axis(hidden, top_value[:, None], 1)[:, 0]], 1
        )
        return columns, pooled, np.concatenate([top, top_value], 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 256])[1] @ self.out + self.out_bias for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -60, 60)))

    def step(self, x: np.ndarray, y: np.ndarray, moments: list, t: int, rate: float) -> None:
        """One step of Adam on the logistic loss."""
        columns, pooled, places = self._forward(x)
        error = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -60, 60))) - y) / len(x)
        back = error[:, None] * self.out[None, :] * (pooled > 0)
        filters, bias = np.zeros_like(self.filters), np.zeros_like(self.bias)
        rows = np.arange(len(x))
        for j in range(2 * FILTERS):
            filters[:, j % FILTERS] += back[:, j] @ columns[rows, places[:, j]]
            bias[j % FILTERS] += back[:, j].sum()
        slopes = [filters + 1e-4 * self.filters, bias, pooled.T @ error + 1e-4 * self.out, error.sum()]
        values = [self.filters, self.bias, self.out, np.array(self.out_bias)]
        moved = []
        for k, (value, slope) in enumerate(zip(values, slopes)):
            moments[k][0] = 0.9 * moments[k][0] + 0.1 * slope
            moments[k][1] = 0.999 * moments[k][1] + 0.001 * slope**2
            first, second = moments[k][0] / (1 - 0.9**t), moments[k][1] / (1 - 0.999**t)
            moved.append(value - rate * first / (np.sqrt(second) + 1e-8))
        self.filters, self.bias, self.out, self.out_bias = moved[0], moved[1], moved[2], float(moved[3])


def _untrained(draw: np.random.Generator) -> Network:
    return Network(
        draw.normal(0, 0.15, (SPAN * CHANNELS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        draw.normal(0, 0.15, 2 * FILTERS).astype(np.float32),
        0.0,
    )


def train(windows: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> Network | None:
    """Fits on four fifths; calibration and threshold on the rest.  None if a label is missing."""
    if not len(labels) or labels.min() == labels.max():
        return None
    draw = np.random.default_rng(7)
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), bool)
    x, y = windows[~held], labels[~held].astype(np.float32)
    blank = (y == 1) & (np.arange(len(y)) % 2 == 0)
    x = x.copy()
    x[blank, :BEFORE] = 0
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    network = _untrained(draw)
    moments = [[0.0, 0.0] for _ in range(4)]
    for t in range(1, 401):
        some = draw.choice(len(y), 64, p=weight / weight.sum())
        network.step(x[some], y[some], moments, t, 0.01 if t < 300 else 0.002)
    check, truth = (windows[held], labels[held]) if held.any() else (x, labels[~held])
    _calibrate(network, network.margins(check), truth)
    sure = network.probabilities(check)
    # the highest threshold that keeps the recall
    good = np.sort(sure[truth == 1])
    network.threshold = float(good[min(len(good) - 1, int((1 - recall) * len(good) + 1e-9))])
    chosen = sure >= network.threshold
    network.recall, network.precision = float((good >= network.threshold).mean()), float((truth[chosen] == 1).mean())
    return network


def _calibrate(network: Network, margins: np.ndarray, truth: np.ndarray, times: np.ndarray | float = 1.0) -> None:
    """Logistic regression of the label on the margin, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        w = (p * (1 - p) + 1e-6) * times
        slope = np.array([(times * (p - truth) * margins).sum() + 0.1 * a, (times * (p - truth)).sum() + 0.1 * b])
        curve = np.array([[(w * margins**2).sum() + 0.1, (w * margins).sum()], [(w * margins).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(curve, slope)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    network.slope, network.offset = max(a, 1e-3), b


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(window, label): candidates in base findings 1, other long runs 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows, labels = [], []
            for value in batch.column(text).to_pylist():
                if not value:
                    continue
                base = base_findings(value)
                outside, inside = candidates(value, base)
                # a window beside the base findings of its run has no label
                good = [w for s in inside for w in windows_of(*s) if any(a < w[1] and w[0] < b for a, b, _ in base)]
                bad = [w for s in outside for w in windows_of(*s)]
                windows += [window_of(value, *w) for w in good + bad]
                labels += [1] * len(good) + [0] * len(bad)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(labels, pa.int32())], names=["window", "label"])

    return docs.select(text).mapInArrow(run, "window binary, label int")


def fit(docs: DataFrame, text: str = "text", per_part: int = PER_PART, recall: float = RECALL) -> Network | None:
    """A network trained on all distinct findings but a held-back fifth, by which it is calibrated.  None if a label is missing."""
    scratch = Scratch(docs.sparkSession, "findings")
    held = (F.pmod(F.xxhash64("window"), F.lit(5)) == 4).alias("held")
    found = scratch.store(labelled_findings(docs, text).distinct().select("window", "label", held), "findings")
    counts = {(r.label, r.held): r["count"] for r in found.groupBy("label", "held").count().collect()}
    sizes = [counts.get((label, False), 0) for label in (0, 1)]
    learning, checked = found.where(~F.col("held")), found.where("held")
    if len(counts) < 4:  # too few to hold any back
        sizes = [sum(n for (label, _), n in counts.items() if label == own) for own in (0, 1)]
        learning = checked = found
    network = None
    if min(sizes):
        state = _State.untrained()
        parts = scratch.store(_parts(learning, sizes, per_part), "parts")
        for _ in range(ROUNDS):
            state = _next_round(parts, state)
        margins = scratch.store(_margins(checked, state.network), "margins")
        network = _with_threshold(state.network, margins, recall)
    scratch.drop_others()
    return network


def _parts(found: DataFrame, sizes: list[int], per_part: int) -> DataFrame:
    """``(part, plain, secret)``: lists of windows of either label, about ``per_part`` in each."""
    n = -(-max(sizes) // per_part)
    parts = found.sparkSession.range(n).withColumnRenamed("id", "part")
    for label, name in enumerate(("plain", "secret")):
        lists = -(-sizes[label] // per_part)
        # by other bits of the hash than what is held back
        place = F.pmod(F.xxhash64("window", F.lit("list")), F.lit(lists)).alias(f"of_{name}")
        own = found.where(F.col("label") == label).groupBy(place).agg(F.sort_array(F.collect_list("window")).alias(name))
        parts = parts.withColumn(f"of_{name}", F.floor(F.col("part") * lists / n)).join(own, f"of_{name}")
    return parts.select("part", "plain", "secret").repartition(n, "part")


def _next_round(parts: DataFrame, state: _State) -> _State:
    """The mean of what the parts make of one state, each going through all of its windows."""
    shared = parts.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, 1):
            own = [np.stack([np.frombuffer(w, np.uint8) for w in batch.column(c)[0].as_py()]) for c in ("plain", "secret")]
            one = fixed(np.append(shared.value.taught(*own, batch.column("part")[0].as_py()).values(), 1.0))
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["values"])

    total = added(parts.mapInArrow(run, "values binary"))
    shared.destroy()
    return state.of(total[:-1] / total[-1])


@dataclass
class _State:
    """A network between two rounds, with the moments of its training (of the second ones the roots) and its steps."""

    network: Network
    first: list
    root: list
    steps: float = 0.0
    turn: int = 0

    @classmethod
    def untrained(cls) -> _State:
        network = _untrained(np.random.default_rng(7))
        return cls(network, *[[np.zeros(np.shape(v)) for v in cls._of_network(network)] for _ in range(2)])

    @staticmethod
    def _of_network(network: Network) -> list:
        return [network.filters, network.bias, network.out, np.array(network.out_bias)]

    def values(self) -> np.ndarray:
        arrays = [*self._of_network(self.network), *self.first, *self.root, np.array(self.steps / (1 << 20))]
        return np.concatenate([np.ravel(a) for a in arrays]).astype(float)

    def of(self, values: np.ndarray) -> _State:
        """The next round's state of this shape."""
        shapes = [np.shape(v) for v in self._of_network(self.network)]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes * 3])
        parts = [v.reshape(shape) for v, shape in zip(np.split(values, ends), shapes * 3)]
        filters, bias, out, last = parts[:4]
        network = replace(self.network, filters=filters.astype(np.float32), bias=bias.astype(np.float32), out=out, out_bias=float(last))
        return _State(network, parts[4:8], parts[8:], values[-1] * (1 << 20), self.turn + 1)

    def taught(self, plain: np.ndarray, secret: np.ndarray, part: int) -> _State:
        """After steps in which every window takes part; half of each step's windows are secrets."""
        draw, rate = np.random.default_rng([self.turn, part]), 0.01 if self.turn < 0.75 * ROUNDS else 0.002
        network, moments = replace(self.network), [[a, b**2] for a, b in zip(self.first, self.root)]
        secret = secret.copy()
        secret[::2, :BEFORE] = 0
        steps = max(STEPS, -(-max(len(plain), len(secret)) // 32))
        order = [np.resize(draw.permutation(len(x)), steps * 32).reshape(steps, 32) for x in (plain, secret)]
        y = np.repeat([0, 1], 32).astype(np.float32)
        for t in range(steps):
            network.step(np.concatenate((plain[order[0][t]], secret[order[1][t]])), y, moments, round(self.steps) + t + 1, rate)
        return _State(network, [m[0] for m in moments], [np.sqrt(m[1]) for m in moments], self.steps + steps, self.turn)


def _margins(found: DataFrame, network: Network) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                margins = shared.value.margins(np.stack([np.frombuffer(w, np.uint8) for w in batch.column("window").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(margins.astype(float))], names=["label", "margin"])

    return found.mapInArrow(run, "label int, margin double")


def _with_threshold(network: Network, margins: DataFrame, recall: float) -> Network:
    """Calibrated on all ``(label, margin)``, with the highest threshold that keeps the recall."""
    network = replace(network)
    step = F.round(F.greatest(F.least("margin", F.lit(100.0)), F.lit(-100.0)), 2).alias("step")
    steps = sorted((r.step, r.label, r["count"]) for r in margins.groupBy(step, "label").count().collect())  # of bounded number
    at, truth, times = (np.array(x, float) for x in zip(*steps))
    _calibrate(network, at, truth, times)
    secret = margins.where("label = 1").select("margin")
    n = int(times[truth == 1].sum())
    # a little under it, as the last digits of a margin depend on the windows computed together
    least = _of_rank(secret, min(n - 1, int((1 - recall) * n + 1e-9))) - 1e-5
    network.threshold = float(1 / (1 + np.exp(-np.clip(network.slope * least + network.offset, -60, 60))))
    chosen = margins.where(F.col("margin") >= least).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all")).first()
    network.recall, network.precision = chosen.good / n, chosen.good / chosen["all"]
    return network


def _of_rank(values: DataFrame, rank: int) -> float:
    """The value with ``rank`` smaller ones before it: the range that holds it is narrowed until few values are left."""
    name = values.columns[0]
    while True:
        state = values.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).first()
        if state.n <= _PICKED:
            return sorted(r[0] for r in values.collect())[rank]
        width = (state.high - state.low) / 1000
        if not width:
            return state.low
        place = F.floor((F.col(name) - state.low) / width)
        for here, n in sorted((r.place, r["count"]) for r in values.groupBy(place.alias("place")).count().collect()):
            if rank < n:
                break
            rank -= n
        values = values.where(place == here)


def scan(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Every row with ``findings``: base and model spans by start, then kind as listed."""
    docs = docs.drop("findings")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([*docs.schema.fields, T.StructField("findings", FINDINGS, False)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            found, windows, places = [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                found.append(base_findings(value or ""))
                if known is not None:
                    outside, inside = candidates(value or "", found[-1])
                    for span in outside + remainders(value or "", found[-1], inside):
                        for part in windows_of(*span):
                            windows.append(window_of(value, *part))
                            places.append((i, span))
            if windows:
                sure = known.probabilities(np.stack([np.frombuffer(w, np.uint8) for w in windows]))
                for i, (start, end) in dict.fromkeys(p for p, chosen in zip(places, sure >= known.threshold) if chosen):
                    found[i].append((start, end, "model"))
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in sorted(f, key=_order)] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "findings"])

    return docs.mapInArrow(run, schema)


def redact(found: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The rows without ``findings``, each union of spans replaced by ``mark``."""
    schema = found.drop("findings").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cleaned = []
            for value, findings in zip(batch.column(text).to_pylist(), batch.column("findings").to_pylist()):
                if not findings:
                    cleaned.append(value)
                    continue
                parts, at = [], 0
                for f in findings:
                    if f["start"] >= at:
                        parts += [value[at : f["start"]], mark]
                    at = max(at, f["end"])
                cleaned.append("".join(parts) + value[at:])
            columns = [pa.array(cleaned, pa.string()) if f.name == text else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema)

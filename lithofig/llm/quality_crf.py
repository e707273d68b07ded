"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbours. A document's
share of good is the mean of its lines' forward-backward marginals, weighted by their length, and
a logistic curve fitted on the training documents turns that share into a score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithofig.llm.shared import bound_batches, by_text, discard, give_back, in_slices, materialize, sums_between, words_of

#: Lines of labelled documents that are fitted on the driver; more stay on the cluster, which sums each step.
DRIVER_LINES = 50_000
#: Labels broadcast to the scan; beyond that both sides are shuffled.
BROADCAST_LABELS = 2_000_000
#: Texts whose features are computed at once for the fit, which bounds the driver's memory.
FIT_AT_ONCE = 100
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
THRESHOLD = 0.3

# classes of bytes that are counted in a line
_CLASSES = ["upper", "lower", "digit", "space", "stop", "mark", "pipe", "shout", "high"]
_table = np.full(256, _CLASSES.index("mark"), dtype=np.uint8)
_table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_table[[ord(c) for c in "0123456789"]] = 2
_table[[9, 11, 12, 13, 32]] = 3
_table[[ord(c) for c in ".,;:'\"()?-"]] = 4
_table[ord("|")] = 6
_table[ord("!")] = 7
_table[128:] = 8
OWN = 14
FEATURES = 3 * OWN + 1


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a batch, lengths of the lines in bytes, and offsets of the texts in them.

    A text has one line more than line ends; null counts as empty. Long texts cost no more a byte.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a line break at a text's end begins a last, empty line of that text, which sorts before the next text's start
    owner = np.searchsorted(breaks, offsets, side="left")
    lines = owner + np.arange(len(offsets))
    bounds = np.append(starts, len(data))
    kinds = _table[data]
    counts = np.stack([sums_between((kinds == k).astype(np.int64), bounds) for k in range(len(_CLASSES))], 1).astype(np.float64)
    length = counts.sum(1)
    words = counts[:, 3] + 1
    letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
    whole = np.maximum(length, 1)
    own = np.stack([
        (length > 0).astype(float), np.minimum(length, 400) / 400, counts[:, 0] / np.maximum(letters, 1), (counts[:, 0] > 0.6 * np.maximum(counts[:, 0] + counts[:, 1], 1)).astype(float),
        np.minimum(counts[:, 5] / words, 4), (counts[:, 5] > 0.3 * words).astype(float), np.minimum(counts[:, 6] / words, 1), np.minimum(counts[:, 7] / words, 2),
        counts[:, 2] / whole, np.minimum(counts[:, 4] / words, 1), np.minimum(whole / words, 20) / 20, letters / whole], 1)
    own = np.concatenate([own, _repeats(texts, data, offsets, bounds)], 1)
    return _with_neighbours(own, lines), whole, lines


def _with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the lines before and after it in its text, and a one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[lines[:-1]] = 0
    after[lines[1:] - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1)


def _packed(own: np.ndarray, whole: np.ndarray, lines: np.ndarray) -> pa.Array:
    """Own features and lengths of all lines of each text as one binary value."""
    table = np.column_stack([own, whole])
    return pa.Array.from_buffers(pa.binary(), len(lines) - 1, [None, pa.py_buffer((lines * table[:1].nbytes).astype(np.int32)), pa.py_buffer(table)])


def _unpacked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``line_table`` returned for texts that were packed."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    table = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.float64).reshape(-1, OWN + 1)
    lines = (offsets - offsets[0]) // (8 * (OWN + 1))
    return _with_neighbours(table[:, :OWN], lines), table[:, OWN], lines


def _repeats(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each line the share of words that repeat the word before them, and whether many do."""
    codes, of, _ = words_of(texts)
    gap = np.isin(data, [9, 10, 11, 12, 13, 32])
    begins = ~gap
    begins[1:] &= gap[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = ~gap[inner]
    at = np.flatnonzero(begins)
    same = np.zeros(len(codes), dtype=np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[of[:-1][of[:-1] < len(codes)]] = 0
    line = np.searchsorted(bounds, at, side="right") - 1
    line = np.minimum(line, len(bounds) - 2)
    words = np.bincount(line, minlength=len(bounds) - 1)
    share = np.bincount(line, weights=same, minlength=len(bounds) - 1) / np.maximum(words, 1)
    return np.stack([share, (share > 0.25).astype(float)], 1)


class LineField:
    """Weights of the field: for each feature the good label's score, and 2 x 2 transitions."""

    def __init__(self) -> None:
        self.emit, self.move = np.zeros(FEATURES), np.zeros((2, 2))
        self.slope, self.level, self.prior = 1.0, 0.0, 0.5

    def marginals(self, features: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and P(label, next label) of every line but a text's last, by forward-backward."""
        n, sizes = len(features), np.diff(lines)
        unary = np.zeros((n, 2))
        unary[:, 1] = features @ self.emit
        ahead, back = unary.copy(), np.zeros((n, 2))
        order = np.argsort(-sizes, kind="stable")
        first, size = lines[:-1][order], sizes[order]
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        for t in range(1, longest):
            at = first[:live[t]] + t
            before = ahead[at - 1]
            ahead[at] += np.logaddexp(before[:, :1] + self.move[0], before[:, 1:] + self.move[1])
        for t in range(longest - 2, -1, -1):
            at = first[:live[t + 1]] + t
            onward = back[at + 1] + unary[at + 1]
            back[at] = np.logaddexp(onward[:, :1] + self.move[:, 0], onward[:, 1:] + self.move[:, 1])
        both = ahead + back
        top = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - top)
        inner = np.ones(n, bool)
        inner[lines[1:] - 1] = False
        at = np.flatnonzero(inner)
        pair = ahead[at][:, :, None] + self.move + (unary[at + 1] + back[at + 1])[:, None, :] - top[at][:, None, None]
        return good, np.exp(pair)

    def share(self, features: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        good, _ = self.marginals(features, lines)
        return sums_between(good * length, lines) / sums_between(length, lines)

    def fit(self, texts: pa.Array, quality: np.ndarray) -> LineField:
        """Maximise the likelihood of the lines, each labelled as its document, by Adam steps."""
        parts = [line_table(pa.concat_arrays([texts[:0], texts[i:i + FIT_AT_ONCE]])) for i in range(0, len(texts), FIT_AT_ONCE)]
        features, length = (np.concatenate([p[k] for p in parts]) for k in range(2))
        lines = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        del parts
        give_back()
        return self.fit_lines(features, length, lines, quality)

    def fit_lines(self, features: np.ndarray, length: np.ndarray, lines: np.ndarray, quality: np.ndarray) -> LineField:
        good = int((quality == 1).sum())
        self.climb(lambda: self.slopes(features, lines, quality), len(quality) - good, good)
        x = self._logit(self.share(features, length, lines))
        return self.calibrate(lambda a, b: curve_sums(x, quality, a, b))

    def slopes(self, features: np.ndarray, lines: np.ndarray, quality: np.ndarray) -> np.ndarray:
        """Sums over the bad and the good documents of the slope of each one's mean likelihood of a line: 2 x weights."""
        sizes = np.diff(lines)
        label = np.repeat(quality, sizes).astype(np.int64)
        weight = np.repeat(1.0 / sizes, sizes)
        inner = np.ones(len(features), bool)
        inner[lines[1:] - 1] = False
        at = np.flatnonzero(inner)
        good, pair = self.marginals(features, lines)
        pair = -pair
        pair[np.arange(len(at)), label[at], label[at]] += 1
        pair = pair.reshape(-1, 4) * weight[at][:, None]
        return np.stack([np.concatenate([features.T @ (weight * (label == k) * (label - good)), pair[label[at] == k].sum(0)]) for k in range(2)])

    def climb(self, slopes: Callable[[], np.ndarray], bad: int, good: int) -> None:
        """Take the Adam steps; ``slopes`` sums over all documents, in which both labels weigh alike."""
        balance = np.array([0.5 / max(1, bad), 0.5 / max(1, good)])
        self.prior = good / (bad + good)
        theta, m, v = np.zeros(FEATURES + 4), 0.0, 0.0
        for step in range(1, STEPS + 1):
            self.emit, self.move = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            slope = balance @ slopes() - RIDGE * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move = theta[:FEATURES].copy(), theta[FEATURES:].reshape(2, 2).copy()

    def calibrate(self, sums: Callable[[float, float], np.ndarray]) -> LineField:
        """Newton steps of a ridged logistic curve; ``sums`` are those of ``curve_sums`` over all documents."""
        a, b = 1.0, 0.0
        for _ in range(50):
            first, second, xx, x, w = sums(a, b)
            step = np.linalg.solve(np.array([[xx + 1, x], [x, w + 1e-3]]), np.array([first - a, second - 1e-3 * b]))
            a, b = float(a + step[0]), float(b + step[1])
            if np.abs(step).max() < 1e-12:
                break
        self.slope, self.level = a, b
        return self

    @staticmethod
    def _logit(share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def score(self, texts: pa.Array) -> np.ndarray:
        features, length, lines = line_table(texts)
        x = self._logit(self.share(features, length, lines))
        score = 1 / (1 + np.exp(-np.clip(self.slope * x + self.level, -30, 30)))
        empty = pc.equal(pc.fill_null(pc.utf8_length(texts), 0), 0).to_numpy(zero_copy_only=False)
        return np.where(empty, self.prior, score)


def curve_sums(x: np.ndarray, quality: np.ndarray, a: float, b: float) -> np.ndarray:
    """Slopes of a logistic curve's likelihood in ``a`` and ``b``, and its curvatures in both, each and ``b``."""
    p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
    w = p * (1 - p) + 1e-6
    return np.array([((quality - p) * x).sum(), (quality - p).sum(), (w * x * x).sum(), (w * x).sum(), w.sum()])


def _line_features(batches):
    for batch in in_slices(batches, 0):
        features, whole, lines = line_table(batch.column(0))
        yield pa.RecordBatch.from_arrays([_packed(features[:, :OWN], whole, lines), batch.column(1), pa.array(np.diff(lines))], names=["packed", "y", "n"])


def _summed(rows: DataFrame, function: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``function`` returns for all batches of ``rows``."""

    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + function(batch)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["part", "shape"])

    # in an order of their own, as that of tasks may change
    parts = sorted(rows.mapInArrow(run, "part binary, shape array<int>").collect())
    return sum(np.frombuffer(r.part).reshape(r["shape"]) for r in parts)


def _fit_on_cluster(packed: DataFrame, bad: int, good: int) -> LineField:
    """What ``LineField.fit`` does, where each step's sums over all documents are taken by the tasks."""
    field = LineField()

    def slopes(batch):
        features, _, lines = _unpacked(batch.column(0))
        return field.slopes(features, lines, batch.column(1).to_numpy())

    def logits(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(field._logit(field.share(*_unpacked(batch.column(0))))), batch.column(1)], names=["x", "y"])

    field.climb(lambda: _summed(packed.select("packed", "y"), slopes), bad, good)
    curve = materialize(packed.select("packed", "y").mapInArrow(logits, "x double, y int"))
    field.calibrate(lambda a, b: _summed(curve, lambda batch: curve_sums(batch.column(0).to_numpy(), batch.column(1).to_numpy(), a, b)))
    discard(curve)
    return field


def fit_line_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField | None:
    """Fit on all labelled documents; None if no label has a document.

    ``labels`` holds ids with quality 0 or 1; rows with a null are left out, repeated ones count
    as often as they stand there. Features of the lines are written once; DRIVER_LINES of them
    or fewer are fitted on the driver, else each step sums over the cluster.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").join(known, "id").select("text", "y")
    packed = materialize(rows.mapInArrow(_line_features, "packed binary, y int, n long"))
    counts = {r.y: r for r in packed.groupBy("y").agg(F.count("*").alias("docs"), F.sum("n").alias("lines")).collect()}
    bad, good = (counts[k].docs if k in counts else 0 for k in range(2))
    if not counts:
        field = None
    elif sum(r.lines for r in counts.values()) <= DRIVER_LINES:
        # in an order of their own, as that of rows may change
        here = sorted(packed.select("packed", "y").collect())
        field = LineField().fit_lines(*_unpacked(pa.array([r.packed for r in here], pa.binary())), np.array([r.y for r in here]))
    else:
        field = _fit_on_cluster(packed, bad, good)
    discard(packed)
    give_back()
    return field


def quality_score(text: Column, field: LineField | None, spark: SparkSession) -> Column:
    """The score of each text as a column: for docs that keep their columns, whatever their names."""
    shared = bound_batches(spark).sparkContext.broadcast(field)

    def score(texts: pa.Array) -> pa.Array:
        if shared.value is None or not len(texts):
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(shared.value.score(texts), pa.float64())

    return by_text(score, "double")(text)


def score_quality(docs: DataFrame, field: LineField | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches the threshold) instead of its text.

    Empty and null texts score the share of good documents in training; without a field every
    score is 0.5. Repeated rows and ties score alike and are each returned; an empty table gives
    an empty result; very long texts are scored whole. Other columns pass through, but ones that
    are named as a result are replaced by it.
    """
    others = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    scored = docs.select(*others, quality_score(F.col(text_col), field, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

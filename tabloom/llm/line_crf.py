"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; what is seen of a line and of its neighbours, and the
labels' order, decide its probability by the forward and backward sums. A
document's quality is the mean over its lines, weighted by their length, put on
the scale of the labels by a line fitted to its log odds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import append
from tabloom.llm.quality import ENDINGS, FUNCTION_BYTES, MARKED, NOT_LETTER, NOT_SYMBOL, NOT_UPPER

SAMPLE = 4_000  # labelled documents that train the field
CHAIN = 32  # lines of a training chain; longer documents give several
ROUNDS = 150
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def line_features(line: bytes, times: int) -> list[float]:
    """What is seen of one line; ``times``: how often it occurs in its document."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return [0.0] * 14 + [1.0]
    letters = max(1, len(line.translate(None, NOT_LETTER)))
    symbols = len(line.translate(None, NOT_SYMBOL))
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        min(1.0, math.log1p(n) / 6), float(n < 4), len(line.translate(None, NOT_UPPER)) / letters,
        min(1.0, symbols / n), min(1.0, 10 * symbols / size), sum(w[-1] in MARKED for w in words) / n,
        min(1.0, line.count(b"!") / n), len(line.translate(None, NOT_DIGIT)) / size, min(2.0, size / n / 10),
        distinct / n, float(n >= 20 and distinct < 1.8 * n ** 0.5), same / n,
        sum(map(FUNCTION_BYTES.__contains__, words)) / n, float(line.rstrip().endswith(ENDINGS)), float(times > 1)]


WIDTH = 15


def document_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features with both neighbours', weights): a row a line that has a word; an empty text is one empty line."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()] or [b""]
    times: dict[bytes, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    own = np.array([line_features(x, times[x]) for x in lines])
    none = np.zeros((1, WIDTH))
    first, last = np.zeros((len(lines), 1)), np.zeros((len(lines), 1))
    first[0], last[-1] = 1, 1
    seen = np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), first, last, np.ones_like(first)])
    return seen, np.array([max(1, len(x)) for x in lines], float)


COLUMNS = 3 * WIDTH + 3


def marginals(score: np.ndarray, stay: float, change: float) -> np.ndarray:
    """P(good) of each line of one chain from the log odds of the lines alone and the two transition scores."""
    n = len(score)
    odds, forward = score.tolist(), [0.0] * n
    # each pass carries one number: the log odds of what was summed so far
    def carried(x):
        if x > 0:
            e = math.exp(-x)
            return math.log((same + other * e) / (other + same * e))
        e = math.exp(x)
        return math.log((same * e + other) / (other * e + same))

    top = max(stay, change)
    same, other = math.exp(stay - top), math.exp(change - top)
    x = 0.0
    for i in range(n):
        x = odds[i] + (carried(x) if i else 0.0)
        forward[i] = x
    out = [0.0] * n
    x = 0.0
    for i in range(n - 1, -1, -1):
        after = carried(x) if i < n - 1 else 0.0
        total = forward[i] + after
        out[i] = 1 / (1 + math.exp(-min(max(total, -60.0), 60.0)))
        x = odds[i] + after
    return np.array(out)


class LineField:
    """Weights of the features, the two transition scores and the line that scales a document's log odds."""

    def __init__(self, weights: list[float], stay: float, change: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.stay, self.change, self.slope, self.shift = weights, stay, change, slope, shift

    def log_odds(self, text: str | None) -> float:
        seen, weight = document_rows(text)
        p = marginals(seen @ np.array(self.weights), self.stay, self.change)
        p = min(max(float((p * weight).sum() / weight.sum()), 1e-9), 1 - 1e-9)
        return math.log(p / (1 - p))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.log_odds(text) + self.shift, -60.0), 60.0)))

    @classmethod
    def train(cls, rows: list[tuple[str | None, int]], rounds: int = ROUNDS) -> LineField:
        """Gradient steps on the labels' likelihood, each line labelled as its document; then the scale."""
        chains = []
        for text, label in rows:
            seen, _ = document_rows(text)
            chains += [(seen[a:a + CHAIN], label) for a in range(0, len(seen), CHAIN)]
        chains.sort(key=lambda c: len(c[0]))
        blocks = []
        for a in range(0, len(chains), 1024):
            part = chains[a:a + 1024]
            wide = max(len(s) for s, _ in part)
            x, live = np.zeros((len(part), wide, COLUMNS)), np.zeros((len(part), wide))
            for i, (s, _) in enumerate(part):
                x[i, :len(s)], live[i, :len(s)] = s, 1
            blocks.append((x, live, np.array([k for _, k in part], float)))
        lines = sum(live.sum() for _, live, _ in blocks)
        w = np.zeros(COLUMNS + 2)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            grad = 0.001 * w
            for x, live, label in blocks:
                grad = grad + cls._gradient(w, x, live, label) / lines
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            w = w - 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        field = cls(w[:-2].tolist(), float(w[-2]), float(w[-1]))
        field._scale([(field.log_odds(t), k) for t, k in rows])
        return field

    @staticmethod
    def _gradient(w: np.ndarray, x: np.ndarray, live: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Of the negative log likelihood: expected less observed counts, by forward and backward sums."""
        n, wide = live.shape
        score = x @ w[:-2]
        node = np.stack([np.zeros_like(score), score], axis=2)
        move = np.array([[w[-2], w[-1]], [w[-1], w[-2]]])
        forward, backward = np.zeros((n, wide, 2)), np.zeros((n, wide, 2))
        forward[:, 0] = node[:, 0]
        for t in range(1, wide):
            forward[:, t] = node[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1)
        for t in range(wide - 2, -1, -1):
            on = np.logaddexp.reduce(move + (node[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = on * live[:, t + 1, None]
        total = forward + backward
        p = np.exp(total - np.logaddexp.reduce(total, axis=2, keepdims=True))[:, :, 1]
        grad = np.zeros_like(w)
        grad[:-2] = np.einsum("nt,ntc->c", (p - label[:, None]) * live, x)
        pair = (forward[:, :-1, :, None] + move + (node[:, 1:] + backward[:, 1:])[:, :, None, :])
        pair = np.exp(pair - np.logaddexp.reduce(pair, axis=(2, 3), keepdims=True)) * live[:, 1:, None, None]
        grad[-2] = pair[:, :, 0, 0].sum() + pair[:, :, 1, 1].sum() - live[:, 1:].sum()
        grad[-1] = pair[:, :, 0, 1].sum() + pair[:, :, 1, 0].sum()
        return grad

    def _scale(self, pairs: list[tuple[float, int]]) -> None:
        """The slope and shift of a logistic regression of the labels on the log odds."""
        x = np.array([[o, 1.0] for o, _ in pairs])
        y = np.array([float(k) for _, k in pairs])
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
            w = w - np.clip(step, -2, 2)
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


class QualityClassifier:
    """Trains on labelled texts and scores texts; higher means label 1 is likelier.

    Null and empty texts are one empty line and get a score as well. Rows with a
    null label teach nothing. Without labels every score is 0.5.
    """

    def __init__(self, field: LineField | None):
        self.field = field

    @staticmethod
    def sample(labels: DataFrame, key: str, size: int = SAMPLE) -> DataFrame:
        """About ``size`` rows of a label table, taken by a hash of ``key``, so that few texts need to be fetched."""
        share = min(1.0, size / max(1, labels.count()))
        return labels.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", label: str = "quality", size: int = SAMPLE) -> QualityClassifier:
        """Learns from the labelled rows of ``df``; beyond about ``size`` of them, from those with the least hashes."""
        known = df.filter(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                                                         F.col(label).cast("int").alias("label")).distinct()
        rows = sorted((r["text"], r["label"]) for r in
                      known.orderBy(F.xxhash64("text"), "text", "label").limit(size).collect())
        return cls(LineField.train(rows) if rows else None)

    def predict(self, df: DataFrame, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
        field = self.field

        def make():
            def work(texts):
                found = [field.score(t) if field else 0.5 for t in texts]
                return [found, [int(x >= 0.5) for x in found]]
            return work

        return append(df, [text], [(score, T.DoubleType()), (predicted, T.IntegerType())], make)

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each word's bytes both ways and labels every position; a
document's probabilities are the mean over all positions of its whole text. As
the states start anew at each word, a word that occurs again in a task need not
be read again: its positions' sums are remembered.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import append

HIDDEN = 16
LONGEST = 24  # bytes read at once; a longer word is read in pieces
CACHED = 300_000
DOCUMENTS, WORDS = 400, 64  # different training texts of each language, words taken of each
SPREAD = 1 << 40  # least share of hashes that a bound can tell
STEPS, BATCH, RATE = 350, 256, 0.02
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(r"[A-Za-z]")
# Bytes of a word: letters in lower case and all that is not ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    words = text.encode().translate(FOLD).split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[a:a + LONGEST] for w in words for a in range(0, len(w), LONGEST)]
    return words


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths): a row a word, filled up at the end."""
    length = np.array([len(w) for w in words])
    wide = int(length.max())
    flat = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), wide), length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Two gated recurrent layers (one a direction) and a linear label layer, with backpropagation through time."""

    NAMES = ("x", "h", "b")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, labels: int, hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        r = np.random.default_rng(seed)
        w = {"out": r.normal(0, 0.3, (2 * hidden, labels)), "out_b": np.zeros(labels)}
        for d in "fb":
            w |= {f"{d}x": r.normal(0, 0.3, (256, 3 * hidden)), f"{d}h": r.normal(0, 0.2, (hidden, 3 * hidden)),
                  f"{d}b": np.zeros(3 * hidden)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, data: np.ndarray, length: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after each position, (row, position, hidden); a row's state rests outside its bytes."""
        x, u, b = (self.w[d + n] for n in self.NAMES)
        hidden = u.shape[0]
        h = np.zeros((len(data), hidden), np.float32)
        out = np.zeros((*data.shape, hidden), np.float32)
        places = range(data.shape[1]) if d == "f" else range(data.shape[1] - 1, -1, -1)
        for t in places:
            live = (length > t).astype(np.float32)[:, None]
            given, kept = x[data[:, t]] + b, h @ u
            gate = sigmoid(given[:, :2 * hidden] + kept[:, :2 * hidden])
            z, r = gate[:, :hidden], gate[:, hidden:]
            new = np.tanh(given[:, 2 * hidden:] + r * kept[:, 2 * hidden:])
            after = live * ((1 - z) * new + z * h) + (1 - live) * h
            if trace is not None:
                trace.append((t, h, z, r, new, kept, live))
            h = after
            out[:, t] = h
        return out

    def probabilities(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """P(label) at each position."""
        both = np.concatenate([self._run(data, length, "f"), self._run(data, length, "b")], axis=2)
        score = both @ self.w["out"] + self.w["out_b"]
        score = np.exp(score - score.max(axis=2, keepdims=True))
        return score / score.sum(axis=2, keepdims=True)

    def loss(self, data: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradient."""
        traces = {"f": [], "b": []}
        states = {d: self._run(data, length, d, traces[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        score = both @ self.w["out"] + self.w["out_b"]
        score = np.exp(score - score.max(axis=2, keepdims=True))
        p = score / score.sum(axis=2, keepdims=True)
        live = (np.arange(data.shape[1]) < length[:, None]).astype(np.float32)
        rows = np.arange(len(data))
        own = p[rows[:, None], np.arange(data.shape[1]), label[:, None]]
        total = live.sum()
        value = float(-(np.log(own + 1e-9) * live).sum() / total)
        p[rows[:, None], np.arange(data.shape[1]), label[:, None]] -= 1
        p *= (live / total)[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"] = np.einsum("nth,ntl->hl", both, p)
        grad["out_b"] = p.sum(axis=(0, 1))
        back = p @ self.w["out"].T
        hidden = self.w["fh"].shape[0]
        for d, part in (("f", back[:, :, :hidden]), ("b", back[:, :, hidden:])):
            u, flow = self.w[d + "h"], np.zeros((len(data), hidden), np.float32)
            for t, h, z, r, new, kept, alive in reversed(traces[d]):
                flow = flow + part[:, t]
                moved = flow * alive
                into_new = moved * (1 - z) * (1 - new * new)
                into_z = moved * (h - new) * z * (1 - z)
                into_r = into_new * kept[:, 2 * hidden:] * r * (1 - r)
                outer = np.concatenate([into_z, into_r, into_new], axis=1)
                inner = np.concatenate([into_z, into_r, into_new * r], axis=1)
                np.add.at(grad[d + "x"], data[:, t], outer)
                grad[d + "b"] += outer.sum(axis=0)
                grad[d + "h"] += h.T @ inner
                flow = flow * (1 - alive) + moved * z + inner @ u.T
        return value, grad

    def fit(self, words: list[bytes], label: np.ndarray, steps: int = STEPS, seed: int = 11) -> BiGru:
        """Adam over batches of words."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(words), min(BATCH, len(words)))
            data, length = padded([words[i] for i in pick])
            _, grad = self.loss(data, length, label[pick])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                              / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """A row a word: the sum of its positions' probabilities. Words of one length are read together."""
        out = np.zeros((len(words), self.w["out"].shape[1]), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, places in by_length.items():
            for at in range(0, len(places), 4096):
                part = places[at:at + 4096]
                data = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)
                out[part] = self.probabilities(data, np.full(len(part), n)).sum(axis=1)
        return out


class LanguageId:
    """Trains the network on labelled rows and predicts rows.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows
    get equal results. Without any labelled text every prediction is ``und``.
    """

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray]):
        self.labels, self.weights = labels, weights

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", lang: str = "lang", documents: int = DOCUMENTS,
            words: int = WORDS) -> LanguageId:
        """Learns from ``documents`` different texts of each language that have a word, those of the least hashes, or all
        if there are fewer, and from ``words`` words of each, spread over the whole text."""
        known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
            F.col(lang).alias("lang"), F.col(text).alias("text"))
        known = known.withColumn("h", F.xxhash64("text"))
        worded = F.col("text").rlike("[A-Za-z\\x{80}-\\x{10FFFF}]")  # else words_of() finds nothing
        counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(
            F.approx_count_distinct(F.when(worded, F.col("h"))).alias("n")).collect()}
        labels = sorted(counts)
        if not labels:
            return cls([], {})
        # about twice as many hashes as are wanted pass the bound, copies as one; the least of them are those of all
        spread, bound = F.pmod("h", F.lit(SPREAD)), F.lit(0)
        for name, n in counts.items():
            bound = F.when(F.col("lang") == name, int(min(1.0, 2 * (documents + 50) / max(n, 1)) * SPREAD) + 1).otherwise(bound)
        passed: dict[str, list[tuple[int, int]]] = {}
        for r in known.filter(worded & (spread < bound)).select("lang", "h", spread.alias("s")).distinct().collect():
            passed.setdefault(r["lang"], []).append((r["s"], r["h"]))
        chosen = df.sparkSession.createDataFrame(
            [(name, h) for name, found in passed.items() for _, h in sorted(found)[:documents]], "lang string, h long")
        met = known.join(F.broadcast(chosen), ["lang", "h"])

        def make():
            seen: set[tuple[str, int]] = set()  # of the chosen ones at most

            def work(langs, hashes, texts):
                out = []
                for key, t in zip(zip(langs, hashes), texts):
                    if key in seen:
                        out.append(None)
                        continue
                    seen.add(key)
                    found = words_of(t)
                    step = max(1, len(found) / words)
                    out.append([found[int(i * step)] for i in range(min(words, len(found)))])
                return [out]
            return work

        taken = append(met, ["lang", "h", "text"], [("words", T.ArrayType(T.BinaryType()))], make).drop("text")
        # of copies a task sends one on and one is kept: documents * words words of each language
        rows = taken.filter("words is not null").groupBy("lang", "h").agg(F.min("words").alias("words")).collect()
        pairs = sorted((bytes(w), labels.index(r["lang"])) for r in rows for w in r["words"])
        if not pairs:
            return cls([], {})
        network = BiGru.start(len(labels)).fit([w for w, _ in pairs], np.array([k for _, k in pairs]))
        return cls(labels, network.w)

    def predict(self, df: DataFrame, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
        labels = self.labels
        sent = df.sparkSession.sparkContext.broadcast(  # of fixed size, given the number of languages
            (json.dumps({k: v.shape for k, v in self.weights.items()}), {k: v.tobytes() for k, v in self.weights.items()}))

        def make():
            shapes, raw = sent.value
            network = BiGru({k: np.frombuffer(raw[k], np.float32).reshape(s) for k, s in json.loads(shapes).items()})
            place: dict[bytes, int] = {}
            sums = np.zeros((0, len(labels)), np.float32)

            def work(texts):
                nonlocal place, sums
                split = [words_of(t) if t and labels and (ASCII_LETTER.search(t) or LETTER.search(t)) else None
                         for t in texts]
                if len(place) > CACHED:
                    place, sums = {}, sums[:0]
                new = sorted({w for s in split if s for w in s} - place.keys())
                if new:
                    place |= {w: len(place) + i for i, w in enumerate(new)}
                    sums = np.concatenate([sums, network.word_sums(new)])
                names, scores = [], []
                for s in split:
                    if not s:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = sums[[place[w] for w in s]].sum(axis=0, dtype=np.float64)
                    best = int(total.argmax())
                    names.append(labels[best])
                    scores.append(round(float(min(1.0, total[best] / total.sum())), 6))
                return [names, scores]

            return work

        return append(df, [text], [(label, T.StringType()), (score, T.DoubleType())], make)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of

"""Personal data: four base patterns, and further spans found by weak supervision.

Regex, gazetteer and context labelers vote on every candidate span;
expectation-maximisation over the counted vote patterns says how far each
labeler can be trusted; the posteriors train a small span classifier, which
decides on the spans beside the base ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import append, own
from tabloom.llm.weak import ABSTAIN, NO, YES, VoteModel
from tabloom.session import checkpoint

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "name")
SAMPLE = 20_000  # candidates that train the classifier
LEAST = 4  # characters of an assigned secret

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Words that announce personal data, words that announce plain numbers, titles and given names.
KEYWORDS = re.compile(r"(?i)(?<![a-z])(password|passwd|pwd|passphrase|pin|token|secret|api[ _-]?key|access[ _-]?key|key"
                      r"|ssn|passport|iban|account|konto|cuenta|compte|tel|phone|telefon|mobile|born|id)(?![a-z])")
PLAIN_NUMBERS = re.compile(r"(?i)(?<![a-z])(page|chapter|section|figure|table|volume|version|year|seite|kapitel|jahr"
                           r"|année|chapitre|año|capítulo|página)\W*$")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora")
GIVEN_NAMES = frozenset("""
james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica
thomas sarah charles karen hans peter anna maria klaus ursula jean marie pierre nathalie luis carmen josé juan
""".split())

ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
                      r"\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{4,})")
NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
                    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{6,}")
NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? ([^\W\d_]{2,}(?: [^\W\d_]{2,})?)")
SHAPES = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|(?:sk|pk|ghp|xox[abp])[-_][A-Za-z0-9_-]{16,}"
                    r"|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?|[0-9]{3}-[0-9]{2}-[0-9]{4}")
UNITS = re.compile(r"[0-9]+(?:[.,:/-][0-9]+){0,2}(?:st|nd|rd|th|kg|km|cm|mm|mb|gb|px|ms|s|h|m)?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the four base kinds; a match that fails its test is dropped and not retried."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        for m in IP.finditer(text) if text.count(".") > 2 else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts) if value else 0.0


class Candidate:
    """A span judged as a whole; ``parts`` are what of it lies in no base span."""

    def __init__(self, kind: str, start: int, end: int, text: str, parts: list[tuple[int, int]] | None = None):
        self.kind, self.start, self.end, self.parts = kind, start, end, parts or [(start, end)]
        self.value, self.before = text[start:end], text[max(0, start - 32):start]
        self.digits = sum(c in "0123456789" for c in self.value)
        self.letters = sum(c.isalpha() for c in self.value)
        self.entropy = entropy(self.value)


def votes_of(c: Candidate) -> str:
    """One vote a labeler: shape, context, assignment, entropy, mixture, checksum, gazetteer."""
    size = len(c.value)
    number = c.value.replace(" ", "").replace("-", "")
    votes = [
        YES if SHAPES.fullmatch(c.value) else NO if c.kind == "secret" and size < 8 else ABSTAIN,
        YES if KEYWORDS.search(c.before) else NO if PLAIN_NUMBERS.search(c.before) else ABSTAIN,
        YES if c.before.rstrip(" \"'").endswith(("=", ":")) else ABSTAIN,
        YES if c.entropy >= 2.9 and size >= 12 else NO if c.entropy < 1.8 else ABSTAIN,
        YES if c.digits >= 3 and c.letters >= 3 and size >= 10 else NO if not c.letters and c.digits <= 6 else ABSTAIN,
        YES if iban(c.value) else NO if number.isdigit() and 12 <= len(number) <= 19 and not luhn(number) else ABSTAIN,
        YES if c.kind == "name" and c.value.split()[0].casefold() in GIVEN_NAMES else
        NO if UNITS.fullmatch(c.value) else ABSTAIN,
    ]
    return "".join(votes)


LABELERS = 7


def features_of(c: Candidate) -> list[float]:
    size = len(c.value)
    return [1.0, min(size, 64) / 16, float(size >= 12), c.digits / size, c.letters / size,
            sum(x.isupper() for x in c.value) / size, sum(x in "0123456789abcdef" for x in c.value) / size, c.entropy / 4,
            float(bool(KEYWORDS.search(c.before))), float(c.before.rstrip(" \"'").endswith(("=", ":"))),
            float(c.kind == "secret"), float(c.kind == "number"), float(c.kind == "name"), float(" " in c.value),
            float(bool(UNITS.fullmatch(c.value)))]


def outside(start: int, stop: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the ordered spans ``taken`` leave of a span, in pieces of at least ``LEAST`` characters."""
    out, at = [], start
    for a, b in [*taken, (stop, stop)]:
        if a - at >= LEAST:
            out.append((at, a))
        at = max(at, b)
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[Candidate]:
    """Spans that might be personal data, earlier ones first, of equal starts the longest, none overlapping another.

    They touch no base span, but for assigned secrets of any length: of these the parts around the base spans are kept.
    """
    found: list[tuple[int, int, int, str]] = []  # start, end as a negative number, place of the pattern, kind
    if "=" in text or ":" in text:
        found += [(m.start(1), -m.end(1), 0, "secret") for m in ASSIGNED.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), -m.end(), 1, "number") for m in NUMBER.finditer(text)]
        for m in TOKEN.finditer(text):
            value = m.group().strip(".-/")
            if DIGIT.search(value) and len(value) >= 6:
                start = m.start() + len(m.group()) - len(m.group().lstrip(".-/"))
                found.append((start, -start - len(value), 2, "secret"))
    if any(t in text for t in TITLES):
        found += [(m.start(1), -m.end(1), 3, "name") for m in NAME.finditer(text) if m.group(1)[0].isupper()]
    out, end = [], 0
    blocked = sorted((a, b) for a, _, b in taken)
    k = 0
    for start, minus, pattern, kind in sorted(found):
        stop = -minus
        while k < len(blocked) and blocked[k][1] <= start:
            k += 1
        if start < end:
            continue
        after = k
        while after < len(blocked) and blocked[after][0] < stop:
            after += 1
        touched = [s for s in blocked[k:after] if s[1] > start]
        parts = [(start, stop)] if not touched else outside(start, stop, touched) if pattern == 0 else []
        if parts:
            out.append(Candidate(kind, start, stop, text, parts))
            end = stop
    return out


def train(features: np.ndarray, target: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> list[float]:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (p - target) + penalty * w
        curve = (features * (p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class PiiFinder:
    """Fits the labelers and the classifier on a table, then adds the spans of each text.

    Null texts are empty and have no spans. Spans are in code points, the end
    exclusive, ordered by start and then kind. Without any candidate to learn
    from, only base spans are found.
    """

    def __init__(self, weights: list[float] | None):
        self.weights = weights

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", sample: int = SAMPLE) -> PiiFinder:
        """The vote patterns count every candidate; the classifier learns from about ``sample`` of them, taken by hash."""
        item = T.ArrayType(T.StructType([T.StructField("votes", T.StringType()),
                                         T.StructField("features", T.ArrayType(T.DoubleType()))]))

        def make():
            def work(texts):
                return [[[(votes_of(c), features_of(c)) for c in candidates(t, base_spans(t))] if t else [] for t in texts]]
            return work

        mark = "__candidates"
        seen = append(df.select(text), [text], [(mark, item)], make).select(F.explode(mark).alias("c")).select("c.*")
        seen = checkpoint(seen.groupBy("votes", "features").agg(F.count("*").alias("n")))
        patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
        if not patterns:
            return cls(None)
        model = VoteModel.fit(patterns, LABELERS)
        share = min(1.0, sample / seen.count())
        rows = seen.filter(F.pmod(F.xxhash64("votes", "features"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        rows = rows.select("votes", "features").collect()  # about ``sample`` rows
        return cls(train(np.array([r["features"] for r in rows]).reshape(len(rows), -1),
                         np.array([model.posterior(r["votes"]) for r in rows])) if rows else None)

    def _find(self):
        weights = self.weights

        def find(text: str | None) -> list[tuple[str, int, int]]:
            if not text:
                return []
            spans = base_spans(text)
            if weights is not None:
                spans = sorted(spans + [(a, KINDS.index(c.kind), b) for c in candidates(text, spans)
                                        if sum(w * x for w, x in zip(weights, features_of(c))) >= 0 for a, b in c.parts])
            return [(KINDS[k], a, b) for a, k, b in spans]

        return find

    def spans(self, df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
        """Adds the spans, base ones and those of the classifier."""
        find = self._find()
        return append(df, [text], [(spans, T.ArrayType(SPAN))], lambda: lambda texts: [
            [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts]])

    def redact(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Texts with [KIND] in place of each span; overlapping spans become one, named by the first. Nulls stay null."""
        find = self._find()

        def make():
            def hide(t):
                if t is None:
                    return None
                parts, last = [], 0
                for kind, a, b in find(t):
                    if a >= last:
                        parts += [t[last:a], f"[{kind.upper()}]"]
                    last = max(last, b)
                return "".join([*parts, t[last:]])
            return lambda texts: [[hide(t) for t in texts]]

        return append(df, [text], [(text, T.StringType())], make).select(*own(df))


def written(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Quality rules as weak supervision: each rule votes good, bad or abstains, and the posterior decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import append, own
from tabloom.llm.weak import ABSTAIN, NO, YES, VoteModel

WINDOW = 5

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("""
the of and to in is was for with that on as are this by from or an be it at not have which
der die das und von den mit dem des auf für ist im eine als auch nicht ein zu sich einer
le la les et des en un du une dans est pour par sur qui que avec il au pas plus
el los del las por con una para se no al lo como más pero sus y a de he
""".split())
FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
NOT_SPACE = bytes(b for b in range(256) if b not in b" \t\n\v\f\r")
MARKED = frozenset(b"#*$%&|<>")
ENDINGS = tuple(b".!?\"'):;" [i:i + 1] for i in range(8))

MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
            ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
            ("votes", T.StringType())]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside a window that occurs twice or more, distinct words); exact, by integers for words."""
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    if len(place) == len(words) or len(words) <= WINDOW:
        return 0, len(place)
    n, bits = len(words) - WINDOW + 1, max(1, (len(place) - 1).bit_length())
    code = ids[:n].copy()
    for k in range(1, WINDOW):
        if bits * WINDOW <= 63:
            code = (code << bits) | ids[k:k + n]
        else:
            code = np.unique(code * len(place) + ids[k:k + n], return_inverse=True)[1]
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():
        return 0, len(place)
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum()), len(place)


class Facts:
    """What the rules see of one text."""

    def __init__(self, text: str | None):
        raw = (text or "").encode()
        words = raw.split()
        self.n_words = len(words)
        self.word_chars = len(text or "") - len(raw.translate(None, NOT_SPACE))
        self.n_symbols = len(raw.translate(None, NOT_SYMBOL))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words, self.distinct = repeated_words(words)
        self.base_failed = self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words
        self.letters = len(raw.translate(None, NOT_LETTER))
        self.upper = len(raw.translate(None, NOT_UPPER))
        self.shouts = raw.count(b"!")
        self.function_words = sum(map(FUNCTION_BYTES.__contains__, words))
        self.marked = sum(map(MARKED.__contains__, [w[-1] for w in words]))
        self.stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
        self.ended = sum(x.rstrip().endswith(ENDINGS) for x in lines)


def share(part: str, whole: str, least: int, good: float | None = None, bad: float | None = None,
          low_is_good: bool = True) -> Callable[[Facts], str]:
    """Votes by a share: good on one side of a bound, bad on the other side of a second one, silent without that
    bound, between the two, and below ``least`` of the whole."""
    def vote(f: Facts) -> str:
        total = getattr(f, whole)
        if total < least:
            return ABSTAIN
        x = getattr(f, part) / total
        if bad is not None and (x >= bad if low_is_good else x <= bad):
            return NO
        if good is not None and (x <= good if low_is_good else x >= good):
            return YES
        return ABSTAIN
    return vote


# Rules that look for one defect say nothing where it is absent.
RULES: dict[str, Callable[[Facts], str]] = {
    "symbols": share("n_symbols", "n_words", 1, bad=0.2),
    "marked_words": share("marked", "n_words", 1, bad=0.2),
    "symbol_share": share("n_symbols", "word_chars", 1, bad=0.05),
    "capitals": share("upper", "letters", 20, bad=0.3),
    "exclamations": share("shouts", "n_words", 5, bad=0.15),
    "repeated_windows": share("n_repeat_words", "n_words", 20, bad=0.12),
    "repeated_lines": share("n_dup_lines", "n_lines", 4, bad=0.3),
    "variety": lambda f: ABSTAIN if f.n_words < 50 else NO if f.distinct <= 1.5 * f.n_words ** 0.5 else
    YES if f.distinct >= min(4 * f.n_words ** 0.5, 0.5 * f.n_words) else ABSTAIN,
    "length": lambda f: NO if f.n_words < 10 else YES if f.n_words >= 40 else ABSTAIN,
    "word_length": share("word_chars", "n_words", 30, bad=20),
    "sentence_stops": share("stops", "n_words", 60, good=0.02, bad=0.004, low_is_good=False),
    "sentence_ends": share("ended", "n_lines", 3, good=0.6, bad=0.1, low_is_good=False),
    "function_words": share("function_words", "n_words", 20, good=0.08, bad=0.02, low_is_good=False),
}


def measure(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base measures and the votes, one character a rule. A null text is one of no words."""
    def make():
        rules = list(RULES.values())

        def work(texts):
            facts = [Facts(t) for t in texts]
            base = [[getattr(f, n) for f in facts] for n, _ in MEASURES[:-1]]
            return [*base, ["".join(rule(f) for rule in rules) for f in facts]]

        return work

    return append(df, [text], [(prefix + n, t) for n, t in MEASURES], make)


class QualityRules:
    """Fits the rules' accuracies on all rows of a table and scores rows by the posterior of being good.

    A row is kept if it passes the base rule (10 words or more, at most a fifth
    of them in repeated windows) and the posterior reaches ``threshold``. Null
    and empty texts fail the base rule. Rows are judged one by one, so repeated
    rows get the same verdict; an empty table gives the starting accuracies.
    """

    def __init__(self, model: VoteModel, threshold: float = 0.5):
        self.model, self.threshold = model, threshold

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", threshold: float = 0.5) -> QualityRules:
        return cls.fit_measured(measure(df.select(text), text), threshold)

    @classmethod
    def fit_measured(cls, measured: DataFrame, threshold: float = 0.5) -> QualityRules:
        votes = measured.groupBy("votes").count().collect()  # as many patterns as votes differ, 3 ** 13 at most
        return cls(VoteModel.fit({r["votes"]: r["count"] for r in votes}, len(RULES), prior=0.8), threshold)

    def posterior(self, votes: Column) -> Column:
        """The posterior from the sum of the votes' log odds."""
        odds = F.lit(self.model.odds())
        for i, (yes, no) in enumerate(zip(self.model.yes, self.model.no)):
            v = F.substring(votes, i + 1, 1)
            odds = odds + F.when(v == YES, yes).when(v == NO, no).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def score(self, df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        return self.judge(measure(df, text, prefix), prefix)

    def judge(self, made: DataFrame, prefix: str = "") -> DataFrame:
        """Adds posterior and verdict to measured rows."""
        made = made.withColumn(prefix + "posterior", self.posterior(F.col(prefix + "votes")))
        return made.withColumn(prefix + "kept",
                               ~F.col(prefix + "base_failed") & (F.col(prefix + "posterior") >= self.threshold))

    def keep(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The kept rows, with their own columns only."""
        mark = "__quality_"
        return self.score(df, text, mark).filter(F.col(mark + "kept")).select(*own(df))

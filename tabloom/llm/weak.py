"""Weak supervision: labelers vote or abstain, and expectation-maximisation finds how far each can be trusted.

Spark counts the rows of each vote pattern, so the fit sees every row but holds
only the patterns: 3 to the power of the number of labelers at most.
"""

from __future__ import annotations

import math

YES, NO, ABSTAIN = "+", "-", "0"
ROUNDS = 200
EDGE = 1.1  # a vote is taken to be this much likelier on its own side, at least
START = 1.4  # log odds of one vote before anything is learnt; a no counts twice, as most labelers speak up rarely


class VoteModel:
    """Log odds of "yes" without votes, and those that each labeler's yes and no add; abstaining adds nothing."""

    def __init__(self, prior: float, labelers: int, yes: list[float] | None = None, no: list[float] | None = None):
        self.prior = prior
        self.yes = yes or [START] * labelers
        self.no = no or [-2 * START] * labelers

    @classmethod
    def fit(cls, patterns: dict[str, int], labelers: int, prior: float = 0.5) -> VoteModel:
        """Alternates rows' posteriors and the labelers' vote rates under either class, until they settle.

        Without rows the starting values stay.
        """
        model = cls(prior, labelers)
        total = sum(patterns.values())
        for _ in range(ROUNDS if total else 0):
            good = {p: model.posterior(p) for p in patterns}
            is_yes = sum(n * good[p] for p, n in patterns.items())
            is_no = total - is_yes
            yes, no = [], []
            for i in range(labelers):
                rate = {}
                for vote in (YES, NO):
                    on_yes = sum(n * good[p] for p, n in patterns.items() if p[i] == vote)
                    on_no = sum(n * (1 - good[p]) for p, n in patterns.items() if p[i] == vote)
                    rate[vote] = math.log((on_yes + 0.5) / (is_yes + 1)) - math.log((on_no + 0.5) / (is_no + 1))
                yes.append(max(rate[YES], math.log(EDGE)))
                no.append(min(rate[NO], -math.log(EDGE)))
            new = cls((is_yes + 1) / (total + 2), labelers, yes, no)
            moved = max(abs(a - b) for a, b in zip([new.prior, *new.yes, *new.no], [model.prior, *model.yes, *model.no]))
            model = new
            if moved < 1e-6:
                break
        return model

    def odds(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, pattern: str) -> float:
        odds = self.odds()
        for v, yes, no in zip(pattern, self.yes, self.no):
            odds += yes if v == YES else no if v == NO else 0.0
        return 1 / (1 + math.exp(-min(max(odds, -700.0), 700.0)))

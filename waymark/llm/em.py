"""Expectation-maximisation for votes that may abstain, over counts of vote patterns.

The patterns (one of '+', '-', '0' per rule) are few whatever the size of the
corpus: at most 3 ** rules. Their counts come from a distributed aggregate over
every row, so the fit covers all data and the driver holds only that small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VoteModel:
    """``plus``/``minus``: per rule, the log-odds that a '+' or a '-' vote adds for the good class."""

    prior: float
    plus: tuple[float, ...]
    minus: tuple[float, ...]
    #: Per rule, P('+' | good) and P('-' | bad) among its votes.
    accuracy: tuple[tuple[float, float], ...]

    def log_odds(self, pattern: str) -> float:
        return self.prior + sum(self.plus[i] if v == "+" else self.minus[i] if v == "-" else 0.0 for i, v in enumerate(pattern))

    def log_odds_column(self, votes: list[Column]) -> Column:
        """``votes``: columns of +1, -1 or 0."""
        total = F.lit(self.prior)
        for vote, plus, minus in zip(votes, self.plus, self.minus, strict=True):
            total = total + F.when(vote > 0, F.lit(plus)).when(vote < 0, F.lit(minus)).otherwise(0.0)
        return total


def fit_votes(counts: dict[str, int], rules: int, rounds: int = 100, good_share: float = 0.8,
              start: tuple[float, float] = (0.95, 0.5), most: float = 0.999, prior_weight: float = 20.0) -> VoteModel:
    """Fit class share and rule accuracies to pattern counts.

    Abstaining tells nothing about the class. Accuracies (on good rows, on bad rows)
    start at ``start``, which names the classes, and move freely between 1 - ``most`` and ``most``, but
    for one bound: no rule is worse than chance, so a '+' never counts against a document nor
    a '-' for it. ``prior_weight`` votes at ``start`` are added to each rule,
    which also defines the fit on no data.
    """
    share, acc = good_share, [start] * rules
    patterns = sorted((p, n) for p, n in counts.items() if n > 0)
    for _ in range(rounds):
        model = _model(share, acc)
        good = {p: 1 / (1 + math.exp(-max(-60.0, min(60.0, model.log_odds(p))))) for p, _ in patterns}
        share = (sum(n * good[p] for p, n in patterns) + prior_weight * good_share) / (sum(n for _, n in patterns) + prior_weight)
        share = min(max(share, 1 - most), most)
        acc = []
        for r in range(rules):
            right = [prior_weight * s for s in start]
            all_ = [prior_weight, prior_weight]
            for p, n in patterns:
                if p[r] != "0":
                    all_[0] += n * good[p]
                    all_[1] += n * (1 - good[p])
                    right[p[r] == "-"] += n * (good[p] if p[r] == "+" else 1 - good[p])
            good_right, bad_right = (min(max(a / b, 1 - most), most) for a, b in zip(right, all_, strict=True))
            acc.append((good_right, max(bad_right, 1 - good_right)))
    return _model(share, acc)


def _model(share: float, acc: list[tuple[float, float]]) -> VoteModel:
    return VoteModel(
        math.log(share / (1 - share)),
        tuple(math.log(g / (1 - b)) for g, b in acc),
        tuple(math.log((1 - g) / b) for g, b in acc),
        tuple(acc),
    )

"""Weak supervision: labellers vote good (1), bad (0) or abstain (-1), and expectation-maximisation weighs them.

The data are reduced to the number of rows of each vote pattern, at most 3 ** labellers rows at any size of the corpus, so the
fit covers every row and what reaches the driver is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VoteModel:
    """P(good) and, for each labeller, P(vote | class) over the votes bad, good, abstain."""

    prior: float
    vote: np.ndarray  # labellers x class (bad, good) x vote (bad, good, abstain)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of votes."""
        patterns = np.asarray(patterns, int).reshape(-1, len(self.vote))
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(patterns), 0)
        for j, table in enumerate(self.vote):
            log += np.log(table)[:, patterns[:, j] % 3].T  # -1 % 3 == 2: abstains
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """P(right | a vote was cast) of each labeller."""
        share = np.array([1 - self.prior, self.prior])
        cast = (self.vote[:, :, :2] * share[None, :, None]).sum((1, 2))
        return (self.vote[:, 0, 0] * share[0] + self.vote[:, 1, 1] * share[1]) / np.maximum(cast, 1e-12)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, labellers: int, prior: float = 0.8, rounds: int = 100) -> VoteModel:
    """EM from the belief that each labeller is right four times in five; no rows give that belief."""
    start = np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])
    model = VoteModel(prior, np.repeat(start[None], labellers, 0))
    patterns, counts = np.asarray(patterns, int).reshape(-1, labellers), np.asarray(counts, float)
    if not len(counts):
        return model
    strength = 2.0  # pseudo-counts of the starting belief
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        both = np.stack([counts - good, good])
        table = np.empty((labellers, 2, 3))
        for j in range(labellers):
            for c in (0, 1):
                table[j, c] = np.bincount(patterns[:, j] % 3, both[c], 3) + strength * start[c]
        new = VoteModel(float((both[1].sum() + strength * prior) / (counts.sum() + strength)), table / table.sum(2, keepdims=True))
        if np.abs(new.vote - model.vote).max() < 1e-7:
            return new
        model = new
    return model


def pattern_counts(votes: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Every vote pattern in ``column`` (an array) and its number of rows, over all rows."""
    rows = votes.groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect()
    return np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float)

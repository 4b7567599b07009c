"""The best of each query, kept while rows pass by."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``n`` rows of highest score of each of ``width`` queries, ties by id; scores are compared at 9 places."""

    def __init__(self, n: int, width: int, above: float, including: bool = False) -> None:
        """Only scores above ``above`` count, or those that reach it too if ``including``."""
        self.n, self.above, self.including = n, above, including
        self.q, self.ids, self.score = np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        # What a row must reach to be looked at: the n-th best so far, less what rounding may add.
        self.bar = np.full(width, -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list | np.ndarray, scores: np.ndarray) -> None:
        """``scores``: queries by rows."""
        bar, extra = self.bar, scores.shape[1] - self.n
        if extra > 0 and len(free := np.flatnonzero(np.isinf(bar))):
            bar = bar.copy()
            bar[free] = np.partition(scores[free], extra, axis=1)[:, extra] - 2e-9
        seen = scores >= bar[:, None]
        seen &= scores >= self.above if self.including else scores > self.above
        q, at = np.nonzero(seen)
        if len(q):
            named = np.empty(len(ids), object)
            named[:] = ids
            self.new.append((q, named[at], scores[q, at]))
        if sum(len(x[0]) for x in self.new) >= self.n * len(self.bar):
            self.merge()

    def merge(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip((self.q, self.ids, self.score), *self.new, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score.round(9), q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, stays = place == self.n - 1, place < self.n
        self.bar[q[last]] = score[last] - 2e-9
        self.q, self.ids, self.score, self.new = q[stays], ids[stays], score[stays], []

    def rows(self) -> tuple[list, list, np.ndarray]:
        """The queries' numbers, ids and scores."""
        self.merge()
        return self.q.tolist(), self.ids.tolist(), self.score

"""The k best rows of every query, kept in a task while a table goes by, so that pairs are never exchanged."""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int64).max


class Best:
    """Of each of n queries the k rows with the smallest key (a whole number), ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.bound = k, np.full(n, _NONE)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, max(1_000_000, 4 * n * k)

    def offer(self, query: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        """Rows of which no query has as many better ones yet; places of queries, ids and keys."""
        fit = key <= self.bound[query]
        self.rows.append((query[fit].astype(np.int32), ids[fit], key[fit]))
        self.held += int(fit.sum())
        if self.held > self.most:
            self.prune()

    def prune(self) -> None:
        query, ids, key = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((ids, key, query))
        query, ids, key = query[order], ids[order], key[order]
        starts = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1] if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = place == self.k - 1
        self.bound[query[last]] = key[last]
        keep = place < self.k
        self.rows, self.held = [(query[keep], ids[keep], key[keep])], int(keep.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.prune()
        return self.rows[0]

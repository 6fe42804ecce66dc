"""Links inside a block of rows: label merging on dense link matrices, for the pair operators."""

from __future__ import annotations

import numpy as np


class Merger:
    """Keeps a label (smallest id reached so far) for each owner of a block while visitors stream by.

    ``add`` takes the link matrix of one run of visitors. Every label change is kept as an
    edge between the old and the new label, so the edges connect all ids that are linked,
    although only the labels stay in memory.
    """

    def __init__(self, owners: np.ndarray):
        self.owners = owners
        self.label = owners.copy()
        self._edges: list[np.ndarray] = []

    def add(self, link: np.ndarray, visitors: np.ndarray) -> None:
        """link[o, v]: owner o and visitor v are linked."""
        rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if not len(rows):
            return
        sub = link[np.ix_(rows, cols)]
        mine, theirs = self.label[rows], visitors[cols].copy()
        top = np.iinfo(np.int64).max
        while True:
            theirs_new = np.minimum(theirs, np.where(sub, mine[:, None], top).min(axis=0))
            mine_new = np.minimum(mine, np.where(sub, theirs_new[None, :], top).min(axis=1))
            if (mine_new == mine).all() and (theirs_new == theirs).all():
                break
            mine, theirs = mine_new, theirs_new
        self._put(visitors[cols], theirs)
        self._put(self.label[rows], mine)
        self.label[rows] = mine

    def _put(self, a: np.ndarray, b: np.ndarray) -> None:
        odd = a != b
        if odd.any():
            self._edges.append(np.unique(np.stack([a[odd], b[odd]]), axis=1))

    def edges(self) -> np.ndarray:
        """(2, n) distinct edges, larger id first."""
        self._put(self.owners, self.label)
        if not self._edges:
            return np.zeros((2, 0), np.int64)
        return np.unique(np.concatenate(self._edges, axis=1), axis=1)

"""A vantage-point tree over unit vectors, and searches of many queries in it at once.

The tree is an order of its rows: the row at the beginning of a range is the vantage point of the others, which follow
in two halves, the nearer ones first. A node keeps the least and the greatest distance of each half to its vantage
point, so that the triangle inequality bounds how near a half can come to a query. Ranges of up to ``LEAF`` rows are
compared whole.
"""

from __future__ import annotations

import numpy as np

LEAF = 64
#: Queries of a block that take the halves of a node in an order of their own, at least.
TOGETHER = 96
#: Bounds are distances of unit vectors, whose rounding is below this.
SLACK = 1e-7


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which changes no cosine, so that no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (points @ to)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows. Sums run over the components in order, so that a pair's value depends on no other."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def grow(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows in the tree, and for each vantage point in that order the bounds of its halves: near, far."""
    unit, order, bounds = units(scaled(vectors)), np.arange(len(vectors)), np.zeros((len(vectors), 4))
    ranges = [(0, len(vectors))]
    while ranges:
        a, b = ranges.pop()
        if b - a <= LEAF:
            continue
        # the row farthest from the first one spreads the others best
        far = a + int(distances(unit[order[a:b]], unit[order[a]]).argmax())
        order[a], order[far] = order[far], order[a]
        away = distances(unit[order[a + 1 : b]], unit[order[a]])
        line = np.argsort(away, kind="stable")
        order[a + 1 : b], away = order[a + 1 : b][line], away[line]
        half = (b - a) // 2
        bounds[a] = away[0], away[half - 1], away[half], away[-1]
        ranges += [(a + 1, a + 1 + half), (a + 1 + half, b)]
    return order, bounds


class Search:
    """The ``k`` nearest rows of each query so far: by greater cosine, then smaller id."""

    def __init__(self, queries: np.ndarray, k: int, reach: np.ndarray | None = None, factor: float = 1.0):
        self.queries, self.unit = scaled(queries), units(scaled(queries))
        self.k, self.factor, self.compared = k, factor, 0
        n = len(queries)
        self.reach = np.full(n, np.inf) if reach is None else reach.copy()
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def _compare(self, who: np.ndarray, near: np.ndarray, tree: Tree, a: int) -> None:
        """Takes what can matter of the rows from ``a`` on, whose cosines to the queries ``who`` are about ``near``."""
        self.compared += near.size
        least = np.maximum(1 - self.reach[who] ** 2 / 2, self.scores[who, -1]) - SLACK
        q, r = np.nonzero(near >= least[:, None])
        if not len(q):
            return
        owners = who[q]
        score = cosines(self.queries[owners], tree.vectors[a + r])
        touched, at = np.unique(owners, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        score = np.concatenate([self.scores[touched].ravel(), score])
        ids = np.concatenate([self.ids[touched].ravel(), tree.ids[a + r]])
        line = np.lexsort((ids, -score, owner))
        first = np.searchsorted(owner[line], np.arange(len(touched)))
        best = line[first[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = score[best], ids[best]
        kth = self.scores[touched, -1]
        self.reach[touched] = np.minimum(self.reach[touched], np.where(np.isfinite(kth), np.sqrt(np.maximum(0, 2 - 2 * kth)), np.inf))

    def visit(self, tree: Tree) -> None:
        if len(tree.ids) and len(self.queries):
            self._visit(tree, 0, len(tree.ids), np.arange(len(self.queries)))

    def _visit(self, tree: Tree, a: int, b: int, who: np.ndarray) -> None:
        if b - a <= LEAF:
            self._compare(who, self.unit[who] @ tree.unit[a:b].T, tree, a)
            return
        near = self.unit[who] @ tree.unit[a]
        self._compare(who, near[:, None], tree, a)
        away = np.sqrt(np.maximum(0.0, 2 - 2 * near))
        half, (n0, n1, f0, f1) = a + 1 + (b - a) // 2, tree.bounds[a]
        inner, outer = np.maximum(n0 - away, away - n1), np.maximum(f0 - away, away - f1)
        first = inner <= outer
        if min(first.sum(), (~first).sum()) < TOGETHER:
            # too few to go their own way: all take the order that suits most
            first[:] = 2 * first.sum() >= len(first)
        for mine, steps in ((first, ((inner, a + 1, half), (outer, half, b))), (~first, ((outer, half, b), (inner, a + 1, half)))):
            for bound, lo, hi in steps:
                # what has been found on the way narrows the second half's search
                go = mine & (bound * self.factor <= self.reach[who] + SLACK)
                if go.any():
                    self._visit(tree, lo, hi, who[go])


class Tree:
    """A tree as it is stored: ids and vectors in its order, and its bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray):
        self.ids, self.vectors, self.bounds = ids, scaled(vectors), bounds
        self.unit = units(self.vectors)

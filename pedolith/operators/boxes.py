"""Exact searches by distance among many points: a tree of boxes in numpy, walked by blocks of near queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a leaf, and queries of a block.
LEAF = 32
#: The level where walks start: many nodes take numpy no longer than one.
START = 6


def squared(differences) -> np.ndarray:
    """Sum of the squares of arrays, one a column, always added in the same order."""
    return sum(x * x for x in differences)


def between(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each query of a block to each point."""
    return squared(x[:, None] - y[None] for x, y in zip(block.T, np.ascontiguousarray(points.T), strict=True))


def at_rank(values: np.ndarray, rows: np.ndarray, rank: int) -> float:
    """The value of the row of that rank, from 0, where each value stands for so many rows."""
    order = np.argsort(values)
    return values[order[np.searchsorted(np.cumsum(rows[order]), rank, "right")]]


def distinct_points(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of some columns without null or NaN, on the driver, and the number of rows of each."""
    long = df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)]).dropna()
    found = long.groupBy(*long.columns).agg(F.count("*").alias("n")).toArrow()
    return np.stack([found[c].to_numpy() for c in long.columns], axis=1).reshape(-1, len(columns)), found["n"].to_numpy()


class Boxes:
    """Points in a balanced tree of boxes, each with the number of rows that lie on it.

    Node k of a level holds points k n / 2^level to (k + 1) n / 2^level of their order in the tree. Distances and the
    bounds from boxes are the same sums, and rounding keeps order, so no bound lies on the wrong side of a distance:
    what the walks leave out cannot matter."""

    def __init__(self, points: np.ndarray, rows: np.ndarray | None = None):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        self.start = min(START, self.depth)
        self.order = np.arange(n)
        for level in range(self.depth):
            for k in range(1 << level):
                lo, mid, hi = n * k >> level, n * (2 * k + 1) >> (level + 1), n * (k + 1) >> level
                x = points[self.order[lo:hi]]
                axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(x[:, axis], mid - lo)]
        self.points = points[self.order]
        self.rows = np.ones(n, np.int64) if rows is None else np.asarray(rows, np.int64)[self.order]
        self.total = int(self.rows.sum())
        self.starts = np.array([n * k >> self.depth for k in range((1 << self.depth) + 1)])
        if not n:
            return
        first = self.starts[:-1]
        levels = [(np.minimum.reduceat(self.points, first), np.maximum.reduceat(self.points, first), np.add.reduceat(self.rows, first))]
        for _ in range(self.depth):
            lo, hi, m = levels[-1]
            levels.append((np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), m[::2] + m[1::2]))
        self.levels = levels[::-1]

    @property
    def leaves(self) -> int:
        return len(self.starts) - 1 if len(self.points) else 0

    def leaf(self, k: int) -> slice:
        """Where in the tree's order the points of a leaf are: a block of near points."""
        return slice(self.starts[k], self.starts[k + 1])

    def _bounds(self, level: int, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Least and greatest squared distance from a box to each node, and the nodes' rows."""
        a, b, m = self.levels[level]
        a, b = a[nodes], b[nodes]
        return squared(np.maximum(np.maximum(a - hi, lo - b), 0.0).T), squared(np.maximum(b - lo, hi - a).T), m[nodes]

    def _members(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the points of some leaves."""
        n = self.starts[nodes + 1] - self.starts[nodes]
        return np.repeat(self.starts[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def ranked(self, block: np.ndarray, first: int, last: int) -> np.ndarray:
        """Squared distances from each query of a block to its first-th and last-th nearest row, from 0; 0 <= first <= last < total.

        A node is inside if all its points are nearer than any query's first-th row can be, and beyond if none can be as
        near as the last-th: only what is neither is split, and only those leaves are measured."""
        lo, hi = block.min(axis=0), block.max(axis=0)
        nodes, inside = np.arange(1 << self.start), 0
        for level in range(self.start, self.depth + 1):
            if level > self.start:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            near, far, m = self._bounds(level, nodes, lo, hi)
            least, most = at_rank(near, m, first - inside), at_rank(far, m, last - inside)
            within = far < least
            inside += int(m[within].sum())
            nodes = nodes[~within & (near <= most)]
        at = self._members(nodes)
        y, m = self.points[at], self.rows[at]
        k = [first - inside, last - inside]
        out = np.empty((len(block), 2))
        for i in range(0, len(block), some := max(1, (1 << 21) // len(at))):
            d = between(block[i : i + some], y)
            if m.sum() <= 4 * len(m):
                d = np.repeat(d, m, axis=1) if m.sum() > len(m) else d
                out[i : i + some] = np.partition(d, sorted(set(k)), axis=1)[:, k]
            else:
                order = np.argsort(d, axis=1)
                rows = np.cumsum(m[order], axis=1)
                for c, rank in enumerate(k):
                    column = (rows > rank).argmax(axis=1)[:, None]
                    out[i : i + some, c] = np.take_along_axis(d, np.take_along_axis(order, column, axis=1), axis=1)[:, 0]
        return out

    def rows_where(self, block: np.ndarray, scale: np.ndarray, near_enough) -> np.ndarray:
        """Per query of a block the number of rows for which near_enough(squared distance, the query's scale) holds: it
        must hold for less where it holds for more, and for a larger scale where it holds for a smaller one."""
        out = np.zeros(len(block), np.int64)
        if not len(block) or not len(self.points):
            return out
        lo, hi = block.min(axis=0), block.max(axis=0)
        nodes = np.arange(1 << self.start)
        for level in range(self.start, self.depth + 1):
            if level > self.start:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            near, far, m = self._bounds(level, nodes, lo, hi)
            within = near_enough(far, scale.min())
            out += m[within].sum()
            nodes = nodes[~within & near_enough(near, scale.max())]
        at = self._members(nodes)
        if len(at):
            y, m = self.points[at], self.rows[at]
            for i in range(0, len(block), some := max(1, (1 << 21) // len(at))):
                out[i : i + some] += near_enough(between(block[i : i + some], y), scale[i : i + some, None]) @ m
        return out

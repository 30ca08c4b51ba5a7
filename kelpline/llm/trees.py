"""Gradient-boosted trees that are fitted on the driver from a few thousand labelled rows
and run as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Boosted:
    """Trees for the logistic loss. A tree is a number, or (feature, cut, at most cut, above)."""

    def __init__(self, names: list[str], base: float, trees: list, slope: float = 1.0, shift: float = 0.0):
        self.names, self.base, self.trees, self.slope, self.shift = names, base, trees, slope, shift

    @classmethod
    def fit(cls, names: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> "Boosted":
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        base = float(np.log(mean / (1 - mean)))
        f, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = cls._grow(x, y - p, p * (1 - p), depth, rate, least)
            trees.append(tree)
            f = f + cls._run(tree, x)
        return cls(names, base, trees)

    @classmethod
    def _grow(cls, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: float):
        leaf = float(rate * g.sum() / (h.sum() + 1))
        best = (1e-6, None, None)
        for j in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= cut
                hl = h[left].sum()
                if min(left.sum(), (~left).sum()) >= least:
                    gl = g[left].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                    best = max(best, (gain, j, float(cut)), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], *(cls._grow(x[s], g[s], h[s], depth - 1, rate, least) for s in (left, ~left)))

    @classmethod
    def _run(cls, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], cls._run(tree[2], x), cls._run(tree[3], x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._run(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Platt scaling on rows that the trees were not fitted on."""
        m, y = self.margin(x), (y * (y.sum() + 1) + (1 - y)) / (np.where(y > 0, y.sum(), (1 - y).sum()) + 2)
        w = np.array([1.0, 0.0])
        a = np.stack([m, np.ones(len(m))], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p))
            w = w + step / max(1.0, np.abs(step).max())
        self.slope, self.shift = float(w[0]), float(w[1])
        return self

    def table(self) -> Column:
        """The trees as one array literal. Each is a full tree of the greatest depth: node i has the
        children 2i and 2i + 1, the number of a feature and its cut; a leaf above that depth stands
        for all below it."""
        depth = max(map(self._depth, self.trees), default=0)

        def fill(tree, i: int, level: int, node: dict, leaf: dict) -> None:
            if level == depth:
                leaf[i] = tree
                return
            feature, cut, low, high = tree if isinstance(tree, tuple) else (0, 0.0, tree, tree)
            node[i] = (feature + 1, cut)
            fill(low, 2 * i, level + 1, node, leaf)
            fill(high, 2 * i + 1, level + 1, node, leaf)

        rows = []
        for tree in self.trees:
            node, leaf = {}, {}
            fill(tree, 1, 0, node, leaf)
            numbers = [",".join(str(node[i][0]) for i in sorted(node)), ",".join(f"{node[i][1]!r}D" for i in sorted(node)), ",".join(f"{leaf[i]!r}D" for i in sorted(leaf))]
            rows.append("named_struct('feature',array({}),'cut',array({}),'leaf',array({}))".format(*numbers))
        return F.expr(f"array({','.join(rows)})")

    @classmethod
    def _depth(cls, tree) -> int:
        return 1 + max(cls._depth(t) for t in tree[2:]) if isinstance(tree, tuple) else 0

    def probability(self, features: Column) -> Column:
        """Of an array of the features, in the order of ``names``. The trees are data, so the
        expression has the same few nodes whatever they are."""
        depth = max(map(self._depth, self.trees), default=0)
        if not depth:
            return F.lit(1 / (1 + float(np.exp(-((self.base + sum(self.trees)) * self.slope + self.shift)))))

        def leaf(t: Column) -> Column:
            step = lambda i, _: 2 * i + (F.element_at(features, F.element_at(t["feature"], i)) > F.element_at(t["cut"], i)).cast("int")
            return F.element_at(t["leaf"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) - F.lit((1 << depth) - 1))

        margin = F.aggregate(self.table(), F.lit(self.base), lambda a, t: a + leaf(t))
        return 1 / (1 + F.exp(-(margin * self.slope + self.shift)))

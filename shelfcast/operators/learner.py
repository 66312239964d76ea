"""Quantile boosting: leaf-wise trees, their splits, predictions and Shapley values.

This module has what is small: choosing a split from the histograms of one leaf,
growing a tree best leaf first from what is known of its nodes, walking trees, and
exact additive explanations of them. ``boosting`` fits trees to tables with it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 60
    learning_rate: float = 0.1
    #: Leaves of a tree, and levels at most (None: any); a level is a pass over the rows.
    leaves: int = 16
    depth: int | None = 5
    bins: int = 64
    min_leaf: int = 20
    l2: float = 1.0
    #: Shares of the features of a tree and of the rows of ``bagging_freq`` rounds (0: all rows).
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    seed: int = 42
    log_sales: bool = True


@dataclass(frozen=True)
class Split:
    """Rows up to bin ``cut`` of a feature, or with a bin in ``cats``, go left."""

    gain: float
    feature: int
    cut: int
    cats: tuple[int, ...] | None
    n_left: int


def best_split(counts: np.ndarray, above: np.ndarray, n: int, n_above: int, quantile: float, config: BoostConfig, features: list[int], categorical: frozenset[int], used: list[int]) -> Split | None:
    """The split of a leaf with the largest gain; None if no split helps.

    counts[k, bin] are rows of features[k], above[k, bin] those whose target is
    over the forecast: a row's gradient of the pinball loss is the quantile there
    and the quantile less one elsewhere. Ties go to the first feature and cut.
    Categories are ordered by their mean gradient, and cut in that order.
    """
    best: Split | None = None
    whole = (n_above - (1 - quantile) * n) ** 2 / (n + config.l2)
    for k, f in enumerate(features):
        width = used[f]
        c, a = counts[k, :width].astype(np.float64), above[k, :width].astype(np.float64)
        order = None
        if f in categorical:
            there = np.flatnonzero(c)
            order = there[np.argsort((a[there] - (1 - quantile) * c[there]) / (c[there] + config.l2), kind="stable")]
            c, a = c[order], a[order]
        if len(c) < 2:
            continue
        nl, al = np.cumsum(c)[:-1], np.cumsum(a)[:-1]
        nr, ar = n - nl, n_above - al
        gain = (al - (1 - quantile) * nl) ** 2 / (nl + config.l2) + (ar - (1 - quantile) * nr) ** 2 / (nr + config.l2) - whole
        gain[(nl < config.min_leaf) | (nr < config.min_leaf)] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > 1e-9 and (best is None or gain[at] > best.gain):
            cats = None if order is None else tuple(sorted(int(x) for x in order[: at + 1]))
            best = Split(float(gain[at]), f, at, cats, int(nl[at]))
    return best


@dataclass
class Growing:
    """A tree being grown: what is known of its nodes, by number.

    Nodes are numbered as they are opened. A node is known once its best split, or
    that there is none, is; the children of a node that is split are opened.
    """

    n: int
    config: BoostConfig
    sizes: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    splits: dict[int, Split | None] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._open(self.n, 0)

    def _open(self, n: int, depth: int) -> int:
        self.sizes.append(n)
        self.depths.append(depth)
        at = len(self.sizes) - 1
        if n < 2 * self.config.min_leaf or (self.config.depth is not None and depth >= self.config.depth) or self.config.leaves < 2:
            self.splits[at] = None
        return at

    def chosen(self) -> list[int]:
        """Nodes split when the known leaf of most gain is always split next.

        What is split among the known ones when all are known is a subset of this,
        so only children of these nodes need to be looked at.
        """
        heap = [(-s.gain, 0) for s in [self.splits.get(0)] if s]
        out: list[int] = []
        while heap and len(out) < self.config.leaves - 1:
            _, at = heapq.heappop(heap)
            out.append(at)
            for child in self.children.get(at, ()):
                if s := self.splits.get(child):
                    heapq.heappush(heap, (-s.gain, child))
        return out

    def wanted(self) -> list[int]:
        """Nodes whose best split has to be found next; none when the tree is grown."""
        if 0 not in self.splits:
            return [0]
        for at in self.chosen():
            if at not in self.children:
                s = self.splits[at]
                self.children[at] = (self._open(s.n_left, self.depths[at] + 1), self._open(self.sizes[at] - s.n_left, self.depths[at] + 1))
        return [c for at in self.chosen() for c in self.children[at] if c not in self.splits]

    def tree(self, edges: list[np.ndarray], partial: bool = False) -> Tree:
        """The tree of the chosen splits; of all opened nodes if ``partial``."""
        split = set(self.children if partial else self.chosen())
        number = {0: 0}
        order = [0]
        for at in order:
            if at in split:
                for c in self.children[at]:
                    number[c] = len(order)
                    order.append(c)
        m = len(order)
        t = Tree(np.full(m, -1, np.int32), np.zeros(m), np.zeros(m, np.int32), [None] * m, [None] * m, np.full((m, 2), -1, np.int32), np.zeros(m), np.array([self.sizes[at] for at in order], np.int64), order)
        for at in order:
            if at in split:
                s, k = self.splits[at], number[at]
                t.feature[k], t.cut[k] = s.feature, s.cut
                t.below[k] = [number[c] for c in self.children[at]]
                if s.cats is None:
                    t.threshold[k] = edges[s.feature][s.cut]
                else:
                    t.bins[k] = np.array(s.cats)
                    t.cats[k] = edges[s.feature][list(s.cats)]
        return t


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at leaves. ``cut`` and ``bins`` are of
    binned rows, ``threshold`` and ``cats`` of values; ``cover`` counts training rows."""

    feature: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray
    bins: list[np.ndarray | None]
    cats: list[np.ndarray | None]
    below: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    opened: list[int] = field(default_factory=list)

    def left(self, k: int, column: np.ndarray, binned: bool) -> np.ndarray:
        if self.cats[k] is not None:
            return np.isin(column, self.bins[k] if binned else self.cats[k])
        return column <= (self.cut[k] if binned else self.threshold[k])

    def leaf(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """Number of the leaf of each row."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            k, rows = stack.pop()
            if self.feature[k] < 0:
                out[rows] = k
                continue
            left = self.left(k, x[rows, self.feature[k]], binned)
            stack += [(int(self.below[k, 0]), rows[left]), (int(self.below[k, 1]), rows[~left])]
        return out

    def paths(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """Each leaf with the (node, side) above it, from the root down."""
        out, stack = [], [(0, [])]
        while stack:
            k, path = stack.pop()
            if self.feature[k] < 0:
                out.append((k, path))
            else:
                stack += [(int(self.below[k, side]), [*path, (k, side)]) for side in (0, 1)]
        return out

    def mean(self) -> float:
        leaves = self.feature < 0
        return float(np.average(self.value[leaves], weights=self.cover[leaves])) if self.cover[leaves].sum() else float(self.value[0])

    def explain(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the Shapley values of the tree to ``out`` [row, feature].

        What is known of a set of features is the mean over the leaves, where a
        split on a feature outside the set is followed both ways by the shares of
        its training rows. A leaf's share in that is a product over the features
        on its path: of whether the row agrees with it there, or of the share of rows
        that go its way. Rows that agree with the same features of a path have the
        same values, so these are worked out once for each pattern.
        """
        for leaf, path in self.paths():
            if not path:
                continue
            features = list(dict.fromkeys(int(self.feature[k]) for k, _ in path))
            share = np.ones(len(features))
            code = np.full(len(x), (1 << len(features)) - 1, np.int64)
            for k, side in path:
                f = features.index(int(self.feature[k]))
                share[f] *= self.cover[self.below[k, side]] / max(1, self.cover[k])
                agrees = self.left(k, x[:, self.feature[k]], False) == (side == 0)
                code &= ~(np.where(agrees, 0, 1).astype(np.int64) << f)
            kinds, of = np.unique(code, return_inverse=True)
            ones = (kinds[:, None] >> np.arange(len(features)) & 1).astype(np.float64)
            given = self.value[leaf] * _path_values(ones, share)
            for f, name in enumerate(features):
                out[:, name] += given[of, f]


def _path_values(ones: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[pattern, feature] Shapley values of a product game.

    The worth of a set is the product of ``ones`` inside it and of ``share`` outside.
    For each feature the others' sets are summed by size, as the coefficients of
    the product of (share + ones t), then weighed as Shapley values are.
    """
    m = len(share)
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    out = np.zeros_like(ones)
    for f in range(m):
        by_size = np.zeros((len(ones), m))
        by_size[:, 0] = 1.0
        for g in range(m):
            if g != f:
                grown = by_size * share[g]
                grown[:, 1:] += by_size[:, :-1] * ones[:, g : g + 1]
                by_size = grown
        out[:, f] = (ones[:, f] - share[f]) * (by_size @ weight)
    return out


@dataclass
class Boosted:
    """Trees of one quantile: a forecast is ``start`` and the values of its leaves."""

    quantile: float
    start: float
    n_rows: int = 0
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.value[t.leaf(x)]
        return out

    def explain(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Base value and [row, feature] contributions; they add up to the prediction."""
        shap = np.zeros(x.shape)
        for t in self.trees:
            t.explain(x, shap)
        return self.start + sum(t.mean() for t in self.trees), shap

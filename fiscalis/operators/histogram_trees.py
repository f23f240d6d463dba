"""Growing regression trees from histograms, in tasks and across tasks alike.

A row is a vector of bin numbers. A tree grows in passes: each pass counts, for the nodes made
by the pass before, how many rows and how much target every bin of every column holds; from these sums
alone the best cuts follow. Of two sister nodes only the smaller is counted, the other is
their parent less it. Targets are fixed-point integers, so that sums are exact: they do not depend on how rows
are dealt to tasks, and neither does a tree.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

BINS = 128


@dataclass(frozen=True)
class Rules:
    """How an ensemble grows. Boosting fits each tree to what the trees before left over; a forest
    fits all trees to the target, each with its own Poisson weights of the rows."""
    trees: int = 300
    rate: float = 0.05       # of boosting; 0 for a forest
    depth: int | None = 4    # None: no limit
    leaves: int | None = None  # grow leaf by leaf, best gain first, up to so many
    penalty: float = 0.0     # added to the rows of a node, in its gain and its value
    least_rows: int = 1      # of a node
    seed: int = 42

    @property
    def boosted(self) -> bool:
        return self.rate > 0


@dataclass
class Tree:
    """Nodes by number; 0 is the root, the children of i are left[i] and left[i] + 1, a leaf has left 0."""
    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray


def step(bins: np.ndarray, at: np.ndarray, column: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node of each row one level further down, or the same where it is a leaf."""
    below = left[at]
    side = bins[np.arange(len(at)), column[at]] > cut[at]
    return np.where(below > 0, below + side, at)


def descend(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(bins), dtype=np.int64)
    while (left[at] > 0).any():
        at = step(bins, at, column, cut, left)
    return at


def poisson_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weights from the row's number, the same wherever the row is worked on."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 2_654_435_761 + seed * 40_503 + 1) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(below, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")


def count(bins: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray | None, wanted: list[int]) -> np.ndarray:
    """(node, 2, column, bin): rows and target of each wanted node; exact, as all sums stay below 2^53."""
    columns = bins.shape[1]
    place = np.full(max(int(at.max(initial=0)), max(wanted)) + 1, -1, dtype=np.int64)
    place[wanted] = np.arange(len(wanted))
    slot = place[at]
    held = np.flatnonzero(slot >= 0)
    size = len(wanted) * columns * BINS
    where = ((slot[held, None] * columns + np.arange(columns)) * BINS + bins[held]).ravel()
    n = np.ones(len(held)) if weight is None else weight[held].astype(np.float64)
    out = np.empty((len(wanted), 2, columns, BINS))
    out[:, 0] = np.bincount(where, np.repeat(n, columns), size).reshape(len(wanted), columns, BINS)
    out[:, 1] = np.bincount(where, np.repeat(n * target[held], columns), size).reshape(len(wanted), columns, BINS)
    return out


class Grower:
    """One tree as it grows. `wanted` names the nodes that the next pass has to count."""

    def __init__(self, rules: Rules, scale: float):
        self.rules, self.scale = rules, scale
        self.column, self.bin, self.left, self.depth = [0], [0], [0], [0]
        self.rows, self.target, self.gain, self.best = [0.0], [0.0], [0.0], [(0, 0, 0.0)]
        self.held: dict[int, np.ndarray] = {}
        self.wanted, self.sister, self.parent = [0], {}, {}

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.column), np.array(self.bin), np.array(self.left)

    def counted(self, sums: np.ndarray) -> None:
        """Take the sums of the wanted nodes and grow on."""
        fresh = list(self.wanted)
        for node, histogram in zip(self.wanted, sums, strict=True):
            self.held[node] = histogram
            if node in self.sister:
                other = self.sister[node]
                self.held[other] = self.held[self.parent[node]] - histogram
                fresh.append(other)
        for node in {self.parent[n] for n in self.wanted if n in self.parent}:
            del self.held[node]
        self._cuts(sorted(fresh))
        self.wanted = []
        for node in self._chosen(sorted(fresh)):
            self._split(node)

    def _cuts(self, nodes: list[int]) -> None:
        """The best cut of each node: the largest gain, then the first column, then the first bin."""
        sums, penalty = np.stack([self.held[n] for n in nodes]), self.rules.penalty
        n, g = sums[:, 0], sums[:, 1] / self.scale
        left_n, left_g = np.cumsum(n, axis=2), np.cumsum(sums[:, 1], axis=2) / self.scale
        whole_n, whole_g = n[:, :1].sum(axis=2, keepdims=True), left_g[:, :1, -1:]
        right_n, right_g = whole_n - left_n, whole_g - left_g
        able = (left_n >= self.rules.least_rows) & (right_n >= self.rules.least_rows) & (left_n > 0) & (right_n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = left_g ** 2 / (left_n + penalty) + right_g ** 2 / (right_n + penalty) - whole_g ** 2 / (whole_n + penalty)
        gains = np.where(able, gains, -np.inf).reshape(len(nodes), -1)
        first = gains.argmax(axis=1)
        for i, node in enumerate(nodes):
            self.rows[node], self.target[node] = float(whole_n[i, 0, 0]), float(whole_g[i, 0, 0])
            gain = float(gains[i, first[i]])
            floor = 1e-12 * float((g[i, 0] ** 2).sum())
            column, cut = divmod(int(first[i]), BINS)
            self.gain[node] = gain if gain > floor else 0.0
            if not self.gain[node] or self.depth[node] == self.rules.depth:
                self.held.pop(node)  # a leaf for good
            self.best[node] = (column, cut, float(left_n[i, column, cut]))

    def _chosen(self, fresh: list[int]) -> list[int]:
        """The nodes that are split now."""
        if self.rules.leaves is None:
            return [n for n in fresh if self.gain[n] > 0 and (self.rules.depth is None or self.depth[n] < self.rules.depth)]
        # As if no node could be split further than known; whatever the true order takes is among these.
        return [n for n in self._in_order() if not self.left[n]]

    def _in_order(self) -> list[int]:
        """The splits that are made best gain first, as far as gains are known."""
        queue, taken = [(-self.gain[0], 0)], []
        while queue and len(taken) < self.rules.leaves - 1:
            gain, node = heapq.heappop(queue)
            if gain >= 0 or (self.rules.depth is not None and self.depth[node] >= self.rules.depth):
                continue
            taken.append(node)
            for child in (self.left[node], self.left[node] + 1) if self.left[node] else ():
                heapq.heappush(queue, (-self.gain[child], child))
        return taken

    def _split(self, node: int) -> None:
        column, cut, left_rows = self.best[node]
        child = len(self.left)
        self.column[node], self.bin[node], self.left[node] = column, cut, child
        for values, fresh in ((self.column, 0), (self.bin, 0), (self.left, 0), (self.depth, self.depth[node] + 1), (self.rows, 0.0),
                              (self.target, 0.0), (self.gain, 0.0), (self.best, (0, 0, 0.0))):
            values += [fresh, fresh]
        small = child if 2 * left_rows <= self.rows[node] else child + 1
        self.wanted.append(small)
        self.sister[small], self.parent[small] = 2 * child + 1 - small, node

    def finish(self) -> Tree:
        """The grown tree; splits that the order of gains leaves out are taken back."""
        column, cut, left = self.arrays()
        gain = np.array(self.gain)
        if self.rules.leaves is not None:
            out = np.ones(len(left), dtype=bool)
            out[self._in_order()] = False
            left = np.where(out, 0, left)
        value = np.array(self.target) / np.maximum(np.array(self.rows) + self.rules.penalty, 1e-300)
        keep, todo = [], [0]
        while todo:  # only nodes that can be reached, parents first
            node = todo.pop()
            keep.append(node)
            todo += [left[node], left[node] + 1] if left[node] else []
        keep = np.array(sorted(keep))
        number = np.zeros(len(left), dtype=np.int64)
        number[keep] = np.arange(len(keep))
        inner = left[keep] > 0
        return Tree(column[keep], cut[keep], np.where(inner, number[left[keep]], 0), value[keep], np.where(inner, gain[keep], 0.0), np.array(self.rows)[keep])


def fixed_scale(rows: int, largest: float) -> float:
    """A power of two that turns targets into integers whose weighted sums stay below 2^53."""
    room = 2 * max(largest, 1e-300) * max(rows, 1) * 8
    return float(2.0 ** np.floor(52 - np.log2(room)))


def integers(target: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(target * scale)


def grow_whole(bins: np.ndarray, target: np.ndarray, numbers: np.ndarray, rules: Rules, base: float, scale: float) -> list[Tree]:
    """All trees of one region whose rows are at hand."""
    trees, margin = [], np.full(len(target), base)
    for i in range(rules.trees):
        grower = Grower(rules, scale)
        weight = None if rules.boosted else poisson_weights(numbers, i, rules.seed)
        goal = integers(target - margin if rules.boosted else target, scale)
        at = np.zeros(len(target), dtype=np.int64)
        while grower.wanted:
            grower.counted(count(bins, at, goal, weight, grower.wanted))
            at = step(bins, at, *grower.arrays())
        trees.append(grower.finish())
        if rules.boosted:
            margin += rules.rate * trees[-1].value[descend(bins, trees[-1].column, trees[-1].bin, trees[-1].left)]
    return trees

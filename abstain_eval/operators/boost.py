"""Boosted regression trees for chained imputation: quantised columns, level by level.

A forest is arrays of nodes: every tree is complete, its splits in heap order and then its
leaves. Trees grow from histograms: for each node of a level and each value of each
column, the sum of residuals and the number of rows, from which the best split of every node is
read off. Columns of up to ``MAX_BINS`` values have a bin for each, so splits are exact; others
are cut at quantiles.

Residuals are whole numbers of a column's unit, about ``2 ** UNIT_BITS`` of them to its span, and so
are leaves. Sums are then exact: they are the same in whatever parts and order rows are added, and
``grow`` finds the same trees in one block of rows as in many.

Nothing here knows of Spark: these are the per-task steps of ``impute.boosted_rounds``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

MAX_BINS = 512
CODED_SPLITS = 7  # trees up to this size are looked up by the bits of all their splits
NO_SPLIT = -1
UNIT_BITS = 27
JOINT_BINS = 6144  # columns of few bins are counted together


@dataclass
class Forest:
    """``features`` and ``thresholds`` are [tree, split], ``leaves`` [tree, leaf]; rows above a threshold go right."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    @cached_property
    def by_code(self) -> np.ndarray:
        """[tree * code]: the leaf reached if bit i of the code says that split i goes right."""
        splits = self.features.shape[1]
        codes, at = np.arange(1 << splits), np.zeros(1 << splits, np.int64)
        for _ in range((splits + 1).bit_length() - 1):
            at = 2 * at + 1 + (codes >> at & 1)
        return self.leaves[:, at - splits].ravel()

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """One value for each row of a matrix of all columns."""
        if self.features.shape[1] <= CODED_SPLITS:
            return self._predict_by_code(rows)
        return self._predict_by_level(rows)

    def _predict_by_code(self, rows: np.ndarray) -> np.ndarray:
        """All splits of a tree are compared, column by column, and the bits looked up."""
        out, (trees, splits) = np.full(len(rows), self.base), self.features.shape
        first = np.arange(trees) << splits
        for start in range(0, len(rows), 1024):  # bounds the [tree, row] matrices
            part = np.ascontiguousarray(rows[start : start + 1024].T)
            code = np.zeros((trees, part.shape[1]), np.uint8)
            for split in range(splits):
                right = part[np.maximum(self.features[:, split], 0)] > self.thresholds[:, split, None]
                code |= right.view(np.uint8) << np.uint8(split)
            out[start : start + 1024] += self.by_code.take(np.ascontiguousarray(code.T) + first).sum(1)
        return out

    def _predict_by_level(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        trees, splits = np.arange(len(self.features)), self.features.shape[1]
        for start in range(0, len(rows), 4096):  # bounds the [row, tree] matrices
            part = rows[start : start + 4096]
            at = np.zeros((len(part), len(trees)), np.int64)
            for _ in range((splits + 1).bit_length() - 1):
                feature = self.features[trees, at]
                right = np.take_along_axis(part, np.maximum(feature, 0), 1) > self.thresholds[trees, at]
                at = 2 * at + 1 + right
            out[start : start + 4096] += self.leaves[trees, at - splits].sum(1)
        return out


@dataclass
class Summary:
    """The values of a column, ascending, and how many cells each stands for: itself and those since the one before."""

    values: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(cells: np.ndarray) -> Summary:
        return Summary(*np.unique(cells, return_counts=True))

    def merged(self, other: Summary) -> Summary:
        values, place = np.unique(np.concatenate([self.values, other.values]), return_inverse=True)
        weights = np.bincount(place, np.concatenate([self.weights, other.weights]), len(values))
        return Summary(values, weights.astype(np.int64))

    def short(self, most: int) -> Summary:
        """At most ``most`` of the values, at even steps of rank; all if there are no more."""
        if len(self.values) <= most:
            return self
        running = np.cumsum(self.weights)
        at = np.unique(np.searchsorted(running, np.arange(1, most + 1) / most * running[-1], side="left").clip(max=len(running) - 1))
        return Summary(self.values[at], np.diff(running[at], prepend=0))

    def bin_values(self) -> np.ndarray:
        """The values that have a bin: all of them, or those at quantiles."""
        if len(self.values) <= MAX_BINS:
            return self.values
        rank = np.floor(np.arange(1, MAX_BINS + 1) / MAX_BINS * (self.weights.sum() - 1))
        return self.values[np.unique(np.searchsorted(np.cumsum(self.weights), rank, side="right"))]


class Bins:
    """The bins of all columns side by side, one range of bin numbers for each column."""

    def __init__(self, values: list[np.ndarray]):
        self.values = values
        self.bounds = [(v[1:] + v[:-1]) / 2 for v in values]
        sizes = np.array([len(v) for v in values], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.total = int(sizes.sum())
        self.ranges = [slice(a, a + n) for a, n in zip(self.starts.tolist(), sizes.tolist(), strict=True)]
        self.column_of = np.repeat(np.arange(len(values)), sizes)
        self.last = np.zeros(self.total, bool)
        self.last[self.starts + sizes - 1] = True
        self.groups: list[list[int]] = []
        for i in np.argsort(-sizes, kind="stable").tolist():
            room = (g for g in self.groups if np.prod(sizes[[*g, i]]) <= JOINT_BINS)
            if (group := next(room, None)) is None:
                self.groups.append([i])
            else:
                group.append(i)
        self.shapes = [tuple(sizes[g].tolist()) for g in self.groups]

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """The bin of every cell of a [column, row] matrix, counted from its column's first."""
        out = np.empty(cells.shape, np.uint8 if max(map(len, self.bounds), default=0) < 256 else np.int16)
        for i, bounds in enumerate(self.bounds):
            out[i] = np.searchsorted(bounds, cells[i], side="left")
        return out

    def joint(self, codes: np.ndarray) -> np.ndarray:
        """One code for each group of columns: a histogram of it holds those of all its columns."""
        out = np.empty((len(self.groups), codes.shape[1]), np.int16)
        for group, shape, into in zip(self.groups, self.shapes, out, strict=True):
            into[:] = codes[group[0]]
            for i, size in zip(group[1:], shape[1:], strict=True):
                into *= np.int16(size)
                into += codes[i]
        return out

    def spread(self, group: int, histogram: np.ndarray, out: np.ndarray) -> None:
        """The histograms of a group's columns out of their joint one."""
        shape, columns = self.shapes[group], self.groups[group]
        joint = histogram.reshape(shape)
        for axis, i in enumerate(columns):
            out[self.ranges[i]] = joint.sum(axis=tuple(a for a in range(len(shape)) if a != axis)) if len(shape) > 1 else joint


@dataclass
class Target:
    """A column to be explained by ``inputs``: its mean in whole units, and the unit."""

    column: int
    inputs: list[int]
    base: float
    unit: float

    @staticmethod
    def of(column: int, inputs: list[int], mean: float, least: float, largest: float) -> Target:
        span = max(largest - mean, mean - least)
        if not 0 < span < np.inf:
            return Target(column, inputs if span == 0 else [], mean, 1.0)
        unit = 2.0 ** max(int(np.ceil(np.log2(span))) - UNIT_BITS, -1000)
        return Target(column, inputs, float(np.rint(mean / unit) * unit), unit)

    def residual(self, cells: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """What the base leaves of the cells, in units; 0 where the cell is missing."""
        return np.where(seen, np.rint((cells - self.base) / self.unit), 0.0) if self.inputs else np.zeros(len(cells))


@dataclass
class Tree:
    """One tree of each target: input columns, bins after which to split, and leaves in units."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray


class Block:
    """Some rows: the bins of their cells, and of each target what is left to explain."""

    def __init__(self, bins: Bins, targets: list[Target], codes: np.ndarray, residual: np.ndarray, seen: np.ndarray):
        self.bins, self.targets, self.codes, self.residual, self.seen = bins, targets, codes, residual, seen
        self.joint = bins.joint(codes)

    def places(self, tree: Tree, j: int, levels: int) -> np.ndarray:
        """The node of every row after some levels of a target's tree."""
        node = np.zeros(self.codes.shape[1], np.uint8 if levels <= 8 else np.intp)
        for level in range(levels):
            right = np.zeros(len(node), bool)
            for i in range(1 << level):
                place = (1 << level) - 1 + i
                feature = tree.features[j, place]
                if feature != NO_SPLIT:
                    here = self.codes[feature] > int(tree.cuts[j, place])
                    right |= here & (node == i) if level else here
            node += node
            node += right
        return node

    def subtract(self, *trees: Tree) -> None:
        """Take the leaves of grown trees off what is left."""
        for j in range(len(self.targets)):
            learned = [t for t in trees if t.leaves[j].any()]
            if learned:
                levels = learned[0].leaves.shape[1].bit_length() - 1
                self.residual[j] -= sum(t.leaves[j].take(self.places(t, j, levels)) for t in learned) * self.seen[j]

    def counts(self) -> np.ndarray:
        """[target, bin]: the rows with a known target."""
        out = np.zeros((len(self.targets), self.bins.total), np.int64)
        for g, shape in enumerate(self.bins.shapes):
            codes = self.joint[g].astype(np.intp)
            for j in range(len(self.targets)):
                self.bins.spread(g, np.bincount(codes[self.seen[j]], minlength=math.prod(shape)), out[j])
        return out

    def root_sums(self, some: list[int]) -> np.ndarray:
        """[target, bin]: the sums of residuals, for some targets."""
        out = np.zeros((len(some), self.bins.total), np.int64)
        for g, shape in enumerate(self.bins.shapes):
            codes = self.joint[g].astype(np.intp)
            for k, j in enumerate(some):
                self.bins.spread(g, np.bincount(codes, self.residual[j], math.prod(shape)), out[k])
        return out

    def _children(self, some: list[int], tree: Tree, level: int, right: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Of every split above ``level`` the target, the parent and the rows of one child, the right one if so told."""
        parents = 1 << (level - 1)
        for k, j in enumerate(some):
            node = self.places(tree, j, level - 1)
            for p in range(parents):
                feature, cut = tree.features[j, parents - 1 + p], int(tree.cuts[j, parents - 1 + p])
                if feature != NO_SPLIT:
                    rows = ((self.codes[feature] > cut) == right[j, p]) & self.seen[j]
                    yield k, j, p, np.flatnonzero(rows & (node == p) if level > 1 else rows)

    def child_sums(self, some: list[int], tree: Tree, level: int, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[target, parent, bin]: sums and counts of one child of every split above ``level``."""
        sums, counts = (np.zeros((len(some), 1 << (level - 1), self.bins.total), np.int64) for _ in range(2))
        for k, j, p, rows in self._children(some, tree, level, right):
            residual = self.residual[j].take(rows)
            for g, shape in enumerate(self.bins.shapes):
                codes = self.joint[g].take(rows).astype(np.intp)
                self.bins.spread(g, np.bincount(codes, residual, math.prod(shape)), sums[k, p])
                self.bins.spread(g, np.bincount(codes, minlength=math.prod(shape)), counts[k, p])
        return sums, counts

    def child_counts(self, some: list[int], tree: Tree, level: int, right: np.ndarray) -> np.ndarray:
        """The counts of ``child_sums`` alone."""
        counts = np.zeros((len(some), 1 << (level - 1), self.bins.total), np.int64)
        for k, _, p, rows in self._children(some, tree, level, right):
            for g, shape in enumerate(self.bins.shapes):
                codes = self.joint[g].take(rows).astype(np.intp)
                self.bins.spread(g, np.bincount(codes, minlength=math.prod(shape)), counts[k, p])
        return counts


def _halves(whole: np.ndarray, less: np.ndarray, split: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Both children of every parent out of the parents and one child each; without a split all rows go left."""
    more = np.where(split[..., None], whole - less, whole)
    left = (right | ~split)[..., None]
    both = np.stack([np.where(left, more, less), np.where(left, less, more)], axis=2)
    return both.reshape(len(whole), 2 * whole.shape[1], -1)


def _best_splits(bins: Bins, inputs: np.ndarray, sums: np.ndarray, counts: np.ndarray, all_sums: np.ndarray, all_counts: np.ndarray) -> tuple:
    """For each node of a target the bin after which to split, or NO_SPLIT, and the sum and count up to it."""
    nodes = np.arange(len(sums))

    def up_to(values: np.ndarray) -> np.ndarray:
        running = np.cumsum(values, axis=1)
        before = np.concatenate([np.zeros((len(values), 1), np.int64), running], axis=1)[:, bins.starts]
        return running - before[:, bins.column_of]

    left, n_left = up_to(sums), up_to(counts)
    right, n_right = all_sums[:, None] - left, all_counts[:, None] - n_left
    useful = (n_left > 0) & (n_right > 0) & ~bins.last & inputs
    parts = left.astype(float) ** 2 / np.maximum(n_left, 1) + right.astype(float) ** 2 / np.maximum(n_right, 1)
    gain = np.where(useful, parts - (all_sums.astype(float) ** 2 / np.maximum(all_counts, 1))[:, None], -np.inf)
    best = gain.argmax(1)
    # A split that explains less than a unit of each row is made of rounding.
    least = np.maximum(all_counts, 1e-12 * parts[nodes, best])
    return np.where(gain[nodes, best] > least, best, NO_SPLIT), left[nodes, best], n_left[nodes, best]


def grow(bins: Bins, targets: list[Target], rows, trees: int, depth: int, step: float) -> list[Forest]:
    """Boost trees for all targets side by side.

    ``rows`` is a ``Block`` or what adds up many: it has ``counts``, ``root_sums``, ``child_sums``, ``child_counts`` and
    ``subtract``. Of two children only the smaller one is summed; the other one is what it leaves of their parent. A
    tree takes one number off all rows of a leaf, so counts of the leaves give the sums that the next one starts from.
    """
    splits, leaves, n = (1 << depth) - 1, 1 << depth, len(targets)
    forests = [
        Forest(t.base, np.full((trees, splits), NO_SPLIT, np.int32), np.full((trees, splits), np.inf), np.zeros((trees, leaves)))
        for t in targets
    ]
    some = [j for j, t in enumerate(targets) if t.inputs]
    if not some or not trees:
        return forests
    known = rows.counts()
    inputs = [np.isin(bins.column_of, t.inputs) for t in targets]
    number = {j: known[j, bins.ranges[targets[j].inputs[0]]].sum() for j in some}
    some = [j for j in some if number[j]]
    root = np.zeros((n, bins.total), np.int64)
    root[some] = rows.root_sums(some) if some else 0
    for place in range(trees):
        if not some:
            break
        tree = Tree(np.full((n, splits), NO_SPLIT, np.int32), np.zeros((n, splits), np.int16), np.zeros((n, leaves)))
        right = np.zeros((n, leaves), bool)
        sums, counts = root[some][:, None], known[some][:, None]
        all_sums = np.stack([sums[k, :, bins.ranges[targets[j].inputs[0]]].sum(1) for k, j in enumerate(some)])
        all_counts = np.array([[number[j]] for j in some])
        for level in range(depth):
            nodes = 1 << level
            below_sums, below_counts = (np.zeros((len(some), 2 * nodes), np.int64) for _ in range(2))
            for k, j in enumerate(some):
                best, left, n_left = _best_splits(bins, inputs[j], sums[k], counts[k], all_sums[k], all_counts[k])
                for i in range(nodes):
                    if best[i] == NO_SPLIT:  # all rows go left
                        below_sums[k, 2 * i], below_counts[k, 2 * i] = all_sums[k, i], all_counts[k, i]
                        continue
                    column = bins.column_of[best[i]]
                    later = np.flatnonzero(known[j, best[i] + 1 : bins.ranges[column].stop])[0]
                    values, cut = bins.values[column], best[i] - bins.starts[column]
                    tree.features[j, nodes - 1 + i], tree.cuts[j, nodes - 1 + i] = column, cut
                    forests[j].thresholds[place, nodes - 1 + i] = (values[cut] + values[cut + 1 + later]) / 2
                    below_sums[k, 2 * i : 2 * i + 2] = left[i], all_sums[k, i] - left[i]
                    below_counts[k, 2 * i : 2 * i + 2] = n_left[i], all_counts[k, i] - n_left[i]
                    right[j, i] = 2 * n_left[i] > all_counts[k, i]
            all_sums, all_counts = below_sums, below_counts
            if level + 1 == depth or (tree.features == NO_SPLIT).all():
                break
            less_sums, less_counts = rows.child_sums(some, tree, level + 1, right)
            split = tree.features[some, nodes - 1 : 2 * nodes - 1] != NO_SPLIT
            sums = _halves(sums, less_sums, split, right[some, :nodes])
            counts = _halves(counts, less_counts, split, right[some, :nodes])
        ends = all_sums.shape[1]
        for k, j in enumerate(some):
            tree.leaves[j, :: leaves // ends] = np.rint(step * all_sums[k] / np.maximum(all_counts[k], 1))
            forests[j].features[place], forests[j].leaves[place] = tree.features[j], tree.leaves[j] * targets[j].unit
        still = [k for k, j in enumerate(some) if (tree.features[j] != NO_SPLIT).any()]  # of others nothing is left to explain
        some = [some[k] for k in still]
        if some and place + 1 < trees:
            rows.subtract(tree)
            less = rows.child_counts(some, tree, depth, right)
            split = tree.features[some, leaves // 2 - 1 :] != NO_SPLIT
            in_leaves = _halves(counts[still], less, split, right[some, : leaves // 2])
            root[some] -= np.einsum("jlb,jl->jb", in_leaves, tree.leaves[some].astype(np.int64))
    return forests


def grown(rows: np.ndarray, columns: list[int], target: np.ndarray, trees: int, depth: int, step: float) -> Forest:
    """Boost regression trees for ``target`` on some columns of a matrix of rows."""
    if not len(target):
        return grow(Bins([]), [Target(0, [], 0.0, 1.0)], None, trees, depth, step)[0]
    bins = Bins([Summary.of(cells).bin_values() for cells in rows.T])
    goal = Target.of(-1, columns, float(target.mean()), float(target.min()), float(target.max()))
    seen = np.ones((1, len(target)), bool)
    block = Block(bins, [goal], bins.codes(rows.T), goal.residual(target, seen[0])[None], seen)
    return grow(bins, [goal], block, trees, depth, step)[0]

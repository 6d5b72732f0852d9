"""Histogram trees over binned cells: the arithmetic that tasks share.

A cell is a vector of bin codes with a label and a count. ``best_splits`` sees
sums per (node, feature, bin) only, so it gives the same split whether one task
made the sums or many did. Draws hash (seed, tree, node or cell), so a tree does
not depend on where or in which order it is grown.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

_U = np.uint64
#: Node numbers are those of a heap, so no tree is deeper than this.
DEEPEST = 60


@dataclass(frozen=True)
class Recipe:
    """How the trees of one fit are grown.

    ``kind`` is forest (votes are averaged) or boost (values are added). ``split``
    is gini, random (one hashed cut per feature), variance or newton.
    """

    kind: str
    trees: int
    depth: int
    split: str
    subset: str = "all"  # features looked at per node: sqrt, log2, all
    per_tree: float = 1.0  # share of the features each tree may use
    bootstrap: bool = False
    sample: float = 1.0  # share of the rows each tree sees
    min_leaf: float = 1.0  # rows per leaf
    min_split: float = 2.0  # rows per node that is split
    min_hessian: float = 0.0
    min_gain: float = 0.0
    l2: float = 0.0
    rate: float = 0.1
    leaves: int = 0  # most leaves, best gain first; 0: no limit
    level: bool = False  # one split for all nodes of a level
    centred: bool = True  # start from the log-odds
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays: the row goes to ``left`` if its code of ``feature`` is at most ``cut``, else to the next node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    depth: int = 0

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            here = at[rows]
            to = self.left[here] + (codes[rows, self.feature[here]] > self.cut[here])
            at[rows] = to
            rows = rows[to != here]  # a leaf leads to itself
            if not len(rows):
                break
        return at


@dataclass
class Cells:
    """Binned rows that share codes, label and fold, with their number; ``edges`` are the bin edges per feature."""

    codes: np.ndarray  # cells x features, uint8
    y: np.ndarray
    n: np.ndarray
    fold: np.ndarray
    edges: list[np.ndarray] = field(default_factory=list)


def scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: even bits out of any numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def draw(*keys) -> np.ndarray:
    """Hashed uniforms in (0, 1) for numbers or arrays of numbers."""
    h = np.zeros(1, _U)
    for k in keys:
        h = scrambled(h + _U(0x9E3779B97F4A7C15) + np.asarray(k).astype(_U))
    return ((h >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


def cell_hash(cells: Cells) -> np.ndarray:
    h = cells.y.astype(_U) * _U(31) + cells.fold.astype(_U)
    for j in range(cells.codes.shape[1]):
        h = scrambled(h * _U(1099511628211) + cells.codes[:, j].astype(_U) + _U(j + 1))
    return h


def drawn_counts(u: np.ndarray, n: np.ndarray, share: float | None) -> np.ndarray:
    """Counts drawn for cells of n rows from one uniform each: Poisson(n), or Binomial(n, share)."""
    out = np.zeros(len(n))
    if share is not None and (alone := n == 1).any():  # most cells of a large table
        out[alone] = u[alone] > 1.0 - share
        if not alone.all():
            out[~alone] = drawn_counts(u[~alone], n[~alone], share)
        return out
    mean = n * (1.0 if share is None else share)
    small = mean <= 30
    if share is not None:
        small &= n <= 60
    if small.any():
        v, m, size = u[small], mean[small], n[small]
        p = np.exp(-m) if share is None else (1.0 - share) ** size
        total, k = p.copy(), np.zeros(len(m))
        for step in range(1, 120):
            more = v > total
            if not more.any():
                break
            p = p * (m / step if share is None else np.maximum(size - step + 1, 0) / step * share / (1.0 - share))
            k[more] = step
            total = total + p
        out[small] = k if share is None else np.minimum(k, size)
    if not small.all():
        from statistics import NormalDist

        z = np.array([NormalDist().inv_cdf(float(v)) for v in u[~small]])
        spread = np.sqrt(mean[~small] * (1.0 if share is None else 1.0 - share))
        out[~small] = np.maximum(np.round(mean[~small] + z * spread), 0)
        if share is not None:
            out[~small] = np.minimum(out[~small], n[~small])
    return out


def tree_weights(recipe: Recipe, tree: int, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weight of each cell in one tree."""
    if recipe.bootstrap:
        return drawn_counts(draw(recipe.seed, tree, hashes), n, None)
    if recipe.sample < 1.0:
        return drawn_counts(draw(recipe.seed, tree, hashes), n, recipe.sample)
    return n.astype(np.float64)


def offsets_of(edges: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)


def histogram(places: np.ndarray, node: np.ndarray, stats: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums of each statistic per (node, bin of any feature); ``places`` are codes moved by the features' offsets."""
    at = (node[:, None] * width + places).ravel()
    features = places.shape[1]
    return np.stack([np.bincount(at, weights=np.repeat(s, features), minlength=nodes * width).reshape(nodes, width) for s in stats])


def feature_counts(subset: str, features: int) -> int:
    if subset == "sqrt":
        return max(1, int(np.sqrt(features)))
    if subset == "log2":
        return max(1, int(np.log2(features)))
    return features


def tree_features(recipe: Recipe, tree: int, allowed: np.ndarray) -> np.ndarray:
    """The features one tree may use, as a mask."""
    if recipe.per_tree >= 1.0:
        return allowed
    kept = max(1, int(recipe.per_tree * allowed.sum()))
    order = np.where(allowed, draw(recipe.seed, tree, 7, np.arange(len(allowed))), 2.0)
    mask = np.zeros(len(allowed), bool)
    mask[np.argsort(order, kind="stable")[:kept]] = True
    return mask


def _within(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums over the bins of each feature."""
    total = np.cumsum(sums, axis=-1)
    before = np.concatenate([np.zeros((*total.shape[:-1], 1)), total], axis=-1)[..., offsets[:-1]]
    return total - np.repeat(before, np.diff(offsets), axis=-1)


def worth_splitting(recipe: Recipe, totals: np.ndarray) -> np.ndarray:
    """Which nodes could be split by their totals; where a level shares its split, all take part."""
    if recipe.level:
        return np.ones(totals.shape[1], bool)
    enough = totals[0] >= max(recipe.min_split, 2 * recipe.min_leaf)
    return enough & (totals[1] > 0) & (totals[1] < totals[0]) if recipe.kind == "forest" else enough


def best_splits(recipe: Recipe, tree: int, names: np.ndarray, sums: np.ndarray, offsets: np.ndarray, edges: list[np.ndarray], allowed: np.ndarray, totals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), cut, gain and totals of every node, from its sums.

    Statistics are (rows, rows of class 1) for gini and random splits, (rows,
    gradient, hessian) for the others. The first of equally good cuts is taken.
    """
    nodes, features = sums.shape[1], len(edges)
    left = _within(sums, offsets)
    if totals is None:
        totals = left[:, :, offsets[1] - 1]  # the sum over any feature's bins
    if recipe.split == "random":  # one cut a feature is all that is looked at
        place, useful = _random_cuts(recipe, tree, names, sums[0], offsets, edges)
        left = np.take_along_axis(left, place[None], axis=2)
        feature_of = np.arange(features)
    else:
        place, useful, feature_of = None, None, np.repeat(np.arange(features), np.diff(offsets))
    right = totals[:, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if recipe.kind == "forest":
            part = lambda s: (s[1] ** 2 + (s[0] - s[1]) ** 2) / s[0]
            gain = part(left) + part(right) - part(totals)[:, None]
        else:
            weight = 0 if recipe.split == "variance" else 2
            part = lambda s: s[1] ** 2 / (s[weight] + recipe.l2)
            gain = 0.5 * (part(left) + part(right) - part(totals)[:, None])
    valid = real = (left[0] > 0) & (right[0] > 0)
    if recipe.min_leaf > 1:
        valid = real & (left[0] >= recipe.min_leaf) & (right[0] >= recipe.min_leaf)
    if recipe.min_hessian:
        valid = valid & (left[2] >= recipe.min_hessian) & (right[2] >= recipe.min_hessian)
    # Features with two filled bins or more, of which each node looks at its own few.
    if useful is None:
        useful = np.logical_or.reduceat(real, offsets[:-1], axis=1)
    useful &= allowed
    wanted = feature_counts(recipe.subset, int(allowed.sum()))
    if wanted < allowed.sum():
        order = np.where(useful, draw(recipe.seed, tree, names[:, None], 11, np.arange(features)[None, :]).reshape(nodes, features), 2.0)
        rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
        useful &= rank < wanted
    valid = valid & useful[:, feature_of]
    gain = np.where(valid, gain, -np.inf)
    rows = np.arange(nodes)
    if recipe.level:
        # The gains of a cut over all nodes; nodes it does not divide keep their rows together.
        added = np.where(valid, gain, 0.0).sum(axis=0)
        at = np.full(nodes, int(np.argmax(added)))
        best = np.full(nodes, added.max())
        hit = (best > recipe.min_gain) & valid.any()
        own = np.where(np.isfinite(gain[rows, at]), gain[rows, at], 0.0)
    else:
        at = np.argmax(gain, axis=1)
        best = own = gain[rows, at]
        least = -1e-9 if recipe.kind == "forest" else max(recipe.min_gain, 1e-12)
        hit = worth_splitting(recipe, totals) & (best > least)
    feature = np.where(hit, feature_of[at], -1)
    cut = (at if place is None else place[rows, at]) - offsets[feature_of[at]]
    return feature, cut, np.where(hit, np.maximum(own, 0.0), 0.0), totals


def _random_cuts(recipe: Recipe, tree: int, names: np.ndarray, rows: np.ndarray, offsets: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of one cut per (node, feature), drawn evenly between the edges around the node's smallest and largest value, and where there is one."""
    place, there = np.tile(offsets[:-1], (len(names), 1)), np.zeros((len(names), len(edges)), bool)
    filled = rows > 0
    for f, e in enumerate(edges):
        if not len(e):
            continue
        own = filled[:, offsets[f] : offsets[f + 1]]
        low, high = own.argmax(axis=1), own.shape[1] - 1 - own[:, ::-1].argmax(axis=1)
        ok = np.flatnonzero((high > low) & own[np.arange(len(own)), low])
        a, b = e[low[ok]], e[high[ok] - 1]
        value = a + (b - a) * draw(recipe.seed, tree, names[ok], 13, f)
        place[ok, f] += np.clip(np.searchsorted(e, value, side="right") - 1, low[ok], high[ok] - 1)
        there[ok, f] = True
    return place, there


class Growing:
    """A tree while it is grown, a level at a time; nodes are numbered level by level."""

    def __init__(self, recipe: Recipe, tree: int, name: int = 1, depth: int = 0):
        self.recipe, self.tree, self.depth, self.top = recipe, tree, depth, depth
        self.names = np.array([name], np.int64)  # of the open nodes
        self.closed = 0  # nodes of the levels above
        self.levels: list[tuple[np.ndarray, ...]] = []  # feature, cut, gain, left, totals

    @property
    def open(self) -> int:
        return len(self.names)

    def deep(self) -> bool:
        return self.depth >= min(self.recipe.depth, DEEPEST)

    def take(self, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Put the splits of the open level in; returns per node the number of its left child in the next level, or -1."""
        n = len(self.names)
        if self.deep():
            feature = np.full(n, -1)
        split = np.flatnonzero(feature >= 0)
        child = np.full(n, -1)
        child[split] = 2 * np.arange(len(split))
        self.closed += n
        self.levels.append((feature, cut, gain, np.where(child >= 0, self.closed + child, 0), totals))
        self.names = (2 * self.names[split][:, None] + np.arange(2)).ravel()
        self.depth += 1
        return child

    def _joined(self) -> list[np.ndarray]:
        n = len(self.names)
        levels = self.levels
        if n:  # open nodes are leaves for now
            channels = levels[0][4].shape[0] if levels else 3
            levels = [*levels, (np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n, int), np.zeros((channels, n)))]
        return [np.concatenate(parts, axis=-1) for parts in zip(*levels)]

    def _as_tree(self, feature, cut, left, value, gain, depth) -> Tree:
        leaf = feature < 0  # leads to itself whatever the code
        feature, cut, left = np.where(leaf, 0, feature), np.where(leaf, 255, cut), np.where(leaf, np.arange(len(left)), left)
        return Tree(feature.astype(np.int16), cut.astype(np.int16), left.astype(np.int32), value, np.where(leaf, 0.0, gain), depth)

    def finished_so_far(self) -> Tree:
        """The nodes there are, for finding the open node of a row; values are not set."""
        feature, cut, gain, left, _ = self._joined()
        return self._as_tree(feature, cut, left, np.zeros(len(feature)), gain, self.depth - self.top)

    def open_numbers(self) -> np.ndarray:
        """Number of each node among the open ones, or -1."""
        return np.concatenate([np.full(self.closed, -1), np.arange(self.open)])

    def finished(self) -> Tree:
        feature, cut, gain, left, totals = self._joined()
        if self.recipe.leaves:
            self._keep_best(feature, left, gain)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.recipe.kind == "forest":
                value = totals[1] / totals[0]
            else:
                value = -self.recipe.rate * totals[1] / (totals[2] + self.recipe.l2)
        return self._as_tree(feature, cut, left, np.where(np.isfinite(value), value, 0.0), gain, max(0, self.depth - self.top - 1))

    def _keep_best(self, feature, left, gain) -> None:
        """Split the leaf of largest gain again and again, as far as the leaves go; the other splits are taken back."""
        import heapq

        kept, heap = set(), [(-gain[0], 0)] if feature[0] >= 0 else []
        while heap and len(kept) + 1 < self.recipe.leaves:
            _, i = heapq.heappop(heap)
            kept.add(i)
            for child in (left[i], left[i] + 1):
                if feature[child] >= 0:
                    heapq.heappush(heap, (-gain[child], int(child)))
        for i in range(len(feature)):
            if i not in kept:
                feature[i] = -1


def grow(recipe: Recipe, tree: int, codes: np.ndarray, stats: np.ndarray, edges: list[np.ndarray], allowed: np.ndarray, name: int = 1, depth: int = 0) -> Tree:
    """One tree, or the part of it below a node, on cells at hand."""
    offsets = offsets_of(edges)
    allowed = tree_features(recipe, tree, allowed)
    growing = Growing(recipe, tree, name, depth)
    # Only the bins of features that may be used are summed; the others stay empty.
    used = np.flatnonzero(allowed)
    column = np.zeros(len(edges), np.int64)
    column[used] = np.arange(len(used))
    places = (codes[:, used] + offsets[:-1][used]).astype(np.int32)
    rows = np.flatnonzero(stats[0] > 0)
    places, stats = places.take(rows, axis=0), stats.take(rows, axis=1)
    node = np.zeros(len(rows), np.int64)
    while growing.open:
        n = growing.open
        totals = np.stack([np.bincount(node, weights=s, minlength=n) for s in stats])
        feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        wide = np.flatnonzero(worth_splitting(recipe, totals)) if len(used) and not growing.deep() else np.zeros(0, int)
        if len(wide):
            number = np.full(n, -1)
            number[wide] = np.arange(len(wide))
            if len(wide) < n:
                rows = np.flatnonzero(number[node] >= 0)
                places, stats, node = places.take(rows, axis=0), stats.take(rows, axis=1), node[rows]
            sums = histogram(places, number[node], stats, len(wide), int(offsets[-1]))
            feature[wide], cut[wide], gain[wide] = best_splits(recipe, tree, growing.names[wide], sums, offsets, edges, allowed, totals[:, wide])[:3]
        child = growing.take(feature, cut, gain, totals)
        if not growing.open:
            break
        rows = np.flatnonzero(child[node] >= 0)
        node = node[rows]
        if len(rows) < len(places):
            places, stats = places.take(rows, axis=0), stats.take(rows, axis=1)
        f = feature[node]
        right = places[np.arange(len(node)), column[f]] > cut[node] + offsets[f]
        node = child[node] + right
    return growing.finished()


@dataclass(frozen=True)
class Moves:
    """Where the cells of one level go; arrays by node number."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # the left child, -1 for nodes that are not split now


class BoostedPart:
    """The part of the cells that a task sums for boosted trees: their margins, and the node of each in the tree being grown.

    ``sums`` brings the part to any tree and level from wherever it stands, so it may be
    made anew at any time. Cells are worked on in slices that stay in the processor's cache.
    """

    SLICE = 1 << 16

    def __init__(self, recipe: Recipe, cells: Cells, base: float):
        self.recipe, self.edges = recipe, cells.edges
        self.offsets = offsets_of(cells.edges)
        self.size = len(cells.y)
        self.codes = np.ascontiguousarray(cells.codes.T)  # features x cells
        self.y, self.n = cells.y, cells.n
        self.hashes = cell_hash(cells) if recipe.sample < 1.0 else None
        self.margin = np.full(self.size, base)
        self.at = np.zeros(self.size, np.int32)  # the node of each cell
        self.g, self.h, self.weight = np.zeros(self.size), np.zeros(self.size), None
        self.groups = self._grouped([len(e) + 1 for e in cells.edges])
        self.joint = [self._joint(group) for group in self.groups]
        self.stands = (0, 0)  # trees added to the margins, levels moved in the next one
        self.started = -1

    def sums(self, before: Sequence[tuple[list[Moves], np.ndarray]], moves: list[Moves], slot: np.ndarray, nodes: int, used: np.ndarray) -> np.ndarray:
        """(3, nodes, bins) of the nodes with a slot, after the trees ``before`` (their moves and values) and some moves of the next one."""
        tree, level = self.stands
        while tree < len(before):
            past, value = before[tree]
            for m in past[level:]:
                self._move(m)
            for s in self._slices():
                self.margin[s] += value[self.at[s]]
            self.at[:] = 0
            tree, level = tree + 1, 0
        for m in moves[level:]:
            self._move(m)
        self.stands = (tree, len(moves))
        if self.started != tree:
            self._start(tree)
            self.started = tree
        return self._summed(slot, nodes, used)

    def reaches(self, trees: int, levels: int) -> bool:
        return self.stands <= (trees, levels)

    def _grouped(self, bins: list[int]) -> list[list[int]]:
        """Features with few bins share a code, so that they are summed at once."""
        out, small = [[f] for f, b in enumerate(bins) if b > 16], [f for f, b in enumerate(bins) if b <= 16]
        product = 257
        for f in small:
            if product * bins[f] > 256:
                out.append([])
                product = 1
            out[-1].append(f)
            product *= bins[f]
        return out

    def _joint(self, group: list[int]) -> tuple[np.ndarray, int]:
        """The shared code of a group's features per cell, and how many codes there are."""
        code, width = self.codes[group[0]], len(self.edges[group[0]]) + 1
        for f in group[1:]:
            bins = len(self.edges[f]) + 1
            code, width = code * np.uint8(bins) + self.codes[f], width * bins
        return code, width

    def _slices(self):
        return (slice(a, min(a + self.SLICE, self.size)) for a in range(0, self.size, self.SLICE))

    def _start(self, tree: int) -> None:
        for s in self._slices():
            n = self.n[s].astype(np.float64)
            if self.hashes is not None:
                if self.weight is None:
                    self.weight = np.zeros(self.size)
                self.weight[s] = n = tree_weights(self.recipe, tree, self.hashes[s], n)
            _, self.g[s], self.h[s] = gradients(self.y[s], n, self.margin[s])

    def _summed(self, slot: np.ndarray, nodes: int, used: np.ndarray) -> np.ndarray:
        """(3, nodes, bins): this task's sums of the nodes that have a slot."""
        width = int(self.offsets[-1])
        parts = [np.zeros((3, nodes, w)) if used[group].any() else None for group, (_, w) in zip(self.groups, self.joint)]
        weights = self.n if self.weight is None else self.weight
        for s in self._slices():
            node = slot[self.at[s]]
            take = node >= 0
            if self.weight is not None:
                take &= self.weight[s] > 0
            rows = np.flatnonzero(take)
            if not len(rows):
                continue
            everything = len(rows) == len(node)
            own = lambda a: a[s] if everything else a[s].take(rows)  # noqa: B023, E731
            node, n, g, h = node if everything else node.take(rows), own(weights), own(self.g), own(self.h)
            ones = bool((n == 1).all())
            for part, (code, w) in zip(parts, self.joint):
                if part is None:
                    continue
                place, flat = node * w + own(code), nodes * w
                part[0] += (np.bincount(place, minlength=flat) if ones else np.bincount(place, n, flat)).reshape(nodes, w)
                part[1] += np.bincount(place, g, flat).reshape(nodes, w)
                part[2] += np.bincount(place, h, flat).reshape(nodes, w)
        out = np.zeros((3, nodes, width))
        for group, part, (_, w) in zip(self.groups, parts, self.joint):
            if part is None:
                continue
            shape = [len(self.edges[f]) + 1 for f in group]
            for k, f in enumerate(group):
                others = tuple(2 + i for i in range(len(group)) if i != k)
                out[:, :, self.offsets[f] : self.offsets[f + 1]] = part.reshape(3, nodes, *shape).sum(axis=others)
        return out

    def _move(self, m: Moves) -> None:
        start, codes = np.maximum(m.feature, 0).astype(np.int64) * self.size, self.codes.ravel()
        for s in self._slices():
            at = self.at[s]
            to, code = m.child[at], codes.take(start[at] + np.arange(s.start, s.stop))
            self.at[s] = np.where(to >= 0, to + (code > m.cut[at]), at)


def boosted_tree(recipe: Recipe, number: int, edges: list[np.ndarray], allowed: np.ndarray, sums_of) -> tuple[Tree, list[Moves], np.ndarray]:
    """One boosted tree from sums that others make, the moves of the cells and the value of each node they end at.

    ``sums_of(moves, slot, nodes, used)`` gives the sums over all cells of the nodes that have a slot.
    Only the smaller child of a node is asked for; its sibling is what is left of the parent.
    """
    used, offsets = tree_features(recipe, number, allowed), offsets_of(edges)
    growing = Growing(recipe, number)
    first = int(np.flatnonzero(used)[0])
    moves: list[Moves] = []
    sums = sums_of(moves, np.zeros(1, np.int64), 1, used)
    totals = sums[:, :, offsets[first] : offsets[first + 1]].sum(axis=2)
    while growing.open:
        n, before = growing.open, growing.closed
        feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        wide = np.flatnonzero(worth_splitting(recipe, totals)) if not growing.deep() else np.zeros(0, int)
        if len(wide):
            feature[wide], cut[wide], gain[wide] = best_splits(recipe, number, growing.names[wide], sums[:, wide], offsets, edges, used, totals[:, wide])[:3]
        child = growing.take(feature, cut, gain, totals)
        if not growing.open:
            break
        by_node = lambda a, none: np.concatenate([np.full(before, none, np.int64), a])  # noqa: B023, E731
        moves.append(Moves(by_node(feature, -1), by_node(cut, 0), by_node(np.where(child >= 0, growing.closed + child, -1), -1)))
        split = np.flatnonzero(child >= 0)
        left = np.stack([sums[:, k, offsets[feature[k]] : offsets[feature[k]] + cut[k] + 1].sum(axis=1) for k in split], axis=1)
        right = totals[:, split] - left
        totals = np.stack([left, right], axis=2).reshape(3, -1)
        if not growing.deep():
            small = np.arange(len(split)) * 2 + (right[0] < left[0])  # place of the smaller child in the next level
            slot = np.full(growing.closed + growing.open, -1, np.int64)
            slot[growing.closed + small] = np.arange(len(split))
            own = sums_of(moves, slot, len(split), used)
            after = np.zeros((3, growing.open, own.shape[2]))
            after[:, small], after[:, small ^ 1] = own, sums[:, split] - own
            after[:, after[0] == 0] = 0.0  # counts are whole: where none is left, rounding leaves nothing
            sums = after
    left = growing._joined()[3]
    made = growing.finished()
    # A split that was taken back gives its value to all below.
    value = made.value.copy()
    for k in np.flatnonzero(left):
        if made.left[k] == k:
            value[left[k] : left[k] + 2] = value[k]
    return made, moves, value


def grafted(trunk: Tree, below: dict[int, Tree]) -> Tree:
    """The trunk with some of its leaves replaced by trees grown below them."""
    size = len(trunk.feature)
    left = trunk.left.astype(np.int64).copy()
    feature, cut, value, gain = (a.copy() for a in (trunk.feature, trunk.cut, trunk.value, trunk.gain))
    more: list[list[np.ndarray]] = [[], [], [], [], []]
    depth = trunk.depth
    for node, tree in below.items():
        # The root takes the leaf's place; the rest follows behind, moved by what is there.
        move = size - 1
        moved = tree.left.astype(np.int64) + move
        own_leaf = tree.left[0] == 0
        feature[node], cut[node], value[node], gain[node] = tree.feature[0], tree.cut[0], tree.value[0], tree.gain[0]
        left[node] = node if own_leaf else moved[0]
        for out, a in zip(more, (tree.feature, tree.cut, moved, tree.value, tree.gain)):
            out.append(a[1:])
        size += len(tree.feature) - 1
        depth = max(depth, trunk.depth + 1 + tree.depth)  # the open nodes lie one level below the trunk's own depth
    joined = [np.concatenate([a, *m]) for a, m in zip((feature, cut, left, value, gain), more)]
    return Tree(joined[0], joined[1], joined[2].astype(np.int32), joined[3], joined[4], depth)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def gradients(y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Rows, gradient and hessian of the log loss per cell."""
    p = sigmoid(margin)
    return np.stack([weight, weight * (p - y), weight * p * (1.0 - p)])


def start_margin(recipe: Recipe, y: np.ndarray, n: np.ndarray) -> float:
    """The margin before the first tree."""
    one, total = float((n * y).sum()), float(n.sum())
    return float(np.log(one / (total - one))) if recipe.kind == "boost" and recipe.centred and 0 < one < total else 0.0


def grow_all(recipe: Recipe, cells: Cells, train: np.ndarray, allowed: np.ndarray, trees: range) -> tuple[list[Tree], float]:
    """The trees of a fit on the cells of ``train``, and the margin they start from."""
    hashes = cell_hash(cells)[train]
    codes, y, n = cells.codes[train], cells.y[train].astype(np.float64), cells.n[train].astype(np.float64)
    base = start_margin(recipe, y, n)
    margin = np.full(len(y), base)
    out = []
    for t in trees:
        weight = tree_weights(recipe, t, hashes, n)
        stats = np.stack([weight, weight * y]) if recipe.kind == "forest" else gradients(y, weight, margin)
        made = grow(recipe, t, codes, stats, cells.edges, allowed)
        out.append(made)
        if recipe.kind == "boost":
            margin += made.value[made.leaf_of(codes)]
    return out, base


def added_values(trees: list[Tree], codes: np.ndarray) -> np.ndarray:
    """The sum of the trees' values per row."""
    total = np.zeros(len(codes))
    for t in trees:
        total += t.value[t.leaf_of(codes)]
    return total


def importances(trees: list[Tree], features: int) -> np.ndarray:
    """Gain per feature, as shares per tree, averaged over trees."""
    out = np.zeros(features)
    for t in trees:
        own = np.bincount(t.feature, weights=t.gain, minlength=features)
        if own.sum() > 0:
            out += own / own.sum()
    return out / out.sum() if out.sum() > 0 else out


def coded(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes of a matrix: the number of edges below each value."""
    return np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(values), 0), np.uint8)

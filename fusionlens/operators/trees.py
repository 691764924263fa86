"""Trees over rows binned once to 8-bit codes: the array side of ``ensembles``.

All sums that decide a split are sums of integers (row counts, bootstrap
counts, gradients in units of 1 / ``UNIT``), so they do not depend on how rows are dealt to
tasks: a split found from summed histograms equals one found in a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNIT = 1 << 20         # gradients and hessians are counted in units of 1 / UNIT
MIN_HESSIAN = 1e-3
CHUNK = 1 << 16        # rows whose hessians and number are summed side by side
SIDE = float(1 << 35)  # one row beside the hessians of a chunk


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a random number for each key)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Bins:
    """Upper edges of the bins of every feature; code c holds values in (edge[c-1], edge[c]]."""
    edges: list[np.ndarray]

    def __post_init__(self):
        self.sizes = np.array([len(e) + 1 for e in self.edges], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.sizes)))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.last = np.zeros(self.offset[-1], dtype=bool)
        self.last[self.offset[1:] - 1] = True

    def encode(self, values: np.ndarray) -> np.ndarray:
        """(features, rows) codes of (rows, features) values."""
        return np.stack([np.searchsorted(e, values[:, f], side="left").astype(np.uint8) for f, e in enumerate(self.edges)])

    def left_sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (slots, bins): sums up to each bin within its feature, and each slot's whole sum."""
        running = np.cumsum(table, axis=1)
        whole = running[:, self.sizes[0] - 1].copy()
        for f in range(len(self.sizes) - 1, 0, -1):
            running[:, self.offset[f]:self.offset[f + 1]] -= running[:, self.offset[f] - 1:self.offset[f]]
        return running, whole


@dataclass
class Tree:
    """Nodes in the order they were made; children of node i are ``left[i]`` and ``left[i] + 1``.

    ``feature`` is -1 at a leaf, whose ``left`` is its row of ``value``.
    """
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """Row of ``value`` for each column of (features, rows) codes."""
        node = np.zeros(codes.shape[1], dtype=np.int32)
        rows = np.arange(codes.shape[1])
        while len(rows):
            here = node[rows]
            inner = self.feature[here] >= 0
            rows, here = rows[inner], here[inner]
            node[rows] = self.left[here] + (codes[self.feature[here], rows] > self.threshold[here])
        return self.left[node]


class Growing:
    """A tree that is still growing: nodes as lists, rows find their node by descending."""

    def __init__(self):
        self.feature, self.threshold, self.left = [-1], [0], [0]

    def split(self, node: int, feature: int, threshold: int) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.threshold.append(0)
            self.left.append(0)
        return self.left[node], self.left[node] + 1

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node each row is in now."""
        f, t, left = np.array(self.feature, np.int16), np.array(self.threshold, np.uint8), np.array(self.left, np.int32)
        node, rows = np.zeros(codes.shape[1], dtype=np.int32), np.arange(codes.shape[1])
        while len(rows):
            here = node[rows]
            inner = f[here] >= 0
            rows, here = rows[inner], here[inner]
            node[rows] = left[here] + (codes[f[here], rows] > t[here])
        return node

    def finished(self, values: dict[int, object], width: int) -> Tree:
        left, leaves = np.array(self.left, np.int32), []
        for node, f in enumerate(self.feature):
            if f < 0:
                left[node] = len(leaves)
                leaves.append(values[node])
        return Tree(np.array(self.feature, np.int16), np.array(self.threshold, np.uint8), left,
                    np.array(leaves, np.float64).reshape(-1, width))


# ---------------------------------------------------------------------------
# boosting
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 300
    rate: float = 0.05
    l2: float = 0.1
    leaves: int = 31
    min_leaf: int = 20


def softmax_gradients(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, rows) gradients and hessians of the log loss, as whole numbers of units."""
    p = np.exp(raw - raw.max(axis=0))
    p /= p.sum(axis=0)
    g = p.copy()
    g[label, np.arange(len(label))] -= 1
    return np.rint(g * UNIT), np.rint(p * (1 - p) * UNIT)


def joint_codes(codes: np.ndarray, bins: Bins, most: int = 512) -> tuple[list[list[int]], np.ndarray]:
    """Groups of features with few bins, of at most ``most`` cells each, and (groups, rows) codes of a group's cells."""
    groups, cells = [], []
    for f in np.argsort(bins.sizes, kind="stable").tolist():
        if groups and cells[-1] * bins.sizes[f] <= most:
            groups[-1].append(f)
            cells[-1] *= int(bins.sizes[f])
        else:
            groups.append([f])
            cells.append(int(bins.sizes[f]))
    out = np.zeros((len(groups), codes.shape[1]), dtype=np.uint16)
    for at, group in zip(out, groups):
        for f in group:
            at *= np.uint16(bins.sizes[f])
            at += codes[f]
    return groups, out


def boost_histogram(codes: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, bins: Bins,
                    groups: list[list[int]] | None = None) -> np.ndarray:
    """(3, slots, bins): gradient, hessian and row sums; ``codes`` are those of ``groups`` of features, if they are given.

    Hessians (a quarter of a unit at most) and rows of a chunk are summed side by side in one number: 34 bits and 17.
    """
    groups = [[f] for f in range(len(codes))] if groups is None else groups
    shape = [[int(bins.sizes[f]) for f in group] for group in groups]
    sums = [np.zeros((3, slots * int(np.prod(dims)))) for dims in shape]
    for a in range(0, len(slot), CHUNK):
        part = slice(a, a + CHUNK)
        base, weights = slot[part].astype(np.int64), (g[part], h[part] + SIDE)
        for j, held in enumerate(sums):
            n = held.shape[1] // slots
            cell = base * n + codes[j, part] if slots > 1 else codes[j, part]
            gradient, both = (np.bincount(cell, weights=w, minlength=held.shape[1]) for w in weights)
            rows = np.floor(both / SIDE)
            held[0] += gradient
            held[1] += both - rows * SIDE
            held[2] += rows
    out = np.zeros((3, slots, int(bins.offset[-1])))
    for group, dims, held in zip(groups, shape, sums):
        table = held.reshape(3, slots, *dims)
        for i, f in enumerate(group):
            others = tuple(2 + k for k in range(len(dims)) if k != i)
            out[:, :, bins.offset[f]:bins.offset[f + 1]] = table.sum(axis=others) if others else table
    return out


def boost_splits(hist: np.ndarray, bins: Bins, s: BoostSettings) -> list[tuple]:
    """For each slot (gain, feature, threshold, left sums, whole sums); gain is -inf without a valid split."""
    (gl, g), (hl, h), (nl, n) = (bins.left_sums(table) for table in hist)
    g, h, n = g[:, None], h[:, None], n[:, None]

    def score(a, b):
        return (a / UNIT) ** 2 / (b / UNIT + s.l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
    valid = ~bins.last & (nl >= s.min_leaf) & (n - nl >= s.min_leaf) & (hl >= MIN_HESSIAN * UNIT) & (
        h - hl >= MIN_HESSIAN * UNIT)
    gain = np.where(valid & (gain > 1e-12), gain, -np.inf)
    best = gain.argmax(axis=1)
    row = np.arange(len(best))
    feature = bins.owner[best]
    return list(zip(gain[row, best].tolist(), feature.tolist(), (best - bins.offset[feature]).tolist(),
                    np.stack([gl[row, best], hl[row, best], nl[row, best]], axis=1),
                    np.concatenate([g, h, n], axis=1)))


def leaf_value(sums: np.ndarray, s: BoostSettings) -> float:
    return float(-s.rate * (sums[0] / UNIT) / (sums[1] / UNIT + s.l2))


def grow_boosted(classes: int, splits_of, s: BoostSettings) -> list[Tree]:
    """One tree a class. ``splits_of(growing, frontier)`` finds the best split of each frontier node (class, node).

    Level by level; the best gains of a level are taken while the tree has fewer than ``leaves`` leaves.
    """
    growing = [Growing() for _ in range(classes)]
    sums: list[dict[int, np.ndarray]] = [{} for _ in range(classes)]
    frontier = [(k, 0) for k in range(classes)]
    count = [1] * classes
    while frontier:
        found = splits_of(growing, frontier)
        order = sorted(range(len(frontier)), key=lambda i: -found[i][0])
        taken = []
        for i in order:
            (k, node), (gain, feature, threshold, left, whole) = frontier[i], found[i]
            sums[k].setdefault(node, whole)
            if gain > 0 and count[k] < s.leaves:
                count[k] += 1
                a, b = growing[k].split(node, feature, threshold)
                sums[k][a], sums[k][b] = left, sums[k][node] - left
                taken.append((k, a, b))
        frontier = [(k, x) for k, a, b in sorted(taken) for x in (a, b) if count[k] < s.leaves and sums[k][x][2] >= 2 * s.min_leaf]
    return [growing[k].finished({n: leaf_value(v, s) for n, v in sums[k].items()}, 1) for k in range(classes)]


def boost(codes: np.ndarray, label: np.ndarray, prior: np.ndarray, bins: Bins, s: BoostSettings):
    """Trees of every round, fitted in memory; yields (round, class, tree)."""
    classes = len(prior)
    raw = np.repeat(prior[:, None], len(label), axis=1)
    groups, joint = joint_codes(codes, bins)

    def parted(here: np.ndarray | None, f: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a node (None: all) that go to its left and its right child."""
        right = (codes[f] if here is None else codes[f].take(here)) > t
        return (np.flatnonzero(~right), np.flatnonzero(right)) if here is None else (here[~right], here[right])

    for r in range(s.rounds):
        g, h = softmax_gradients(raw, label)
        rows_of: list[dict[int, np.ndarray | None]] = [{0: None} for _ in range(classes)]
        kept: dict[tuple[int, int], np.ndarray] = {}

        def histogram(k: int, some: np.ndarray | None) -> np.ndarray:
            if some is None:
                return boost_histogram(joint, np.zeros(len(label), np.int8), 1, g[k], h[k], bins, groups)[:, 0]
            return boost_histogram(joint.take(some, axis=1), np.zeros(len(some), np.int8), 1, g[k].take(some), h[k].take(some), bins, groups)[:, 0]

        def splits_of(growing, frontier):
            for k in sorted({k for k, _ in frontier}):
                if (k, 0) in frontier:
                    kept[k, 0] = histogram(k, None)
                for p in [p for p in rows_of[k] if growing[k].feature[p] >= 0]:
                    # rows of the smaller child are counted, the larger one is what is left of the parent
                    left = growing[k].left[p]
                    sides = parted(rows_of[k].pop(p), growing[k].feature[p], growing[k].threshold[p])
                    rows_of[k] |= {left: sides[0], left + 1: sides[1]}
                    less = int(len(sides[1]) < len(sides[0]))
                    kept[k, left + less] = histogram(k, sides[less])
                    kept[k, left + 1 - less] = kept.pop((k, p)) - kept[k, left + less]
            return boost_splits(np.stack([kept[k, n] for k, n in frontier], axis=1), bins, s)

        for k, tree in enumerate(grow_boosted(classes, splits_of, s)):
            ends = rows_of[k]
            while inner := [p for p in ends if tree.feature[p] >= 0]:  # the last level
                for p in inner:
                    ends |= zip((int(tree.left[p]), int(tree.left[p]) + 1), parted(ends.pop(p), tree.feature[p], tree.threshold[p]))
            for p, some in ends.items():
                raw[k][slice(None) if some is None else some] += tree.value[tree.left[p], 0]
            yield r, k, tree


# ---------------------------------------------------------------------------
# forest
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    min_leaf: int = 2
    max_depth: int | None = None
    seed: int = 42


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))


def root_key(tree: int, seed: int) -> np.uint64:
    return mix(np.array([(seed << 32) + tree + 1], dtype=np.uint64))[0]


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(keys * np.uint64(2) + np.uint64(1)), mix(keys * np.uint64(2) + np.uint64(2))


def bootstrap(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1) from a hash of the row's key and the tree."""
    u = mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ root_key(tree, seed)) >> np.uint64(11)
    return np.searchsorted(_POISSON, u / float(1 << 53)).astype(np.int64)


def draw_order(keys: np.ndarray, features: int) -> np.ndarray:
    """(nodes, features): the order in which a node looks at the features."""
    salt = mix(np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.argsort(mix(keys[:, None] ^ salt[None, :]), axis=1, kind="stable")


def tried(features: int) -> int:
    return max(1, int(np.sqrt(features)))


def purity(left: np.ndarray, whole: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over both sides of squared class weights over the side's weight: larger is purer (Gini)."""
    def side(x: np.ndarray) -> np.ndarray:
        x = x * weight
        square = total = 0.0
        for c in range(len(weight)):  # in this order whatever the memory layout, so ties stay ties
            square, total = square + x[..., c] * x[..., c], total + x[..., c]
        return square / total

    return side(left) + side(whole - left)


def splittable(counts: np.ndarray, rows: np.ndarray, min_leaf: int) -> np.ndarray:
    return (rows >= 2 * min_leaf) & ((counts > 0).sum(axis=-1) > 1)


def forest_split(hist: np.ndarray, key: np.uint64, bins: Bins, weight: np.ndarray, min_leaf: int):
    """(feature, threshold, left counts, left rows) of one node from (classes + 1, bins) counts, or None.

    The first ``tried`` features of the node's own order are looked at, then more until one can be split.
    """
    left, whole = bins.left_sums(hist)
    rows, n = left[-1], whole[-1]
    usable = ~bins.last & (hist[-1] > 0) & (rows >= min_leaf) & (n - rows >= min_leaf)
    score = np.full(len(usable), -np.inf)
    at = np.flatnonzero(usable)
    score[at] = purity(left[:-1, at].T, whole[:-1][None, :], weight)
    best = None
    for j, f in enumerate(draw_order(np.array([key]), len(bins.sizes))[0].tolist()):
        if j >= tried(len(bins.sizes)) and best is not None:
            break
        own = score[bins.offset[f]:bins.offset[f + 1]]
        t = int(own.argmax())
        if own[t] > -np.inf and (best is None or own[t] > best[0]):
            best = (own[t], f, t, left[:, bins.offset[f] + t])
    return best and best[1:]


def drawn_split(hist: np.ndarray, drawn: np.ndarray, first: int, bins: Bins, weight: np.ndarray, min_leaf: int):
    """``forest_split`` from (classes + 1, len(drawn), 256) counts of some features of a node's order, from place ``first`` on."""
    best = None
    for j, f in enumerate(drawn.tolist()):
        if first + j >= tried(len(bins.sizes)) and best is not None:
            break
        own = hist[:, j, :int(bins.sizes[f])]
        left = np.cumsum(own, axis=1)
        whole = left[:, -1]
        at = np.flatnonzero((own[-1, :-1] > 0) & (left[-1, :-1] >= min_leaf) & (whole[-1] - left[-1, :-1] >= min_leaf))
        if not len(at):
            continue
        score = purity(left[:-1, at].T, whole[:-1][None, :], weight)
        t = int(score.argmax())
        if best is None or score[t] > best[0]:
            best = (score[t], f, int(at[t]), left[:, at[t]])
    return best and best[1:]


def drawn_histogram(codes: np.ndarray, label: np.ndarray, count: np.ndarray, slot: np.ndarray, drawn: np.ndarray, classes: int) -> np.ndarray:
    """(classes + 1, slots, places, 256): draws by class, and rows, of the features that each slot has drawn."""
    slots, places = drawn.shape
    out = np.empty((classes + 1, slots, places, 256))
    rows = np.arange(len(slot))
    for j in range(places):
        cell = slot * 256 + codes[drawn[slot, j], rows]
        out[:-1, :, j] = np.bincount(label * (slots * 256) + cell, weights=count, minlength=classes * slots * 256).reshape(classes, slots, 256)
        out[-1, :, j] = np.bincount(cell, minlength=slots * 256).reshape(slots, 256)
    return out


def _node_candidates(code, node, label, count, nodes, classes, largest):
    """Left class counts, left rows, node and code of every (node, code) that holds rows, codes ascending.

    ``largest``: draws of the largest node; its bits say how many classes one running sum can hold side by side.
    """
    cells = nodes * 256
    if cells * classes <= 4 * len(code):  # few nodes: a dense table
        cell = node.astype(np.int64) * 256 + code
        table = np.bincount(cell * classes + label, weights=count, minlength=cells * classes).reshape(nodes, 256, classes)
        rows = np.bincount(cell, minlength=cells).reshape(nodes, 256)
        some = np.flatnonzero(rows.ravel())
        return (np.cumsum(table, axis=1).reshape(cells, classes)[some], np.cumsum(rows, axis=1).ravel()[some], some // 256,
                (some % 256).astype(np.uint8))
    cell = node.astype(np.int64) * 256 + code
    packed = np.sort(cell << 32 | np.arange(len(cell)))  # faster than argsort
    order, cell = packed & 0xFFFFFFFF, packed >> 32
    ends = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
    cell = cell[ends - 1]
    owner = cell >> 8
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    first = np.repeat(np.concatenate(([0], ends[:-1]))[begin], np.diff(begin, append=len(owner)))  # where the node's rows begin
    bits = largest.bit_length()
    lanes = min(classes, 63 // bits)
    sums = np.empty((len(ends), classes))
    for a in range(0, classes, lanes):
        side = label.astype(np.int64) - a
        side = np.where((side >= 0) & (side < lanes), count << bits * np.clip(side, 0, lanes - 1), 0) if lanes < classes else count << bits * side
        running = np.concatenate(([0], np.cumsum(side[order])))  # may wrap around; differences within a node do not
        part = running[ends] - running[first]
        for c in range(a, min(classes, a + lanes)):
            sums[:, c] = part >> bits * (c - a) & (1 << bits) - 1
    return sums, ends - first, owner, (cell & 255).astype(np.uint8)


def grow_subtree(codes: np.ndarray, label: np.ndarray, count: np.ndarray, key: np.uint64, bins: Bins, weight: np.ndarray,
                 s: ForestSettings, depth: int = 0) -> Tree:
    """A tree over these rows (each drawn ``count`` > 0 times), all nodes of a level at once, without a depth limit."""
    classes, features = len(weight), len(codes)
    by_row = np.ascontiguousarray(codes.T).ravel()
    feature, threshold, left, counts = [], [], [], []
    node = np.zeros(len(label), dtype=np.int64)
    rows = np.arange(len(label))
    keys = np.array([key], dtype=np.uint64)
    made = 1
    while len(keys):
        n = len(keys)
        whole = np.bincount(node * classes + label[rows], weights=count[rows], minlength=n * classes).reshape(n, classes)
        size, largest = np.bincount(node, minlength=n), int(whole.sum(axis=1).max())
        open_ = splittable(whole, size, s.min_leaf)
        if s.max_depth is not None and depth >= s.max_depth:
            open_[:] = False
        order = draw_order(keys, features)
        best = np.full(n, -np.inf)
        chosen, cut = np.full(n, -1), np.zeros(n, dtype=np.uint8)
        for j in range(features):
            active = open_ & ((j < tried(features)) | (chosen < 0))
            if not active.any():
                break
            some = slice(None) if active.all() else np.flatnonzero(active[node])
            at, own = rows[some], node[some]
            code = by_row.take(at * features + order[:, j].take(own))
            sums, upto, owner, value = _node_candidates(code, own, label[at], count[at], n, classes, largest)
            good = np.flatnonzero((upto >= s.min_leaf) & (size[owner] - upto >= s.min_leaf))
            if not len(good):
                continue
            owner, value = owner[good], value[good]
            score = purity(sums[good], whole[owner], weight)
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))  # owners ascend
            who, most = owner[begin], np.maximum.reduceat(score, begin)
            # the first candidate of a node that has its best score
            top = np.flatnonzero(score == np.repeat(most, np.diff(begin, append=len(score))))
            top = top[np.searchsorted(top, begin)]
            better = most > best[who]
            who, most, where = who[better], most[better], top[better]
            best[who], chosen[who], cut[who] = most, order[who, j], value[where]
        split = chosen >= 0
        number = np.cumsum(split) - 1
        feature.append(chosen)
        threshold.append(cut)
        left.append(np.where(split, made + 2 * number, 0))
        counts.append(whole)
        made += 2 * int(split.sum())
        keep = split[node]
        rows, node = rows[keep], node[keep]
        node = 2 * number[node] + (by_row[rows * features + chosen[node]] > cut[node])
        keys = np.stack(child_keys(keys[split]), axis=1).ravel()
        depth += 1
    feature, threshold, left, counts = (np.concatenate(x) for x in (feature, threshold, left, counts))
    leaf = feature < 0
    left[leaf] = np.arange(leaf.sum())
    return Tree(feature.astype(np.int16), threshold, left.astype(np.int32), leaf_shares(counts[leaf], weight))


def leaf_shares(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    shares = counts * weight
    total = shares.sum(axis=1, keepdims=True)
    return (shares / np.where(total > 0, total, 1.0)).astype(np.float32)


def grafted(top: Tree, parts: dict[int, Tree]) -> Tree:
    """``top`` with the leaves named in ``parts`` replaced by whole subtrees."""
    feature, threshold, left, values = [top.feature.copy()], [top.threshold.copy()], [top.left.copy()], []
    made, leaves = len(top.feature), 0
    for node in np.flatnonzero(top.feature < 0).tolist():
        part = parts.get(node)
        if part is None:
            values.append(top.value[top.left[node]][None, :])
            left[0][node] = leaves
            leaves += 1
            continue
        # the subtree's root takes this node; its other nodes are appended in their order
        f, t, at = part.feature, part.threshold, part.left.astype(np.int32)
        at = np.where(f >= 0, at - 1 + made, at + leaves)
        feature[0][node], threshold[0][node], left[0][node] = f[0], t[0], at[0]
        feature.append(f[1:])
        threshold.append(t[1:])
        left.append(at[1:])
        values.append(part.value)
        made += len(f) - 1
        leaves += len(part.value)
    return Tree(np.concatenate(feature).astype(np.int16), np.concatenate(threshold), np.concatenate(left).astype(np.int32),
                np.concatenate(values))

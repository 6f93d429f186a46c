"""R-trees packed by sort-tile-recursive over integer vectors, searched best first by inner product.

A node has the smallest and largest value of each coordinate, which bound every inner product with its rows
from below and above: a positive factor meets the largest value for the upper bound, a negative one the smallest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows of a leaf, nodes below a node, searches that are compared with a leaf at once.
LEAF, FAN, TOGETHER = 256, 16, 4096
#: Whole numbers below are exact in doubles, and in single precision.
EXACT, EXACT_SINGLE = float(1 << 53), float(1 << 24)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as whole doubles; sizes over 1e150 count as that."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -1e150, 1e150)


def str_order(keys: np.ndarray, page: int) -> np.ndarray:
    """Places of the rows, page after page: sorted by the first key into slabs, each slab by the next key, and so on."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(keys)), 0)]
    while todo:
        own, k = todo.pop()
        own = own[np.argsort(keys[own, k], kind="stable")] if keys.shape[1] else own
        pages = -(-len(own) // page)
        left = keys.shape[1] - k
        if pages <= 1 or left <= 1:
            out.append(own)
            continue
        slabs = int(np.ceil(pages ** (1 / min(left, max(1, int(np.ceil(np.log2(pages))))))))
        size = page * -(-pages // slabs)
        todo += [(own[at : at + size], k + 1) for at in range(0, len(own), size)][::-1]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def widest(vectors: np.ndarray) -> np.ndarray:
    """Coordinates by falling spread."""
    return np.argsort(-vectors.std(axis=0), kind="stable") if len(vectors) else np.arange(vectors.shape[1])


@dataclass
class Tiles:
    """Borders of sort-tile-recursive slabs, fitted on a sample: key k, its cuts, what lies between them."""

    key: int
    cuts: np.ndarray
    below: list[Tiles | int]


def fit_tiles(keys: np.ndarray, pages: int) -> tuple[Tiles | int, int]:
    """(tree of borders, number of tiles) that cut the sampled rows into about `pages` tiles."""
    count = 0

    def grow(own: np.ndarray, k: int, pages: int) -> Tiles | int:
        nonlocal count
        left = min(keys.shape[1] - k, max(1, int(np.ceil(np.log2(max(pages, 1))))))
        if pages > 1 and k < keys.shape[1] and len(own) > 1:
            slabs = min(len(own), int(np.ceil(pages ** (1 / left))))
            values = np.sort(keys[own, k])
            cuts = np.unique(values[[len(own) * i // slabs for i in range(1, slabs)]])
            place = np.searchsorted(cuts, keys[own, k], side="right")
            return Tiles(k, cuts, [grow(own[place == i], k + 1, -(-pages // slabs)) for i in range(len(cuts) + 1)])
        count += 1
        return count - 1

    root = grow(np.arange(len(keys)), 0, pages)
    return root, count


def tile_of(root: Tiles | int, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    todo = [(root, np.arange(len(keys)))]
    while todo:
        node, own = todo.pop()
        if isinstance(node, int):
            out[own] = node
        elif len(own):
            place = np.searchsorted(node.cuts, keys[own, node.key], side="right")
            todo += [(child, own[place == i]) for i, child in enumerate(node.below)]
    return out


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query (row) with anything in each box (column)."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    if least.dtype != object and (size := np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T).size and size.max() > EXACT / 2:
        least, most = least - size * 1e-12, most + size * 1e-12  # rounded sums stay bounds
    return least, most


@dataclass
class Request:
    """One search: ids other than own, of the label or of other labels, scores in [low, high], not under `least`."""

    own: int
    label: int
    same: bool
    low: int
    high: int
    least: int


@dataclass
class Lot:
    """Many searches at once, each with windows of scores: pairs of whole numbers, and the same as columns of lows and highs, where one that a search doesn't have is empty."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int]]]
    same: bool

    def __post_init__(self) -> None:
        wide = max(map(len, self.windows), default=1)
        padded = [[*w, *[(np.inf, -np.inf)] * (wide - len(w))] for w in self.windows]
        self.lows, self.highs = np.moveaxis(np.array(padded, np.float64).reshape(len(padded), wide, 2), 2, 0)


class Firsts:
    """The first k rows of each window of a lot so far: by score, then id. No row under `least` can still come in."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.astype(np.float64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.due = 0

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(window):
            self.rows.append((window, score, ids))
            self.size += len(window)
            if self.size > self.due:
                self.prune()

    def prune(self) -> None:
        window, score, ids = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, ~score, window))  # ~ falls as its number rises and has no overflow
        window, score, ids = window[order], score[order], ids[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        last = place == self.k - 1
        kth = score[last].astype(np.float64)
        kth = np.where(np.abs(kth) < EXACT, kth, np.nextafter(kth, -np.inf))  # rounded up it would shut out ties
        self.least.ravel()[window[last]] = np.maximum(self.least.ravel()[window[last]], kth)
        kept = place < self.k
        self.rows = [(window[kept], score[kept], ids[kept])]
        self.size = int(kept.sum())
        self.due = 2 * self.size + (1 << 17)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, score, id), a window's in their order."""
        if not self.rows:
            return (np.empty(0, np.int64),) * 3
        self.prune()
        return self.rows[0]


class RTree:
    """Rows in packed order with the boxes of all levels; level 0 has the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        self.ids, self.labels, self.vectors, self.leaf, self.fan = ids, labels, vectors, leaf, fan
        self.first = [0]  # number of each level's first node
        boxes = [vectors, vectors, labels, labels]
        levels: list[list[np.ndarray]] = []
        size = leaf
        while len(boxes[0]) > 1 or not levels:
            start = np.arange(0, len(boxes[0]), size)
            boxes = [f.reduceat(b, start, axis=0) for f, b in zip((np.minimum, np.maximum) * 2, boxes, strict=True)]
            levels.append(boxes)
            self.first.append(self.first[-1] + len(start))
            size = fan
        self.low, self.high, self.least_label, self.most_label = (np.concatenate(x) for x in zip(*levels, strict=True))
        self.top = len(levels) - 1

    def search(self, query: np.ndarray, requests: list[Request], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each request of one query vector the (scores, ids) of its first k rows: by score, then id."""
        least, most = (b[0] for b in bounds(query[None, :], self.low, self.high))
        known: dict[int, np.ndarray] = {}
        for r in requests:
            alike = (self.least_label <= r.label) & (r.label <= self.most_label) if r.same else (self.least_label != r.label) | (self.most_label != r.label)
            good = np.minimum(most, r.high)  # the best that a box can give
            open_ = alike & (most >= r.low) & (least <= r.high)
            kth, scores, ids = r.least, np.empty(0, self.vectors.dtype), np.empty(0, np.int64)
            root = self.first[self.top]
            queue = [(-good[root], self.top, 0)] if open_[root] else []
            while queue:
                value, level, node = heapq.heappop(queue)
                if -value < kth:
                    break  # and so is all that is left
                if level:
                    lo, hi = self.first[level - 1] + node * self.fan, min(self.first[level], self.first[level - 1] + (node + 1) * self.fan)
                    for child in np.flatnonzero(open_[lo:hi] & (good[lo:hi] >= kth)).tolist():
                        heapq.heappush(queue, (-good[lo + child], level - 1, node * self.fan + child))
                    continue
                at = node * self.leaf
                if node not in known:
                    known[node] = self.vectors[at : at + self.leaf] @ query
                s = known[node]
                own = slice(at, at + self.leaf)
                on = np.flatnonzero(((self.labels[own] == r.label) == r.same) & (self.ids[own] != r.own) & (s >= r.low) & (s <= r.high) & (s >= kth))
                if len(on):
                    scores, ids = np.append(scores, s[on]), np.append(ids, self.ids[own][on])
                    order = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[order], ids[order]
                    if len(ids) == k:
                        kth = max(kth, scores[-1])
            yield scores, ids


    def search_all(self, lot: Lot, own: np.ndarray, firsts: Firsts) -> None:
        """search() for the searches `own` of a lot, whose products doubles hold exactly; what is found goes to firsts.

        Each search opens its leaves best first; those that open the same leaf in a round are one product.
        """
        leaves, wide = self.first[1], lot.lows.shape[1]
        size = np.abs(self.vectors).max(initial=0) * max(1, self.vectors.shape[1]) * np.abs(lot.vectors[own]).max(initial=0)
        kind = np.float32 if size < EXACT_SINGLE else np.float64
        rows = self.vectors.astype(kind)
        for at in range(0, len(own), TOGETHER):
            part = own[at : at + TOGETHER]
            lows, highs, label = lot.lows[part], lot.highs[part], lot.labels[part, None]
            queries, most_high = lot.vectors[part].astype(kind), highs.max(axis=1)
            down, up = bounds(lot.vectors[part], self.low[:leaves], self.high[:leaves])
            least_label, most_label = self.least_label[:leaves], self.most_label[:leaves]
            alike = (least_label <= label) & (label <= most_label) if lot.same else (least_label != label) | (most_label != label)
            good = np.full(up.shape, -np.inf)  # the best that a leaf can give
            for w in range(wide):
                value = np.minimum(up, highs[:, w, None])
                open_ = alike & (up >= lows[:, w, None]) & (down <= highs[:, w, None]) & (value >= firsts.least[part, w, None])
                good[open_] = np.maximum(good, value)[open_]
            order = np.argsort(-good, axis=1, kind="stable")
            for leaf in order.T:
                value = good[np.arange(len(part)), leaf]
                on = np.flatnonzero((value > -np.inf) & (value >= firsts.least[part].min(axis=1)))
                if not len(on):
                    break  # and so are all that are left
                on = on[np.argsort(leaf[on], kind="stable")]
                for mine in np.split(on, np.flatnonzero(np.diff(leaf[on])) + 1):
                    first = int(leaf[mine[0]]) * self.leaf
                    s = queries[mine] @ rows[first : first + self.leaf].T
                    from_ = np.maximum(lows[mine], firsts.least[part[mine]])
                    lo, hi = (np.nextafter(x.astype(kind), kind(to))[:, None] for x, to in ((from_.min(axis=1), -np.inf), (most_high[mine], np.inf)))
                    i, j = np.nonzero((s >= lo) & (s <= hi))
                    score, i, j = s[i, j].astype(np.float64), mine[i], j + first
                    fit = ((self.labels[j] == label[i, 0]) == lot.same) & (self.ids[j] != lot.ids[part[i]])
                    score, i, j = score[fit], i[fit], j[fit]
                    for w in range(wide):
                        in_ = (score >= np.maximum(lows[i, w], firsts.least[part[i], w])) & (score <= highs[i, w])
                        firsts.add(part[i[in_]] * wide + w, score[in_].astype(np.int64), self.ids[j[in_]])


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """The same matrix with Python's unbounded integers, for products that doubles can't hold."""
    out = np.empty(vectors.shape, object)
    out.ravel()[:] = [int(x) for x in vectors.ravel()]
    return out

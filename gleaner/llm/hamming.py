"""Vantage-point trees over fingerprints under Hamming distance, inside tasks and on the driver.

At a node with vantage v and radius r, what lies within r goes left and what lies beyond goes right.
By the triangle inequality a pair within `radius` across that border has its near end in
(r - radius, r], so those points go to both sides, and the branches are searched alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Points compared all with all at the end of a branch.
LEAF = 128


def away(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked points the smaller of their groups' labels, in place, until nothing changes."""
    while True:
        x, y = labels[a], labels[b]
        off = x != y
        if not off.any():
            return
        a, b, x, y = a[off], b[off], x[off], y[off]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def near_pairs(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of places (i, j) of all pairs of distinct points within the radius; a pair may come more than once."""
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        if len(own) > LEAF:
            for vantage in points[own[[len(own) // 2, 0, -1]]]:
                d = away(points[own], vantage)
                r = int(np.median(d))
                left, right = own[d <= r], own[d > r - radius]
                if max(len(left), len(right)) <= 0.9 * len(own):
                    todo += [left, right]
                    break
            else:  # a ball that no border divides: compare in blocks
                for at in range(0, len(own), LEAF):
                    rows, rest = own[at : at + LEAF], own[at:]
                    i, j = np.nonzero(away(points[rows][:, None], points[rest][None, :]) <= radius)
                    yield rows[i[i < j]], rest[j[i < j]]
            continue
        i, j = np.nonzero(np.triu(away(points[own][:, None], points[own][None, :]) <= radius, 1))
        if len(i):
            yield own[i], own[j]


def link_groups(points: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct point the place of the first of its connected group within the radius."""
    labels = np.arange(len(points))
    for i, j in near_pairs(points, radius):
        settle(labels, i, j)
    return labels


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) between n places, earlier links preferred."""
    labels, kept = np.arange(n), [(a[:0], b[:0])]
    while len(a):
        x, y = labels[a], labels[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        best = np.full(n, len(a))
        for end in (x, y):
            np.minimum.at(best, end, np.arange(len(a)))
        pick = np.unique(best[best < len(a)])
        kept.append((a[pick], b[pick]))
        settle(labels, a[pick], b[pick])
    return np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])


@dataclass
class Node:
    vantage: np.uint64
    radius: int
    left: Node | int
    right: Node | int


def top_tree(sample: np.ndarray, depth: int) -> tuple[Node | int, int]:
    """A tree over sampled points whose leaves are numbered shards; (root, number of shards)."""
    shards = 0

    def grow(own: np.ndarray, depth: int) -> Node | int:
        nonlocal shards
        if depth and len(own) >= 8:
            d = away(own, own[0])
            r = int(np.median(d))
            near = d <= r
            if 0.2 <= near.mean() <= 0.8:
                return Node(own[0], r, grow(own[near][1:], depth - 1), grow(own[~near], depth - 1))
        shards += 1
        return shards - 1

    root = grow(sample, depth)
    return root, shards


def route(root: Node | int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, shard): each point in its shard and in those whose border it overlaps."""
    out: list[tuple[np.ndarray, int]] = []
    todo = [(root, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            out.append((own, node))
            continue
        d = away(points[own], node.vantage).astype(np.int64)
        todo += [(node.left, own[d <= node.radius]), (node.right, own[d > node.radius - radius])]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([np.full(len(x), s) for x, s in out])

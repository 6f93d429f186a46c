"""Helpers that run inside Python tasks: bounded groups of texts as flat code-point arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np


def groups(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of texts with about `limit` characters each; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_runs(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): lower-cased letters of all texts, one 0 in front of each text, each run of
    other characters as one 0; starts[i] is the place of text i's leading 0, with the total at the end."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lead = np.cumsum([0, *(len(t) + 1 for t in low)])
    codes = np.where(letters()[flat], flat, 0)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[lead] = True
    keep[lead[1:] - 1] &= codes[lead[1:] - 1] != 0  # no gap twice where a text ends
    kept_before = np.cumsum(keep) - keep
    return codes[keep], kept_before[lead]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))

"""Word shingles of many texts at once as 64-bit values, and wide SimHashes of their sets.

Words are what op6 takes for words: A-Z lower-cased, cut at 0x20 and 0x09 to 0x0D. A word's value is a
polynomial over its bytes, a shingle's one over its words' values; both come from running sums, so no
word is looked at alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from gleaner.llm.textbatch import mix

BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LANES = np.uint64(0x0101010101010101)
_powers: list[np.ndarray] = []


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64))) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))]
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: Sequence[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles, ascending; a shorter text is one shingle, one without words has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    size = np.array([len(r) + 1 for r in raw], np.int64)
    stop = np.cumsum(size)
    gap = (flat == 32) | ((flat >= 9) & (flat <= 13))
    begin = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    power, inverse = _steps(len(flat))
    total = np.append(np.uint64(0), np.cumsum(_BYTE[flat] * power))
    word = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    last = np.searchsorted(begin, stop)  # words up to the end of each text
    many = np.diff(np.append(0, last))
    until = np.repeat(last, many)
    at = np.arange(len(word))
    first = np.repeat(last - many, many) == at
    at = at[first | (at + n <= until)]
    until = until[at]
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < until
        value[there] += word[at[there] + k] * power[k + 1] if len(power) > k + 1 else word[at[there] + k] * _steps(n + 1)[0][k + 1]
    value = mix(value)
    cuts = np.append(0, np.searchsorted(at, last))
    return [np.unique(value[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def simhash_bits(sets: Sequence[np.ndarray], words: int) -> np.ndarray:
    """One row of 64 * words bits for each set: 1 where over half of its members' hashes have 1.

    Eight bits are counted at a time in the bytes of one integer, over at most 255 members.
    """
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 64 * words), np.uint8)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    start = np.append(0, np.cumsum(size[full]))
    part = [np.arange(a, b, 255) for a, b in zip(start.tolist(), start[1:].tolist(), strict=False)]
    parts = np.concatenate(part)
    owner = np.append(0, np.cumsum([len(p) for p in part]))[:-1]
    for w in range(words):
        h = mix(values + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for k in range(8):
            lanes = np.add.reduceat(h >> np.uint64(k) & _LANES, parts)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
            out[full, 64 * w + k : 64 * (w + 1) : 8] = 2 * ones > size[full, None]
    return out

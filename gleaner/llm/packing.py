"""Sequence packing by minimum bin slack.

Documents are encoded where they are read and packed in windows of bounded size, so nothing is
shuffled. Rows are sorted first, so that a task that is run again packs them alike whatever order a shuffle
brings them in. A document longer than a sequence first fills whole sequences; what remains of all
documents of the window is a multiset of lengths. Each further sequence takes the longest remaining
piece and then the multiset that comes closest to the space left: reachable sums are the bits of one
integer, each length is added as often as it occurs by binary multiples, and the chosen counts are
read back through the kept states. A sequence that still has room is filled by cutting a remaining
piece. The last piece of a window, too short for a sequence, is cut into lengths that are powers of
two, which need no padding.

Edge cases: a null or empty text is its end id alone; rows with a null id are packed like any other;
ties take the longer length first, then the smaller id (nulls first); repeated rows are packed each; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.wordbpe import Piece, crc, with_end

CAPACITY = 2048
#: Ids held before a window is packed.
WINDOW = 1 << 22

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """Counts of lengths, at most those given, whose sum comes closest to space without exceeding it."""
    mask = (1 << (space + 1)) - 1
    reach = 1
    states: list[tuple[int, int, int]] = []  # the sums before, the length, how many of it
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, many = min(counts[length], space // length), 1
        while left:
            take = min(many, left)
            states.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, many = left - take, many * 2
        if reach >> space & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(states):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """Pieces that cover every document (its length at least 1) exactly once."""
    out: list[Piece] = []
    sequence = 0
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: (document, start)
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append(Piece(doc, at, capacity, sequence, 0))
            sequence, at = sequence + 1, at + capacity
        if n > at:
            rest[n - at].append((doc, at))
    for own in rest.values():
        own.reverse()
    total = sum(n * len(own) for n, own in rest.items())
    while total >= capacity:
        offset = 0

        def put(length: int, most: int) -> None:
            """Place the next piece of this length, cut to `most`; what is cut off remains."""
            nonlocal offset, total
            doc, start = rest[length].pop()
            if not rest[length]:
                del rest[length]
            used = min(length, most)
            out.append(Piece(doc, start, used, sequence, offset))
            offset, total = offset + used, total - used
            if length > used:
                rest[length - used].append((doc, start + used))

        put(max(rest), capacity)
        if offset < capacity:
            for length, n in sorted(fill({n: len(own) for n, own in rest.items()}, capacity - offset).items(), reverse=True):
                for _ in range(n):
                    put(length, length)
        while offset < capacity:
            put(max(rest), capacity - offset)
        sequence += 1
    offset, size = 0, 1 << (total.bit_length() - 1) if total else 0
    for length in sorted(rest, reverse=True):
        for doc, start in reversed(rest[length]):
            stop = start + length
            while start < stop:
                used = min(stop - start, size - offset)
                out.append(Piece(doc, start, used, sequence, offset))
                start, offset, total = start + used, offset + used, total - used
                if offset == size and total:
                    sequence, offset, size = sequence + 1, 0, 1 << (total.bit_length() - 1)
    return out


def _window(keys: list, ids: list[np.ndarray], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    pieces = pack([len(x) for x in ids], capacity)
    col = lambda f, kind=pa.int64(): pa.array([f(p) for p in pieces], kind)
    batch = pa.RecordBatch.from_arrays(
        [
            col(lambda p: keys[p.document]),
            col(lambda p: p.start),
            col(lambda p: p.length),
            col(lambda p: crc(ids[p.document][p.start : p.start + p.length])),
            col(lambda p: len(ids[p.document])),
            col(lambda p: first + p.sequence),
            col(lambda p: p.offset),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
    return batch, first + max((p.sequence for p in pieces), default=-1) + 1


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece; a sequence's id is its partition's number shifted by 40 bits, plus its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        keys, ids, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = with_end(t.as_py(), tokenizer)
                keys.append(k)
                ids.append(own)
                held += len(own)
                if held >= window:
                    out, first = _window(keys, ids, first, capacity)
                    yield out
                    keys, ids, held = [], [], 0
        if keys:
            yield _window(keys, ids, first, capacity)[0]

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SCHEMA)

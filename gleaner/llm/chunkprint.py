"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where the hash has enough zero bits. The
rule is normalised: up to NORMAL bytes a stricter mask holds, after that a looser one, with least
and greatest lengths, so that chunk sizes gather around NORMAL. As a boundary depends on the last
bytes alone, an insertion or a cut moves only the chunks around it. A fingerprint is the set of
chunk digests, each with the bytes it stands for; two fingerprints are compared by containment:
the weight they share over the smaller total.

The edited text of a document takes its last half from the next document in id order. Documents are
dealt into id ranges by quantile bounds, sorted inside each, and the first row of a range is also
sent to the range before it, so that no window runs over the whole table.

Edge cases: a null or empty text has an empty fingerprint, which is like another empty one (1) and
unlike all others (0); rows with a null id come last; of rows with equal ids the order is that of
their texts; with a single row the next document is the row itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.ranges import deal_ranges
from gleaner.llm.textbatch import mix

LEAST, NORMAL, MOST = 12, 32, 128
#: Zero bits asked for before and after NORMAL bytes.
STRICT, LOOSE = 6, 4

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


#: As many bytes as the hash remembers; in front of each text, so that a text's chunks depend on it alone.
_PAD = bytes(32)


def chunks(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes of all texts, text index, begin and end of every chunk there), in order."""
    joined = b"".join([x for t in texts for x in (_PAD, t)])
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stop = np.cumsum(sizes + len(_PAD))
    h = _GEAR[np.frombuffer(joined, dtype=np.uint8)]
    reach = 1
    while reach < len(_PAD):  # the hash of the last 2r bytes from two hashes of r bytes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    far = np.int64(len(h) + MOST)
    strict, loose = (np.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1, far) for bits in (STRICT, LOOSE))
    doc = np.flatnonzero(sizes)
    at = stop[doc] - sizes[doc]
    found = [(doc[:0], at[:0], at[:0])]
    while len(doc):  # one chunk further in all texts at once
        early = strict[np.searchsorted(strict, at + LEAST)]
        late = loose[np.searchsorted(loose, at + NORMAL)]
        end = np.minimum(np.where(early < at + NORMAL, early, np.minimum(late, at + MOST)), stop[doc])
        found.append((doc, at, end))
        more = end < stop[doc]
        doc, at = doc[more], end[more]
    where, begin, end = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(begin)
    return joined, where[order], begin[order], end[order]


Print = dict[int, int]


def prints(texts: list[bytes]) -> list[Print]:
    """For each text its digests (48 bits), each with the bytes it stands for."""
    out: list[Print] = [{} for _ in texts]
    joined, where, begin, end = chunks(texts)
    digest = xxhash.xxh3_64_intdigest
    for doc, a, b in zip(where.tolist(), begin.tolist(), end.tolist(), strict=True):
        key, own = digest(joined[a:b]) >> 16, out[doc]
        own[key] = own.get(key, 0) + b - a
    return out


def render(p: Print) -> str:
    """Digests in order, 12 hex digits each and the bytes in hex, joined by dots: equal sets give equal strings."""
    return ".".join([f"{k:012x}{n:x}" for k, n in sorted(p.items())])


def containment(a: Print, b: Print) -> float:
    """Shared weight over the smaller total; 1 for two empty prints, 0 if only one is empty."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum([min(n, large[k]) for k, n in small.items() if k in large])
    return shared / min(sum(a.values()), sum(b.values()))


def edit(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(keys: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows for documents of which each one's next is given."""
    raw = lambda ts: [t.encode("utf-8", "surrogatepass") for t in ts]
    edited = raw(map(edit, texts, following))
    own = prints(raw(texts))
    last = prints(raw(following[-1:]))
    changed = prints(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            pa.array([render(p) for p in own], pa.string()),
            pa.array([render(p) for p in changed], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([containment(a, b) for a, b in pairwise([*own, *last])], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and place; the last of each range is the next range's first, sent along."""
    keys: list = []
    texts: list[str] = []
    held, now = 0, None
    for batch in batches:
        for part, key, text, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != now:
                keys, texts, held, now = [], [], 0, part
            if texts and (guest or held > 1 << 20):
                yield _compare(keys, texts, [*texts[1:], text])
                keys, texts, held = [], [], 0
            if not guest:
                keys.append(key)
                texts.append(text)
                held += len(text)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its own fingerprint, that of its edited text, and likenesses."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return deal_ranges(rows, "doc_id", tie="text", guests=True).select("part", "doc_id", "text", "guest").mapInArrow(_runs, SCHEMA)

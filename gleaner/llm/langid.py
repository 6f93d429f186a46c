"""Language identification by rank-order profiles of frequent letter n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 letters, words padded by a
gap) over all training texts. A document's own most frequent n-grams are compared with each profile
by out-of-place distance: the sum of rank differences, a missing n-gram counting as the profile's
length. The nearest profile wins, ties going to the alphabetically first language.

Edge cases: null text or a text without letters gives `und` with score 0; training rows with a null
language or text are ignored; repeated rows are counted as often as they occur; an empty training
table gives `und` everywhere; other columns pass through untouched, and columns named like the
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.textbatch import groups, letter_runs, mix

#: n-grams kept in a profile, and compared of a document.
PROFILE = 400
#: n-grams are known by a hash of so many bits.
BITS = 20
UNKNOWN = "und"


def _grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, n-gram hash) of every n-gram of 1 to 3 places."""
    c = np.append(codes, np.zeros(2, codes.dtype)).astype(np.uint64)
    n = len(codes)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    doc = np.append(doc, np.full(n - len(doc), max(len(starts) - 2, 0)))
    a, b, d = c[:n], c[1 : n + 1], c[2:]
    one = np.flatnonzero(a)
    two = np.flatnonzero((a != 0) | (b != 0))
    two = two[two < n - 1]
    three = np.flatnonzero(b)
    s1, s2 = np.uint64(21), np.uint64(42)
    keys = np.concatenate([a[one], a[two] | b[two] << s1 | np.uint64(1 << 63), a[three] | b[three] << s1 | d[three] << s2])
    where = np.concatenate([doc[one], doc[two], doc[three]])
    return where, (mix(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, text = (batch.column(i).to_pylist() for i in range(2))
        by: dict[str, list[str]] = {}
        for name, t in zip(lang, text, strict=True):
            by.setdefault(name, []).append(t)
        for name, own in by.items():
            for lo, hi in groups(own):
                code, n = _runs(_grams(*letter_runs(own[lo:hi]))[1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fit_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's `size` most frequent n-grams over all rows of df, most frequent first.

    Only these lists (size times the number of languages) come to the driver.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect():
        out.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {name: np.array([g for _, g in sorted(v)], dtype=np.int64) for name, v in sorted(out.items())}


class _Ranker:
    """Out-of-place distances of many texts to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = [*profiles], size
        known = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.row = np.full(1 << BITS, len(known), dtype=np.int32)
        self.row[known] = np.arange(len(known))
        self.ranks = np.full((len(known) + 1, len(profiles)), size, dtype=np.int32)
        for k, grams in enumerate(profiles.values()):
            self.ranks[self.row[grams], k] = np.arange(len(grams))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest profile or -1, score): score is 1 for no distance, 0 for no shared n-gram."""
        n, size = len(texts), self.size
        where, gram = _grams(*letter_runs(texts))
        keys, count = _runs(where.astype(np.int64) << BITS | gram)
        doc, most = keys >> BITS, np.int64((1 << (62 - BITS - 20)) - 1)
        # within a text by falling count, then by n-gram
        if len(count) and count.max() > most:  # too many for the packed key
            order = np.lexsort((keys, -count, doc))
        else:
            order = np.argsort((doc << 42) | ((most - count) << BITS) | (keys & ((1 << BITS) - 1)), kind="stable")
        doc, gram = doc[order], (keys & ((1 << BITS) - 1))[order]
        first = np.searchsorted(doc, np.arange(n + 1))
        rank = np.arange(len(doc)) - first[doc]
        keep = rank < size
        doc, gram, rank = doc[keep], gram[keep], rank[keep]
        off = np.abs(self.ranks[self.row[gram]] - rank[:, None].astype(np.int32))
        off[self.ranks[self.row[gram]] == size] = size
        used = np.bincount(doc, minlength=n)
        dist = np.stack([np.bincount(doc, weights=off[:, k], minlength=n) for k in range(len(self.names))], axis=1)
        best = np.argmin(dist, axis=1)
        score = np.where(used > 0, 1 - dist[np.arange(n), best] / np.maximum(used * size, 1), 0.0)
        return np.where(used > 0, best, -1), np.clip(score, 0, 1)


def language(profiles: dict[str, np.ndarray], text: Column | str = "text", size: int = PROFILE) -> Column:
    """struct<lang_pred, score> of a text column."""
    made: list[_Ranker] = []

    @F.pandas_udf("lang_pred string, score double")
    def udf(col: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(_Ranker(profiles, size))
        ranker, texts = made[0], [t if isinstance(t, str) else "" for t in col]
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if ranker.names:
            for lo, hi in groups(texts):
                best[lo:hi], score[lo:hi] = ranker(texts[lo:hi])
        names = np.array([*ranker.names, UNKNOWN], dtype=object)
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    return udf(F.col(text) if isinstance(text, str) else text)


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE) -> DataFrame:
    """df with lang_pred and score."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    found = df.select(F.struct(*df.columns).alias("row"), language(profiles, F.col(text).cast("string"), size).alias("found"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in kept), "found.lang_pred", "found.score")


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and their beginnings of 4, 5 and 6 letters, and each of these
that occurs more than once as a further term, all hashed to 2^20 places. The machine has a weight for each kept term and a short factor vector, so that pairs of
terms (an insult beside a mention of a group, two mild words together) count beyond their sum.
It is fitted on a bounded sample of labelled rows (MAX_FIT, the rows of the ids with the smallest
hashes); every term that at least LEAST of these texts hold and whose chi-square against the label is TELLING
enters the machine, so that their number grows with the rows and the words, without a cap.

Edge cases: null and empty texts are scored by the bias alone; rows with a null label are not
learned from; of several labels of one document the largest counts; an id with several texts gives several
rows, which count against MAX_FIT; an empty training table gives a
machine that scores 0 everywhere; other columns pass through, columns named like the result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textbatch import groups, letter_runs, mix

#: At most so many labelled rows are fitted on.
MAX_FIT = 20_000
#: Texts that a term must be in to enter the machine, the length of factor vectors, the pull of weights and factors to zero.
LEAST, FACTORS, RIDGE = 3, 8, 1e-4
#: Chi-square of a term against the label from which on it enters; the more rows, the fainter the terms that reach it.
TELLING = 6.63  # one term in a hundred that says nothing
BITS = 20
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
BASE = np.uint64(0x5851F42D4C957F2D)


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, term hash), each pair once, in order."""
    codes, starts = letter_runs(texts)
    gap = np.flatnonzero(codes == 0)
    begin = np.flatnonzero((codes[:-1] == 0) & (codes[1:] != 0)) + 1
    length = gap[np.searchsorted(gap, begin)] - begin
    doc = np.searchsorted(starts, begin, side="right") - 1
    # running polynomial hash: that of any stretch is a difference, divided by the power at its begin
    power = np.cumprod(np.append(np.uint64(1), np.full(len(codes) - 1, BASE)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(codes) - 1, pow(int(BASE), -1, 1 << 64), dtype=np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(mix(codes.astype(np.uint64)) * power))
    keys, where = [], []
    for k in (*PREFIXES, 0):
        on = np.flatnonzero(length > k)
        at = begin[on]
        end = at + k if k else at + length[on]
        keys.append(mix((total[end] - total[at]) * inverse[at] + np.uint64(k)))
        where.append(doc[on])
    pair = np.concatenate(where).astype(np.int64) << BITS | (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
    pair, n = np.unique(pair, return_counts=True)
    again = pair[n > 1]  # a term that a text repeats is a further term
    again = again >> BITS << BITS | (mix(again.astype(np.uint64) & np.uint64((1 << BITS) - 1) | np.uint64(1 << 62)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique(np.concatenate([pair, again]))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, y = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in groups(text):
            doc, term = _terms(text[lo:hi])
            one = np.bincount(term, weights=y[lo:hi][doc], minlength=1 << BITS)
            both = np.bincount(term, minlength=1 << BITS)
            on = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(both[on], pa.int64()), pa.array(one[on].astype(np.int64), pa.int64())], names=["term", "n", "n1"])


@dataclass
class Machine:
    """bias, the kept terms (ascending), their weights and their factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[self.terms] = np.arange(len(self.terms))
        out = np.empty(len(texts))
        for lo, hi in groups(texts):
            doc, term = _terms(texts[lo:hi])
            at = place[term]
            doc, at = doc[at >= 0], at[at >= 0]
            n = hi - lo
            z = self.bias + np.bincount(doc, weights=self.weights[at], minlength=n)
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                z += 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _learn(rows: list[np.ndarray], y: np.ndarray, m: int, factors: int, seed: int = 7, epochs: int = 6, steps: int = 80, positive: float = 5.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss over rows of term places below m, label 1 counting `positive` times; Adam on blocks of rows (at least `epochs` rounds and `steps` blocks), ridge on weights and factors."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    params = [np.array([np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))], np.float32), np.zeros(m, np.float32), rng.normal(0, 0.01, (factors, m)).astype(np.float32)]
    first, second = [[np.zeros_like(p) for p in params] for _ in range(2)]
    step, block = 0, min(2048, n)
    blocks = max(1, n // block)
    for _ in range(max(epochs, -(-steps // blocks))):
        for own in np.array_split(rng.permutation(n), blocks):
            b, w, v = params
            at = np.concatenate([rows[i] for i in own])
            row = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            per_row = lambda x: np.bincount(row, weights=x, minlength=len(own))  # noqa: B023, E731
            s = np.stack([per_row(f[at]) for f in v])
            z = b[0] + per_row((w - 0.5 * (v * v).sum(axis=0))[at]) + 0.5 * (s * s).sum(axis=0)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * np.where(y[own] > 0, positive, 1) / len(own)
            per_term = lambda x: np.bincount(at, weights=x[row], minlength=m)  # noqa: B023, E731
            ag = per_term(g)
            grads = [np.array([g.sum()]), ag + RIDGE * w, np.stack([per_term(g * one) for one in s]) - ag * v + RIDGE * v]
            step += 1
            for p, d, m1, m2 in zip(params, grads, first, second, strict=True):
                d = d.astype(np.float32)
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1].astype(np.float64), params[2].T.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_fit: int = MAX_FIT, least: int = LEAST, telling: float = TELLING, factors: int = FACTORS) -> Machine:
    """Fit on at most max_fit rows; what comes to the driver is bounded by these and by the 2^BITS hashed places."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg((F.max(label) > 0).cast("long").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(max_fit)
    )
    # an id may have several texts: the bound holds for rows, whose hashes are drawn before any text is moved
    keyed = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_key")  # at most max_fit ids
    drawn = keyed.withColumn("_h", F.xxhash64("_key", "_text"))
    several = drawn.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        rows = drawn
    else:
        most = drawn.select("_h").orderBy("_h").limit(max_fit).agg(F.max("_h").alias("h"), F.count("*").alias("n")).first()
        rows = drawn.where(F.col("_h") <= most.h).dropDuplicates(["_h"])  # repeated rows count once
    counts = rows.select("_text", "_y").mapInArrow(_class_counts, "term long, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("n1")).first()
    if not size.n1 or size.n1 == size.n:
        return Machine(-30.0 if not size.n1 else 30.0, np.empty(0, np.int64), np.empty(0), np.empty((0, factors)))
    expected = F.col("n") * (size.n1 / size.n)
    chi2 = F.pow(F.col("n1") - expected, 2) / (expected * (1 - size.n1 / size.n))
    terms = np.sort(counts.where((F.col("n") >= least) & (chi2 >= telling)).select("term").toPandas()["term"].to_numpy(np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[terms] = np.arange(len(terms))
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            lists: list[np.ndarray] = []
            for lo, hi in groups(texts):
                doc, term = _terms(texts[lo:hi])
                at = place[term]
                doc, at = doc[at >= 0], at[at >= 0]
                lists += np.split(at, np.searchsorted(doc, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["at", "y", "h"])

    sample = rows.select("_text", "_y", "_h").mapInArrow(places, "at array<int>, y long, h long").toPandas().sort_values("h", kind="stable")
    bias, weights, vectors = _learn([np.asarray(x, np.int32) for x in sample["at"]], sample.y.to_numpy(np.float64), len(terms), factors)
    return Machine(bias, terms, weights, vectors)


def score(machine: Machine, text: Column) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def udf(col: pd.Series) -> pd.Series:
        return pd.Series(machine.scores([t if isinstance(t, str) else "" for t in col]))

    return udf(text)


def predict(df: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on)."""
    return df.withColumn("score", score(machine, F.col(text).cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))

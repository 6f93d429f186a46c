"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import words
from gleaner.operators.vectors import DIGITS
from gleaner.session import materialise

#: Words of the probe that brings needle and text together before containment is checked.
PROBE = 5
#: Short needles of one automaton.
LOT = 10_000


def holding(chunks: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, chunk_id) where a text holds a needle; needles (query_id, expected), at most LOT of them, become one automaton that reads each text once."""
    words_of: dict[str, list] = {}
    for r in needles.select("query_id", "expected").collect():  # at most LOT
        words_of.setdefault(r.expected, []).append(r.query_id)
    q_type, c_type = dict(needles.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words_of:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("content").to_pylist()):
                own = [q for w in {w for _, w in automaton.iter(text)} for q in words_of[w]] if text and words_of else []
                at += [i] * len(own)
                found += own
            ids = batch.column("chunk_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string() if q_type == "string" else pa.int64()), ids], names=["query_id", "chunk_id"])

    return chunks.select("chunk_id", "content").mapInArrow(read, f"query_id {q_type}, chunk_id {c_type}")


def label_relevant(chunks: DataFrame, needles: DataFrame, within: str | None = None) -> DataFrame:
    """(query_id, chunk_id) where a chunk contains the expected text; exact, without a pair loop.

    within: a column of both; a chunk then counts only if its value is the question's, as with the document that a
    question is about. Otherwise all chunks are looked through: a needle's inner words stand whole in any
    text that contains it, so one run of PROBE inner words is an equality key; `contains` then decides.
    Needles with fewer inner words are looked for by automata, a lot of at most LOT of them in one reading of the texts; so are all,
    where there are no more than LOT.
    """
    if within:
        pairs = needles.where(F.col("expected") != "").select("query_id", "expected", within).join(chunks.select("chunk_id", "content", within).hint("merge"), within)
        return pairs.where(F.col("content").contains(F.col("expected"))).select("query_id", "chunk_id").distinct()
    full = needles.where(F.col("expected") != "").select("query_id", "expected")
    if full.limit(LOT + 1).count() <= LOT:  # one reading of the texts finds them all, with nothing shuffled but what is found
        return holding(chunks, full).distinct()
    w = needles.select("query_id", "expected", words("expected").alias("w"))
    inner = w.withColumn("w", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))
    long = inner.where(F.size("w") >= PROBE).select("query_id", "expected", F.array_join(F.slice("w", 1, PROBE), " ").alias("probe"))
    cut = chunks.select("chunk_id", words("content").alias("w")).where(F.size("w") >= PROBE)
    grams = cut.select("chunk_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - PROBE + 1), lambda i: F.array_join(F.slice("w", i, PROBE), " ")))).alias("probe"))
    wanted = grams.join(long.hint("merge"), "probe").select("query_id", "chunk_id", "expected")
    found = wanted.join(chunks.select("chunk_id", "content").hint("merge"), "chunk_id").where(F.col("content").contains(F.col("expected")))
    short = inner.where((F.size("w") < PROBE) & (F.col("expected") != "")).select("query_id", "expected")
    out = found.select("query_id", "chunk_id")
    lots = -(-short.count() // (LOT // 2))  # lots come out near LOT / 2, so none exceeds LOT
    lot = F.pmod(F.xxhash64("query_id", "expected"), F.lit(max(1, lots)))
    for i in range(lots):
        out = out.unionByName(holding(chunks, short.where(lot == i)))
    return out.distinct()


def _metrics(queries: DataFrame, hits: DataFrame, all_: DataFrame, k: int) -> DataFrame:
    """hits: query_id, chunk_id, rank of relevant chunks found; all_: query_id, relevant (their number)."""
    found = hits.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("hits"), F.min("rank").alias("first"))
    rows = queries.select("query_id").distinct().join(found.hint("merge"), "query_id", "left").join(all_.hint("merge"), "query_id", "left").fillna(0, ["hits", "relevant"])
    return rows.select(
        "query_id",
        F.round(F.col("hits") / k, DIGITS).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), DIGITS).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("mrr"),
    )


def precision_recall_mrr(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, precision (hits / k), recall (0 if nothing is relevant), mrr."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)).hint("merge"), ["query_id", "chunk_id"])
    return _metrics(queries, hits, relevant.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("relevant")), k)


def class_precision_recall_mrr(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, by: str, k: int) -> DataFrame:
    """precision_recall_mrr where all chunks of a query's class (column `by` of both) are relevant, without a row for each such pair.

    Only ranked chunks are compared; of the others their number in a class is enough. A query and a chunk have one class each.
    """
    own = queries.select("query_id", F.col(by).alias("_class"))
    rows = ranked.where(F.col("rank") <= k).join(own.hint("merge"), "query_id").join(chunks.select("chunk_id", F.col(by).alias("_of")).hint("merge"), "chunk_id")
    many = chunks.groupBy(F.col(by).alias("_class")).agg(F.countDistinct("chunk_id").alias("relevant"))
    return _metrics(queries, rows.where("_class = _of"), own.join(many.hint("merge"), "_class").select("query_id", "relevant"), k)


def keyword_recall(keywords: Column, answer: Column) -> Column:
    """Share of keywords that the answer contains, case aside; no keywords: 1, no answer: 0."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w))))
    return F.when(F.size(keywords) <= 0, 1.0).when(low == "", 0.0).otherwise(F.round(found / F.size(keywords), DIGITS))


def backend_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """backend, metric, mean, least, most over questions without an error."""
    rows = metrics.unpivot("backend", names, "metric", "value").where("value is not null")
    return rows.groupBy("backend", "metric").agg(F.round(F.avg("value"), DIGITS).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def compare_backends(backends: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """backend, query_id, chunk_id, rank, score, error: the ranked lists of several back ends, each run by itself; one that fails is one row with its error."""
    out: list[DataFrame] = []
    failed: dict[str, str] = {}
    for name, make in backends.items():
        try:
            ranked = make().select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
            out.append(materialise(ranked.select(F.lit(name).alias("backend"), "*", F.lit(None).cast("string").alias("error")), "backend"))
        except Exception as e:  # whatever a back end raises is its own
            failed[name] = f"{type(e).__name__}: {e}".partition("\n")[0][:500]
    spark = SparkSession.active()
    if failed:
        kinds = dict(out[0].dtypes) if out else {"query_id": "long", "chunk_id": "long"}
        schema = f"backend string, query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank long, score double, error string"
        out.append(spark.createDataFrame([(name, None, None, None, None, e) for name, e in failed.items()], schema))
    return reduce(DataFrame.unionByName, out)

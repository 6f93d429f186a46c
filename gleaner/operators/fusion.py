"""Joining ranked lists, reranking, and what follows retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import lower_words, strip
from gleaner.operators.vectors import DIGITS, min_relevance, minmax_scores, top_k


def _stacked(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)))


def rrf(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over any number of lists."""
    return top_k(_stacked(lists).groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score")), k)


def rrf_zero_based(lists: list[DataFrame], final_k: int = 10, constant: int = 60) -> DataFrame:
    """Ranks from 0; the best final_k, then in the order of the lists (the first list's chunks first)."""
    order = F.min(F.struct("list", "rank"))
    kept = _stacked(lists).groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (constant + F.col("rank") - 1)), 9).alias("score"), order.alias("at"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "chunk_id"))
    kept = kept.withColumn("best", best).where(F.col("best") <= final_k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")).cast("long")).select("query_id", "chunk_id", "rank", "score")


def reciprocal_ensemble(lists: list[DataFrame], k: int = 20) -> DataFrame:
    """Sum of 1 / rank over the first 2k of each list."""
    return top_k(_stacked(lists).where(F.col("rank") <= 2 * k).groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / F.col("rank")), DIGITS).alias("score")), k)


def weighted_hybrid(lexical: DataFrame, dense: DataFrame, a: float = 0.5, b: float = 0.5, k: int = 20) -> DataFrame:
    """a / lexical rank + b * dense score; a missing part is 0; label says which part is larger."""
    left = lexical.select("query_id", "chunk_id", (a / F.col("rank")).alias("x"))
    right = dense.select("query_id", "chunk_id", (b * F.col("score")).alias("y"))
    both = left.join(right.hint("merge"), ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["x", "y"])
    label = F.when(F.col("x") > F.col("y"), "lexical").when(F.col("y") > F.col("x"), "dense").otherwise("hybrid")
    rows = both.select("query_id", "chunk_id", F.round(F.col("x") + F.col("y"), 9).alias("score"), label.alias("label"))
    return top_k(rows, k).join(rows.select("query_id", "chunk_id", "label").hint("merge"), ["query_id", "chunk_id"])


def coverage(question: Column | str, content: Column | str) -> Column:
    """The default pair scorer: the share of the question's distinct words that the text has."""
    q = F.array_distinct(lower_words(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, lower_words(content))) / F.size(q)).otherwise(0.0)


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, rerank_k: int = 10, scorer=coverage) -> DataFrame:
    """The first rerank_k with text get scorer values scaled to [0, 1]; all others follow with their old scores."""
    if not rerank_k:
        return ranked
    head = ranked.where(F.col("rank") <= rerank_k).join(queries.select("query_id", "question").hint("merge"), "query_id")
    head = head.join(chunks.select("chunk_id", "content").hint("merge"), "chunk_id")
    full = strip(F.coalesce("content", F.lit(""))) != ""
    pairs = head.select("query_id", "chunk_id", "rank", "score", full.alias("full"), F.when(full, F.round(scorer("question", "content"), DIGITS)).alias("pair"))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("pair").over(w), F.max("pair").over(w)
    scaled = F.when(hi - lo < 1e-10, F.col("pair")).otherwise(F.round((F.col("pair") - lo) / (hi - lo), DIGITS))
    first = pairs.withColumn("new", scaled)
    tail = ranked.where(F.col("rank") > rerank_k).select("query_id", "chunk_id", "rank", "score", F.lit(False).alias("full"), F.lit(None).cast("double").alias("new"))
    rows = first.select("query_id", "chunk_id", "rank", "score", "full", "new").unionByName(tail)
    order = Window.partitionBy("query_id").orderBy(F.desc("full"), F.desc_nulls_last("new"), "rank")
    return rows.select("query_id", "chunk_id", F.row_number().over(order).cast("long").alias("rank"), F.coalesce(F.when(F.col("full"), F.col("new")), F.col("score")).alias("score"))


def hybrid_weighted_search(lexical: DataFrame, dense: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    fused = weighted_hybrid(lexical, dense).drop("label")
    return min_relevance(rerank(fused, queries, chunks, 10), k)


def hybrid_rrf_search(lexical: DataFrame, dense: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    fused = rrf_zero_based([dense, lexical], 20)
    return min_relevance(minmax_scores(rerank(fused, queries, chunks, 10), top_one=True), k)


def dedup_by_prefix(ranked: DataFrame, chunks: DataFrame, n: int = 50) -> DataFrame:
    """The first of each lower-cased, trimmed prefix, in rank order."""
    rows = ranked.join(chunks.select("chunk_id", "content").hint("merge"), "chunk_id").withColumn("sig", F.substring(F.lower(strip("content")), 1, n))
    first = F.row_number().over(Window.partitionBy("query_id", "sig").orderBy("rank"))
    return rows.withColumn("f", first).where("f = 1").select("query_id", "chunk_id", "rank", "score")


def best_score_per_chunk(ranked: DataFrame, group: Column, k: int = 10) -> DataFrame:
    """Several sub-queries of one question: the best score of each chunk, then the first k."""
    return top_k(ranked.groupBy(group.alias("query_id"), "chunk_id").agg(F.max("score").alias("score")), k)

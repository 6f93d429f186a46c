"""A training corpus from raw documents: language, toxicity, near-duplicates, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. An empty table, null texts and repeated rows go through every stage: a null or
letterless text is rejected by the first, repeated rows are one group in the third.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import langid, neardup, packing, toxicity, wordbpe
from gleaner.session import bounded_batches, materialise, table

#: No profile is nearer than this to a text in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on: those without letters, or far from every profile, go."""
    bounded_batches(spark)
    profiles = langid.fit_profiles(docs.where(~langid.held_out()))
    found = docs.select(F.struct(*docs.columns).alias("row"), langid.language(profiles, F.col("text").cast("string")).alias("found"))
    return found.where((F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold go on."""
    bounded_batches(spark)
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    found = docs.select(F.struct(*docs.columns).alias("row"), toxicity.score(machine, F.col("text").cast("string")).alias("found"))
    return found.where(F.col("found") < toxicity.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by texts of 5-word Jaccard similarity 0.8 or more, the row with the smallest doc_id goes on, once (a row without an id only where no row has one).

    Rows are told apart by (doc_id, text), so another text under the same id is decided by its own group.
    """
    bounded_batches(spark)
    none, own, digest = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), neardup.text_digest(F.col("text").cast("string"))
    groups = materialise(neardup.near_duplicates(docs), "near-dedup")
    first = groups.groupBy("group").agg(F.min(F.struct(none.alias("none"), own.alias("own"), F.col("digest"))).alias("r")).select("r.*")
    # repeated rows of one id and text fall together before the shuffle
    once = docs.groupBy(none.alias("none"), own.alias("own"), digest.alias("digest")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return once.join(first.hint("merge"), ["none", "own", "digest"], "left_semi").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(wordbpe.TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: Profiles, a factorization machine and packing can't be said in SQL; tests/llm has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

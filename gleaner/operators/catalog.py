"""Documents, their configurations and strategies, and the query cache, as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import materialise


def documents_with_strategy(docs: DataFrame, strategies: DataFrame, owner: Column) -> DataFrame:
    """Documents of an owner with their strategy, newest first in `place`, which counts per owner."""
    newest = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created_at"), "doc_id"))
    return docs.where(owner).join(strategies.hint("merge"), "strategy_id").withColumn("place", newest)


def latest_config(configs: DataFrame, tie: str) -> DataFrame:
    """The newest configuration of each document."""
    row = F.struct("created_at", tie, *[c for c in configs.columns if c not in ("doc_id", "created_at", tie)])
    return configs.groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", "r.*")


def stage_progress(step: Column, saved: Column, total: Column) -> Column:
    """Percent of the stage, a whole number from 0 to 100: parsing and chunking by step, saving by rows."""
    share = F.when(total > 0, F.least(F.lit(100), F.floor(saved * 100 / total))).otherwise(F.lit(0))
    return F.when(step == "saving", share).when(step == "chunking", F.lit(50)).when(step == "done", F.lit(100)).otherwise(F.lit(0)).cast("long")


def scope_filter(chunks: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with a vector, of requested documents that the requester owns: query_id, chunk_id."""
    owned = requests.join(documents.select("doc_id", "owner").hint("merge"), ["doc_id", "owner"], "left_semi")
    return chunks.where("embedding is not null").join(owned.select("query_id", "doc_id").hint("merge"), "doc_id")


def page_chunks(chunks: DataFrame, offset: int, limit: int, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Rows offset + 1 to offset + limit of every document at once."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return chunks.withColumn("_n", n).where(F.col("_n").between(offset + 1, offset + limit)).drop("_n")


def cascade_delete(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(gone.select(key).hint("merge"), key, "left_anti")


def clear_embeddings(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their outcome: completed ones go back to pending and report their chunks, others are rejected."""
    rows = targets.select("doc_id").join(documents.hint("merge"), "doc_id")
    done = F.col("status") == "completed"
    return rows.select("doc_id", F.when(done, "pending").otherwise(F.col("status")).alias("status"), F.when(done, F.col("chunk_count")).otherwise(F.lit(0)).cast("long").alias("cleared"), (~done).alias("rejected"))


def pending_documents(documents: DataFrame) -> DataFrame:
    return documents.where("status = 'pending' and owner is not null")


def effective_config(requests: DataFrame, strategies: DataFrame, size: int = 1000, overlap: int = 200, configs: DataFrame | None = None) -> DataFrame:
    """Request over configuration over strategy over default; size within 50..2000 and overlap within 0..500, but for API manuals.

    configs: doc_id, c_size, c_over, one row for each document at most (as latest_config gives them).
    """
    rows = requests.join(strategies.select("strategy_id", F.col("chunk_size").alias("s_size"), F.col("chunk_overlap").alias("s_over"), "engine_type").hint("merge"), "strategy_id", "left")
    own = []
    if configs is not None:
        rows = rows.join(configs.select("doc_id", "c_size", "c_over").hint("merge"), "doc_id", "left")
        own = ["c_size", "c_over"]
    a, b = F.coalesce("r_size", *own[:1], "s_size", F.lit(size)), F.coalesce("r_over", *own[1:], "s_over", F.lit(overlap))
    free = F.coalesce(F.col("engine_type") == "api_docs", F.lit(False))
    return rows.select(
        "doc_id",
        F.when(free, a).otherwise(F.least(F.lit(2000), F.greatest(F.lit(50), a))).cast("long").alias("chunk_size"),
        F.when(free, b).otherwise(F.least(F.lit(500), F.greatest(F.lit(0), b))).cast("long").alias("chunk_overlap"),
    )


def cached_sources(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cached source ids as chunk rows in the order of the list; unknown ids are dropped, scores are 0."""
    ids = cache.select("event_id", F.posexplode("source_ids").alias("pos", "chunk_id"))
    return ids.join(chunks.hint("merge"), "chunk_id").withColumn("score", F.lit(0.0))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, their number from 1 in an order: sorted in ranges, each numbered by itself behind the counts of those before."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_part").count().collect()):  # a row for each range
        offsets.append((r["_part"], before))
        before += r["count"]
    known = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(known), "_part").withColumn("place", nth + F.col("_before")).drop("_part", "_before")


def list_strategies(strategies: DataFrame) -> DataFrame:
    """All but the default, system ones first, then by name, in `place`."""
    return numbered(strategies.where("strategy_id <> 'default'"), F.desc("is_system"), F.col("name"))


def reprocess(configs: DataFrame, targets: DataFrame) -> DataFrame:
    """The history with a further version for each target; old versions stay."""
    top = configs.groupBy("doc_id").agg(F.max("version").alias("version"))
    new = targets.select("doc_id").join(top.hint("merge"), "doc_id").select("doc_id", (F.col("version") + 1).alias("version"), F.lit(True).alias("current"))
    old = configs.select("doc_id", "version").join(targets.select("doc_id", F.lit(1).alias("t")).hint("merge"), "doc_id", "left").join(top.select("doc_id", F.col("version").alias("top")).hint("merge"), "doc_id")
    return old.select("doc_id", "version", (F.col("t").isNull() & (F.col("version") == F.col("top"))).alias("current")).unionByName(new)


def drop_stale_updates(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Updates that name the document's current configuration."""
    return updates.join(current.select("doc_id", "version").hint("merge"), ["doc_id", "version"])


def upsert_strategies(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows update the strategy of the same name, else that of the same id, else are added.

    Seed rows without an engine type or that are not system strategies are skipped.
    """
    use = seed.where("engine_type is not null and is_system")
    new = lambda k: use.select(F.col(k).alias(f"_{k}"), F.col("chunk_size").alias("_size"))
    named = existing.join(new("name").hint("merge"), existing.name == F.col("_name"), "left")
    by_id = use.join(existing.select("name").hint("merge"), "name", "left_anti").select(F.col("strategy_id").alias("_id"), F.col("chunk_size").alias("_size2"))
    updated = named.join(by_id.hint("merge"), named.strategy_id == F.col("_id"), "left").select("strategy_id", "name", F.coalesce("_size", "_size2", "chunk_size").alias("chunk_size"))
    added = use.join(existing.select("name").hint("merge"), "name", "left_anti").join(existing.select("strategy_id").hint("merge"), "strategy_id", "left_anti")
    return updated.unionByName(added.select("strategy_id", "name", "chunk_size"))


# -- query cache ----------------------------------------------------------------------


def cache_key(question: Column, document_ids: Column, *fields: Column) -> Column:
    """SHA-256 of the question (trimmed, lower case), the sorted document ids and further fields."""
    ids = F.array_join(F.array_sort(document_ids), ",")
    return F.sha2(F.concat_ws("|", F.lower(F.trim(question)), ids, *fields), 256)


def cache_lookup(probes: DataFrame, cache: DataFrame, ttl: int = 3) -> DataFrame:
    """Probes (key, now) with hit: whether an entry of that key is still valid. A ttl of 0 turns the cache off."""
    if ttl == 0:
        return probes.withColumn("hit", F.lit(False))
    last = cache.groupBy("key").agg(F.max("expires_at").alias("expires_at"))
    return probes.join(last.hint("merge"), "key", "left").withColumn("hit", F.coalesce(F.col("expires_at") > F.col("now"), F.lit(False))).drop("expires_at")


def cache_write(cache: DataFrame, answers: DataFrame, days: int = 3) -> DataFrame:
    """The cache with answers (its columns without expires_at) appended, each valid for some days from its ts; 0 days append nothing."""
    if days == 0:
        return cache
    return cache.unionByName(answers.withColumn("expires_at", F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).select(*cache.columns))


def cache_history(cache: DataFrame, now: Column, n: int = 50) -> DataFrame:
    """The n newest entries of each user with their place (1: newest) and whether they have expired."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return cache.withColumn("place", place.cast("long")).where(F.col("place") <= n).withColumn("expired", F.col("expires_at") <= now)


def cache_evict(cache: DataFrame, now: Column, owners: DataFrame | None = None) -> DataFrame:
    """Entries that are still valid and not of an owner to purge."""
    left = cache.where(F.col("expires_at") > now)
    return left if owners is None else left.join(owners.select("user_id").hint("merge"), "user_id", "left_anti")

"""Queries over documents, strategies and the query cache. Orders stand in for documents, line items for their versions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import catalog as B
from gleaner.plans.registry import query
from gleaner.session import table

DOCS = """dcs AS (SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_custkey END AS owner, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderdate AS created_at,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'parsing' WHEN '2' THEN 'chunking' WHEN '3' THEN 'saving' WHEN '4' THEN 'done' ELSE 'saving' END AS step FROM orders),
cfg AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS version, l_shipdate AS created_at, l_linestatus FROM lineitem),
cnt AS (SELECT doc_id, count(*) AS chunk_count, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS saved FROM cfg GROUP BY 1)"""


def documents(spark, sf):
    step = F.element_at(F.create_map(*(F.lit(x) for x in ("1", "parsing", "2", "chunking", "3", "saving", "4", "done"))), F.substring("o_orderpriority", 1, 1))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("owner"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.coalesce(step, F.lit("saving")).alias("step"))


def configs(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_shipdate").alias("created_at"), "l_linestatus")


def counts(spark, sf):
    return configs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("saved"))


STRATEGIES = """str AS (SELECT 's' || s_suppkey AS strategy_id, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 37 % 2500 END AS chunk_size, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 13 % 600 END AS chunk_overlap,
CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'api_docs' ELSE 'recursive' END AS engine_type, s_suppkey % 3 = 0 AS is_system, s_suppkey FROM supplier)"""


def strategies(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("strategy_id"),
        F.col("s_name").alias("name"),
        F.when(k % 5 != 0, k * 37 % 2500).alias("chunk_size"),
        F.when(k % 5 != 0, k * 13 % 600).alias("chunk_overlap"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 4 == 0, "api_docs").otherwise("recursive").alias("engine_type"),
        (k % 3 == 0).alias("is_system"),
        "s_suppkey",
    )


@query(f"WITH {DOCS} SELECT doc_id, c_name AS strategy, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, doc_id) AS place FROM dcs JOIN customer ON owner = c_custkey WHERE owner % 10 = 3")
def documents_with_strategy(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("strategy_id"), F.col("c_name").alias("strategy"))
    return B.documents_with_strategy(documents(spark, sf).withColumn("strategy_id", F.col("owner")), s, F.col("owner") % 10 == 3).select("doc_id", "strategy", F.col("place").cast("long").alias("place"))


@query(f"WITH {DOCS} SELECT doc_id, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, version DESC) AS r FROM cfg) WHERE r = 1")
def latest_config(spark, sf):
    return B.latest_config(configs(spark, sf), "version").select("doc_id", "version")


@query(f"WITH {DOCS} SELECT dcs.doc_id, CAST(CASE step WHEN 'saving' THEN CASE WHEN chunk_count > 0 THEN least(100, saved * 100 // chunk_count) ELSE 0 END WHEN 'chunking' THEN 50 WHEN 'done' THEN 100 ELSE 0 END AS BIGINT) AS percent FROM dcs JOIN cnt ON cnt.doc_id = dcs.doc_id")
def stage_progress(spark, sf):
    d = documents(spark, sf).join(counts(spark, sf).hint("merge"), "doc_id")
    return d.select("doc_id", B.stage_progress(F.col("step"), F.col("saved"), F.col("chunk_count")).alias("percent"))


@query("SELECT CAST(e.label AS BIGINT) AS query_id, e.vec_id AS chunk_id FROM embeddings e JOIN labels l ON l.doc_id = e.label AND l.quality = 1 WHERE e.vec_id % 6 <> 5")
def scope_filter(spark, sf):
    e, owners = table(spark, sf, "embeddings"), table(spark, sf, "labels").select("doc_id", F.col("quality").alias("owner"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("doc_id"), F.when(F.col("vec_id") % 6 != 5, F.col("embedding")).alias("embedding"))
    asked = e.select(F.col("label").cast("long").alias("query_id"), F.col("label").cast("long").alias("doc_id"), F.lit(1).alias("owner")).distinct()
    return B.scope_filter(chunks, asked, owners).select("query_id", "chunk_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n BETWEEN 2 AND 4")
def page_chunks(spark, sf):
    return B.page_chunks(table(spark, sf, "conversations"), 1, 3, "conv_id", "turn").select("conv_id", "turn")


@query("SELECT l.doc_id, source, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def index_with_owner(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source").hint("merge"), "doc_id").select("doc_id", "source", F.col("quality"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cascade_delete(spark, sf):
    return B.cascade_delete(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("toxic = 1"))


@query(f"WITH {DOCS} SELECT dcs.doc_id, CASE WHEN status = 'completed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'completed' THEN chunk_count ELSE 0 END AS cleared, status <> 'completed' AS rejected FROM dcs JOIN cnt ON cnt.doc_id = dcs.doc_id WHERE owner % 5 = 1")
def clear_embeddings(spark, sf):
    d = documents(spark, sf).join(counts(spark, sf).hint("merge"), "doc_id")
    return B.clear_embeddings(d, d.where("owner % 5 = 1").select("doc_id"))


@query(f"WITH {DOCS} SELECT doc_id, owner FROM dcs WHERE status = 'pending' AND owner IS NOT NULL")
def pending_documents(spark, sf):
    return B.pending_documents(documents(spark, sf)).select("doc_id", "owner")


@query(f"""WITH {STRATEGIES}, req AS (SELECT c_custkey AS doc_id, 's' || (c_custkey % 150) AS strategy_id, CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 11 % 3000 END AS r_size, CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 700 END AS r_over FROM customer),
m AS (SELECT doc_id, coalesce(r_size, CASE WHEN doc_id % 5 = 0 THEN doc_id * 13 % 2500 END, chunk_size, 1000) AS a, coalesce(r_over, CASE WHEN doc_id % 10 = 0 THEN doc_id % 900 END, chunk_overlap, 200) AS b, coalesce(engine_type = 'api_docs', FALSE) AS free FROM req LEFT JOIN str USING (strategy_id))
SELECT doc_id, CASE WHEN free THEN a ELSE least(2000, greatest(50, a)) END AS chunk_size, CASE WHEN free THEN b ELSE least(500, greatest(0, b)) END AS chunk_overlap FROM m""")
def effective_config(spark, sf):
    k = F.col("c_custkey")
    req = table(spark, sf, "customer").select(k.alias("doc_id"), F.concat(F.lit("s"), (k % 150).cast("string")).alias("strategy_id"), F.when(k % 6 == 0, k * 11 % 3000).alias("r_size"), F.when(k % 8 == 0, k % 700).alias("r_over"))
    # every fifth document has a configuration, every tenth with an overlap
    own = req.where("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") * 13 % 2500).alias("c_size"), F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") % 900).alias("c_over"))
    return B.effective_config(req, strategies(spark, sf), configs=own)


@query(f"WITH {STRATEGIES} SELECT strategy_id, row_number() OVER (ORDER BY is_system DESC, name) AS place FROM str WHERE strategy_id <> 'default'")
def list_strategies(spark, sf):
    return B.list_strategies(strategies(spark, sf)).select("strategy_id", "place")


@query(f"""WITH {DOCS}, tg AS (SELECT doc_id FROM dcs WHERE owner % 5 = 1), tp AS (SELECT doc_id, max(version) AS top FROM cfg GROUP BY 1)
SELECT cfg.doc_id, version, cfg.doc_id NOT IN (SELECT doc_id FROM tg) AND version = top AS current FROM cfg JOIN tp ON tp.doc_id = cfg.doc_id UNION ALL SELECT tp.doc_id, top + 1, TRUE FROM tp JOIN tg ON tg.doc_id = tp.doc_id""")
def reprocess(spark, sf):
    return B.reprocess(configs(spark, sf), documents(spark, sf).where("owner % 5 = 1"))


@query(f"WITH {DOCS}, tp AS (SELECT doc_id, max(version) AS version FROM cfg GROUP BY 1) SELECT cfg.doc_id, cfg.version, cfg.l_linestatus FROM cfg JOIN tp ON tp.doc_id = cfg.doc_id AND tp.version = cfg.version")
def drop_stale_updates(spark, sf):
    c = configs(spark, sf)
    return B.drop_stale_updates(c, c.groupBy("doc_id").agg(F.max("version").alias("version"))).select("doc_id", "version", "l_linestatus")


@query(f"""WITH {STRATEGIES}, ex AS (SELECT strategy_id, name, chunk_size FROM str WHERE s_suppkey % 2 = 0), us AS (SELECT CASE WHEN s_suppkey % 6 = 3 THEN 's' || (s_suppkey + 1) ELSE strategy_id END AS strategy_id, name, s_suppkey AS chunk_size FROM str WHERE engine_type IS NOT NULL AND is_system),
nn AS (SELECT * FROM us WHERE name NOT IN (SELECT name FROM ex))
SELECT ex.strategy_id, ex.name, coalesce(a.chunk_size, b.chunk_size, ex.chunk_size) AS chunk_size FROM ex LEFT JOIN us a ON a.name = ex.name LEFT JOIN nn b ON b.strategy_id = ex.strategy_id UNION ALL SELECT strategy_id, name, chunk_size FROM nn WHERE strategy_id NOT IN (SELECT strategy_id FROM ex)""")
def upsert_strategies(spark, sf):
    s = strategies(spark, sf)
    seed = s.withColumns({"strategy_id": F.when(F.col("s_suppkey") % 6 == 3, F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string"))).otherwise(F.col("strategy_id")), "chunk_size": F.col("s_suppkey")})
    return B.upsert_strategies(s.where("s_suppkey % 2 = 0").select("strategy_id", "name", "chunk_size"), seed)


# -- query cache -----------------------------------------------------------------------

CACHE = """cch AS (SELECT event_id, 'k' || (event_id % 40) AS key, user_id, ts, ts + INTERVAL 3 DAY AS expires_at, [event_id % 1000, event_id * 7 % 1000, 999999] AS ids FROM events)"""


def cache(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("k"), (e % 40).cast("string")).alias("key"), "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"), F.array(e % 1000, e * 7 % 1000, F.lit(999999).cast("long")).alias("source_ids"))


@query(f"WITH {CACHE}, x AS (SELECT event_id, unnest(range(0, 3)) AS pos, ids FROM cch) SELECT event_id, pos, ids[pos + 1] AS chunk_id, lang, 0.0::DOUBLE AS score FROM x JOIN documents ON doc_id = ids[pos + 1]")
def cached_sources(spark, sf):
    return B.cached_sources(cache(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")).select("event_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "lang", "score")


@query("SELECT event_id, sha256(lower(trim(text)) || '|' || array_to_string(list_sort([event_id % 1000, event_id * 7 % 1000]), ',') || '|' || event_type || '|10') AS key FROM events JOIN benchmark ON item_id = event_id % 40")
def cache_key(spark, sf):
    rows = table(spark, sf, "events").withColumn("item_id", F.col("event_id") % 40).join(table(spark, sf, "benchmark").hint("merge"), "item_id")
    e = F.col("event_id")
    return rows.select("event_id", B.cache_key(F.col("text"), F.array(e % 1000, e * 7 % 1000), F.col("event_type"), F.lit("10")).alias("key"))


@query(f"WITH {CACHE}, l AS (SELECT key, max(expires_at) AS e FROM cch WHERE event_id % 3 = 0 GROUP BY 1) SELECT event_id, coalesce(e > ts + INTERVAL 10 DAY, FALSE) AS hit FROM cch LEFT JOIN l USING (key) WHERE event_id % 3 = 1")
def cache_lookup(spark, sf):
    c = cache(spark, sf)
    probes = c.where("event_id % 3 = 1").select("event_id", "key", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("now"))
    return B.cache_lookup(probes, c.where("event_id % 3 = 0")).select("event_id", "hit")


@query(f"WITH {CACHE} SELECT event_id, key, expires_at FROM cch WHERE event_id % 3 = 0 UNION ALL SELECT event_id, key, ts + INTERVAL 3 DAY FROM cch WHERE event_id % 3 <> 0")
def cache_write(spark, sf):
    c = cache(spark, sf)
    return B.cache_write(c.where("event_id % 3 = 0"), c.where("event_id % 3 <> 0").drop("expires_at")).select("event_id", "key", "expires_at")


@query(f"WITH {CACHE} SELECT event_id, user_id, place, expires_at <= TIMESTAMP '2024-01-20 00:00:00' AS expired FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM cch) WHERE place <= 50")
def cache_history(spark, sf):
    return B.cache_history(cache(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "user_id", "place", "expired")


@query(f"WITH {CACHE} SELECT event_id FROM cch WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00' AND user_id % 10 <> 4")
def cache_evict(spark, sf):
    c = cache(spark, sf)
    return B.cache_evict(c, F.lit("2024-01-20 00:00:00").cast("timestamp"), c.where("user_id % 10 = 4").select("user_id").distinct()).select("event_id")


@query("""WITH r AS (SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, n <= 30 AS allowed FROM r""")
def rate_limit_all_requests(spark, sf):
    """How many of the last 60 seconds' requests, accepted or not."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-60, 0)
    return table(spark, sf, "events").select("event_id", (F.count("*").over(w) <= 30).alias("allowed"))

"""Queries that run streams, files and specs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import camel_tokens, words
from gleaner.operators import chunking as C
from gleaner.operators import evaluation as K
from gleaner.operators import fusion as I
from gleaner.operators import graph as GR
from gleaner.operators import lexical as H
from gleaner.operators import vectors as G
from gleaner.plans import graph as PG
from gleaner.plans import retrieval as R
from gleaner.plans.chunking import LINES, WINDOWS
from gleaner.plans.registry import ORACLES, query
from gleaner.session import materialise, scratch_path, table
from gleaner.sources import files, specs
from gleaner.streaming import jobs


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, content, round(length(content) / sqrt(length(content) * length(content) + 10000), 6) AS first_value FROM win")
def stream_ingest(spark, sf):
    """The embedder is a small one of its own: the length beside a hundred, scaled to unit length."""
    out = scratch_path(spark, "ingest")
    small = lambda c: F.array(F.length(c) * 1.0, F.lit(100.0))
    jobs.ingest(jobs.files_as_stream(spark, f"{sf}/documents.parquet"), C.chunk_token_window, out, lambda chunks: G.embed_texts(chunks, "content", embedder=small))
    rows = jobs.ingested(spark, out).where("status = 'completed'")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.round(F.element_at("embedding", 1), 6).alias("first_value"))


@query("SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_progress(spark, sf):
    out = scratch_path(spark, "progress")
    jobs.progress(jobs.files_as_stream(spark, f"{sf}/events.parquet"), out)
    return jobs.latest(spark, out)


@query("SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 3 = user_id % 3) WHERE n = 1")
def stream_progress_current(spark, sf):
    """Events come from three configurations; a user's number tells the current one."""
    out = scratch_path(spark, "progress")
    current = table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).alias("config_id")).distinct()
    jobs.progress(jobs.files_as_stream(spark, f"{sf}/events.parquet").withColumn("config_id", F.col("event_id") % 3), out, current)
    return jobs.latest(spark, out)


RATE = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS k, []::DOUBLE[] AS log, NULL::BIGINT AS event_id, FALSE AS accepted FROM e UNION ALL
SELECT user_id, event_type, k, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END, event_id, len(l) < 3 FROM (SELECT e.user_id, e.event_type, e.k, e.t, e.event_id, list_filter(r.log, lambda x: x >= e.t - 21600) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1))
SELECT event_id, accepted FROM r WHERE k > 0"""
#: A miss of a key is its first row, or its first at least three days after the miss before.
REPLAY = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, event_id % 40 AS key, ts, row_number() OVER (PARTITION BY event_id % 40, ts ORDER BY event_id) AS k FROM events),
m AS (SELECT key, min(ts) AS t FROM e GROUP BY 1 UNION ALL SELECT m.key, min(e.ts) FROM m JOIN e ON e.key = m.key AND e.ts >= m.t + INTERVAL 3 DAY GROUP BY 1)
SELECT event_id, NOT (m.t IS NOT NULL AND k = 1) AS hit FROM e LEFT JOIN m ON m.key = e.key AND m.t = e.ts"""


@query(RATE)
def stream_rate_limit(spark, sf):
    out = scratch_path(spark, "rate-limit")
    jobs.rate_limit_stream(jobs.files_as_stream(spark, f"{sf}/events.parquet"), out, limit=3, seconds=6 * 3600)
    return jobs.answered(spark, out)


@query(RATE)
def rate_limit(spark, sf):
    return jobs.rate_limit(table(spark, sf, "events"), limit=3, seconds=6 * 3600)


def _log(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")).alias("key"), "ts")


@query(REPLAY)
def stream_cache_replay(spark, sf):
    out = scratch_path(spark, "cache-replay")
    jobs.cache_replay_stream(_log(jobs.files_as_stream(spark, f"{sf}/events.parquet")), out, 3 * 86400)
    return jobs.answered(spark, out)


@query(REPLAY)
def cache_replay(spark, sf):
    return jobs.cache_replay(_log(table(spark, sf, "events")), 3 * 86400)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR) SELECT event_id, user_id FROM l WHERE n <= 5 ORDER BY ts DESC, event_id LIMIT 1000""")
def stream_expire_tasks(spark, sf):
    out = scratch_path(spark, "tasks")
    jobs.expire_tasks_stream(jobs.files_as_stream(spark, f"{sf}/events.parquet"), out, hours=48, per_user=5)
    return jobs.newest_table(spark, out).select("event_id", "user_id")


# -- files ----------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT content AS line, count(*) AS n FROM ele GROUP BY 1")
def scan_text_files(spark, sf):
    out = scratch_path(spark, "text")
    C.lines(table(spark, sf, "documents")).select("content").write.text(out)
    rows = files.scan_text_files(spark, out).select(F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(F.trim("line") != "").groupBy("line").agg(F.count("*").alias("n"))


def _specs(spark, sf) -> DataFrame:
    """A spec for every 20 customers; every fifth is no spec."""
    k = F.col("c_custkey").cast("string")
    op = F.concat(F.lit('{"summary": "'), "c_mktsegment", F.lit('"'), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(', "operationId": "op'), k, F.lit('"'))).otherwise(""), F.lit(', "tags": ["a", "b"], "parameters": [{"name": "a", "in": "query"}, {"name": "b"}], "responses": {"200": {"description": "ok"}, "404": {}}}'))
    path = F.concat(F.lit('"/c/'), k, F.lit('": {"get": '), op, F.lit(', "post": {"description": "new", "requestBody": {"required": true}}, "x-note": {}}'))
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 20).alias("spec_id"), path.alias("p"))
    head = F.when(F.col("spec_id") % 5 != 4, '{"openapi": "3.0.0", "paths": {').otherwise('{"paths": {')
    return rows.groupBy("spec_id").agg(F.array_join(F.sort_array(F.collect_list("p")), ", ").alias("all")).select("spec_id", F.concat(head, "all", F.lit("}}")).alias("spec"))


ENDPOINTS = """ep AS (SELECT c_custkey // 20 AS spec_id, '/c/' || c_custkey AS path, m AS method, CASE WHEN m = 'get' AND c_custkey % 4 <> 0 THEN 'op' || c_custkey ELSE m || '_/c/' || c_custkey END AS operation_id, CASE m WHEN 'get' THEN c_mktsegment ELSE '' END AS summary, CASE m WHEN 'get' THEN 'a,b' ELSE '' END AS tags, CASE m WHEN 'post' THEN 'new' ELSE '' END AS description, CASE m WHEN 'get' THEN '{"name":"a","in":"query"};{"name":"b"}' ELSE '' END AS parameters, CASE m WHEN 'post' THEN '{"required":true}' END AS request_body, CASE m WHEN 'get' THEN '200,404' ELSE '' END AS responses FROM customer, (SELECT unnest(['get', 'post']) AS m) WHERE c_custkey // 20 % 5 <> 4)"""


@query(f"WITH {ENDPOINTS} SELECT * FROM ep")
def openapi_endpoints(spark, sf):
    return specs.openapi_endpoints(_specs(spark, sf)).withColumns({"parameters": F.array_join("parameters", ";"), "responses": F.array_join("responses", ",")})


@query(f"WITH {ENDPOINTS} SELECT spec_id, string_agg('- **' || upper(method) || '** `' || path || '` ' || summary, chr(10) ORDER BY path, method) AS overview FROM ep GROUP BY 1")
def openapi_overview(spark, sf):
    return specs.openapi_overview(specs.openapi_endpoints(_specs(spark, sf)))


@query(r"SELECT item_id // 10 AS set_id, 'q' || item_id AS question_id, array_to_string(list_slice(list_filter(regexp_split_to_array(benchmark.text, '\s+'), lambda w: w <> ''), 1, 8), ' ') AS question, benchmark.text AS source, CAST(item_id AS BIGINT) AS min_answer_length, CASE WHEN NOT contains(d.text, benchmark.text) THEN 1 ELSE 0 END::BIGINT AS n_missing FROM benchmark LEFT JOIN documents d ON doc_id = item_id WHERE item_id // 10 % 3 <> 2")
def load_eval_dataset(spark, sf):
    q = table(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 10).alias("set_id"), F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.array_join(F.slice(words("text"), 1, 8), " ").alias("question"), F.col("item_id").cast("string").alias("document"), F.array("text").alias("expected_sources"), F.col("item_id").alias("min_answer_length")).alias("q"))
    sets = q.groupBy("set_id").agg(F.collect_list("q").alias("questions"))
    texts = sets.select("set_id", F.to_json(F.struct(F.when(F.col("set_id") % 3 != 2, "1").alias("version"), "questions")).alias("json"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document"), F.col("text").alias("content"))
    return specs.load_eval_dataset(texts, docs).select("set_id", "question_id", "question", F.element_at("expected_sources", 1).alias("source"), "min_answer_length", F.size("missing_sources").cast("long").alias("n_missing"))


@query(f"""WITH {R.MET}, s AS ({ORACLES['backend_summary']}), v AS (SELECT query_id, hits / 10 AS precision, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS recall, coalesce(1.0 / first, 0) AS mrr FROM met)
SELECT '| ' || metric || ' | ' || format('{{:.4f}}', mean) || ' |' AS line FROM s UNION ALL SELECT unnest(['### ' || query_id, '**flat**', '- mrr: ' || format('{{:.4f}}', round(mrr::DOUBLE, 6)), '- precision: ' || format('{{:.4f}}', round(precision::DOUBLE, 6)), '- recall: ' || format('{{:.4f}}', round(recall::DOUBLE, 6))]) FROM v""")
def write_eval_report(spark, sf):
    path = scratch_path(spark, "report")
    metrics = materialise(R.vec_metrics(spark, sf), "metrics")
    summary = K.backend_summary(metrics.withColumn("backend", F.lit("flat")), ["precision", "recall", "mrr"])
    results = metrics.unpivot("query_id", ["precision", "recall", "mrr"], "metric", "value").select(F.col("query_id").alias("question"), F.lit("flat").alias("backend"), "metric", "value")
    specs.write_eval_report(summary, path, results)
    return spark.read.text(f"{path}/markdown").union(spark.read.text(f"{path}/questions-markdown")).select(F.col("value").alias("line"))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id, 'more' FROM documents WHERE doc_id % 3 = 0")
def persist_index(spark, sf):
    """Two writes; the second replaces the documents that it holds and leaves the others."""
    path = scratch_path(spark, "index")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    specs.persist_index(rows, path)
    specs.persist_index(rows.where("chunk_id % 3 = 0").select("chunk_id", F.explode(F.array(F.lit("new"), F.lit("more"))).alias("lang")), path)
    return specs.load_index(spark, path)


@query(f"WITH {R.bm25(R.camel)} SELECT chunk_id, term, tf, lang FROM wgt JOIN documents ON doc_id = chunk_id")
def load_index(spark, sf):
    path = scratch_path(spark, "index")
    specs.persist_index(materialise(H.postings(R.chunks(spark, sf)).select("chunk_id", "term", "tf"), "postings"), path)  # no weights are kept
    owners = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    return specs.load_index(spark, path, owners)


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, unnest({R.camel('text')}) AS term FROM documents), p AS (SELECT doc_id, count(*) AS n_terms FROM t GROUP BY 1)
SELECT ele.doc_id, pos, content, lang, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS dense, n_terms FROM ele JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 9) USING (doc_id) JOIN p USING (doc_id)""")
def persist_documents(spark, sf):
    """Lines, words and vectors of all documents but every fourth's vectors; then every third again, without vectors; loaded for nine owners in ten."""
    path, docs = scratch_path(spark, "documents"), table(spark, sf, "documents")
    nodes = C.lines(docs).withColumn("chunk_id", F.col("pos").cast("long"))
    words_ = lambda d: H.postings(d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))).withColumn("doc_id", F.col("chunk_id"))
    vectors = G.embed_texts(nodes.select("doc_id", "chunk_id", "content"), "content", embedder=lambda c: F.array(F.length(c) * 1.0, F.lit(1.0)))
    vectors = vectors.select("doc_id", "chunk_id", "embedding")
    specs.persist_documents(path, nodes, words_(docs), vectors.where("doc_id % 4 <> 0"))
    again = "doc_id % 3 = 0"
    specs.persist_documents(path, nodes.where(again), words_(docs.where(again)), vectors.where("false"))
    terms = specs.load_index(spark, f"{path}/postings", key="doc_id").groupBy("doc_id").agg(F.sum("tf").alias("n_terms"))  # summed before they meet owners
    owners = docs.where("doc_id % 10 <> 9").select("doc_id", "lang").join(terms.hint("merge"), "doc_id")
    return specs.load_documents(spark, path, owners)[0].select("doc_id", F.col("pos").cast("long").alias("pos"), "content", "lang", F.col("embedding").isNotNull().alias("dense"), "n_terms")


# -- graph search ---------------------------------------------------------------------------


ASKED = "qst AS (SELECT chunk_id AS query_id, name || ' ' || content AS question FROM nod WHERE kind IN ('interface', 'method'))"
SEARCHED = f"""{PG.NODES}, kwt AS MATERIALIZED (SELECT chunk_id, keywords AS text FROM ({PG.KEYWORDS})), {R.bm25(R.camel, ASKED, "SELECT chunk_id, text FROM kwt")}, {R.hashed('dv', 'chunk_id', 'kwt', 'text')}, {R.hashed('qv', 'query_id', 'qst', 'question')},
ds AS (SELECT query_id, chunk_id, round(sum(qv.s * dv.s), 6) AS score FROM qv JOIN dv USING (plc) GROUP BY 1, 2), d10 AS ({R.topk('ds', 10)}), l10 AS ({R.topk('(SELECT * FROM bm WHERE score > 0)', 10)}),
fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM d10 UNION ALL SELECT * FROM l10) GROUP BY 1, 2), f5 AS ({R.topk('fu', 5)}), {R.reranked('f5', 'SELECT * FROM kwt', 5)}"""


@query(rf"""WITH {SEARCHED}, fnd AS (SELECT query_id, chunk_id, score FROM rr), {PG.REFS.replace('idx', 'tix')}, p1 AS (SELECT query_id, nod.parent_id AS chunk_id FROM exp JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL), p2 AS (SELECT query_id, nod.parent_id AS chunk_id FROM p1 JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL),
grw AS (SELECT query_id, chunk_id FROM exp UNION SELECT * FROM p1 UNION SELECT * FROM p2), bc AS (SELECT query_id, nod.parent_id AS chunk_id, score FROM fnd JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL UNION ALL SELECT query_id, target, score FROM ref JOIN tix USING (doc_id, tn)), bs AS (SELECT query_id, chunk_id, round(max(score) * 0.7, 6) AS o FROM bc GROUP BY 1, 2)
SELECT grw.query_id, grw.chunk_id, coalesce(fnd.score, o) AS score FROM grw LEFT JOIN fnd ON fnd.query_id = grw.query_id AND fnd.chunk_id = grw.chunk_id LEFT JOIN bs ON bs.query_id = grw.query_id AND bs.chunk_id = grw.chunk_id""")
def hybrid_graph_search(spark, sf):
    """Questions are all interfaces and methods; lexical and dense lists are fused, then grown along names and parents."""
    nodes = materialise(PG.nodes(spark, sf), "graph")
    queries = materialise(nodes.where("kind in ('interface', 'method')").select(F.col("chunk_id").alias("query_id"), F.concat("name", F.lit(" "), "content").alias("question")), "graph-questions")
    texts = materialise(GR.keyword_text(PG.metadata(spark, sf)).select("chunk_id", F.col("keywords").alias("content")), "graph-texts")
    lexical = H.bm25_topk_positive(queries, H.Texts(texts, many=True), 10, camel_tokens)
    dense = G.scanned_topk(G.embed_words(queries, "query_id", "question"), G.embed_words(texts, "chunk_id", "content"), 10, alike=True)
    ranked = materialise(I.rerank(I.rrf([lexical, dense], 5), queries, texts, 5).select("query_id", "chunk_id", "score"), "graph-ranked")
    grown = GR.expand_parents(GR.expand_type_refs(ranked, nodes), nodes)
    return GR.propagate_scores(grown, ranked, nodes)

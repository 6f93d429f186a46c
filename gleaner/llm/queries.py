"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chunkprint, hardnegatives, hilbert, langid, maintext, packing, pii, piecebpe, prefixtrie, simhash, tokenfiles, toxicity, warc, wordbpe
from gleaner.session import scratch_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = scratch_path(spark, "warc")
    warc.page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.regexp_extract("payload_digest", "^sha256:([0-9a-f]{64})$", 1))
    return read.select(
        warc.page_id("record_id").alias("page_id"),
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(wordbpe.TOKENIZER))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.predict(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract_pages(table(spark, sf_dir, "pages"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs.where(~langid.held_out()))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(wordbpe.TOKENIZER))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(piecebpe.MODEL))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_toxicity, op4_maintext, op5_fingerprint, op6_simhash, op7_langid, op8_neighbours, op9_tokens, op10_pieces, op11_negatives, op12_trie, op13_pii)}


#: The same questions in DuckDB SQL, where it can ask them; tests/llm holds the others to brute-force versions.
SQL = {
    "op1_warc": """WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM d), r AS (SELECT *, n >= 100 AND first <> page_id AS again FROM f)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op8_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) / (q.n * c.n) AS score FROM s q JOIN s c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op11_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM s a JOIN s c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
f AS (SELECT a, c, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT f.a AS anchor_id, f.c AS positive_id, CAST(row_number() OVER (PARTITION BY f.a, f.c ORDER BY p.score DESC, p.c) AS INTEGER) AS rank, p.c AS negative_id, f.score AS positive_score, p.score AS negative_score
FROM f JOIN p ON p.a = f.a AND NOT p.same AND 30 * f.score <= 100 * p.score AND 100 * p.score <= 90 * f.score QUALIFY rank <= 10""",
    "op12_trie": """WITH b AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, y: list_reduce(list_prepend(xor(s, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, 3988292384 * (t & 1))))) % 9 AS h FROM (SELECT c, count(*) AS n FROM b GROUP BY c)),
r AS (SELECT k.c, b.o, 0 AS own, role, text FROM k JOIN b ON b.c = k.c - k.c % 5 AND b.o <= h UNION ALL SELECT k.c, b.o, 1, role, text FROM k JOIN b ON b.c = k.c AND b.o > h),
t AS (SELECT c, row_number() OVER w AS d, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, md5(string_agg(sha256(role) || sha256(text), '' ) OVER w) AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY own, o)),
m AS (SELECT c, d, p, bytes, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS q, lead(p) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM t
UNION ALL SELECT c, 0, '', 0, NULL, c NOT IN (SELECT c FROM t) FROM k),
v AS (SELECT d, p, min(c) AS conv, count(*) AS n, max(bytes) AS bytes, min(q) AS q, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM m GROUP BY d, p),
x AS (SELECT q, count(*) AS kids FROM v GROUP BY q),
w AS (SELECT DISTINCT a.d AS ad, a.p AS ap, y.d AS yd, y.p AS yp FROM m a JOIN m y ON a.c = y.c AND y.d >= a.d),
s AS (SELECT ad, ap, CAST(sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum((n - 1) * bytes) AS BIGINT) AS saved FROM w JOIN v ON yd = v.d AND yp = v.p LEFT JOIN x ON x.q = v.p GROUP BY ad, ap)
SELECT v.conv AS conv_id, CAST(v.d AS BIGINT) AS depth, u.conv AS parent_conv_id, v.n AS n_convs, coalesce(x.kids, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN s ON s.ad = v.d AND s.ap = v.p LEFT JOIN x ON x.q = v.p LEFT JOIN v u ON u.p = v.q AND u.d = v.d - 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

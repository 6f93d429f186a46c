"""Queries over chunks of documents."""

from pyspark.sql import functions as F

from gleaner.functions.text import strip, words
from gleaner.operators import chunking as C
from gleaner.plans.registry import query
from gleaner.session import table

#: Windows of 200 tokens, 40 shared, as SQL over documents.
WINDOWS = r"""
tok AS (SELECT doc_id, regexp_extract_all(text, '\S+|\n') AS t FROM documents),
cut AS (SELECT doc_id, unnest(range(0, len(t), 160)) AS i, t FROM tok),
raw AS (SELECT doc_id, i, regexp_replace(array_to_string(list_slice(t, i + 1, i + 200), ' '), '^\s+|\s+$', '', 'g') AS content FROM cut),
win AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, content FROM raw WHERE length(content) >= 20)"""
LINES = r"""
lin AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS p FROM documents),
ele AS (SELECT doc_id, pos, p[pos + 1] AS content FROM lin WHERE regexp_replace(p[pos + 1], '^\s+|\s+$', '', 'g') <> '')"""
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query()
def chunk_recursive(spark, sf):
    return C.chunk_recursive(docs(spark, sf))


@query(f"WITH {WINDOWS} SELECT doc_id, chunk_index, content FROM win")
def chunk_token_window(spark, sf):
    return C.chunk_token_window(docs(spark, sf)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"WITH {WINDOWS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(sum({WORDS.format('content')}) AS BIGINT) AS n_words FROM win GROUP BY doc_id")
def chunk_stats(spark, sf):
    return C.chunk_stats(C.chunk_token_window(docs(spark, sf)))


@query(f"WITH {LINES}, k AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'enum' WHEN 2 THEN NULL ELSE 'record' END AS kind FROM ele), g AS (SELECT doc_id, coalesce(kind, 'mixed') AS kind, count(*) AS n, sum(length(content)) AS c, sum({WORDS.format('content')}) AS w FROM k GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(c) AS BIGINT) AS n_chars, CAST(sum(w) AS BIGINT) AS n_words, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM g GROUP BY 1")
def chunk_stats_by_type(spark, sf):
    m = F.col("pos") % 4
    kind = F.when(m == 0, "function").when(m == 1, "enum").when(m == 3, "record")
    rows = C.chunk_stats(C.lines(docs(spark, sf)).withColumn("kind", kind), "kind")
    return rows.withColumn("kinds", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ","))


@query(f"WITH {LINES} SELECT doc_id, pos, content FROM ele")
def document_elements(spark, sf):
    return C.lines(docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, pos // 20 AS a, pos // 5 AS b, pos, content FROM ele), n AS (SELECT DISTINCT doc_id, 'part ' || a AS content, 0 AS depth, [-a] AS path FROM e UNION ALL SELECT DISTINCT doc_id, 'section ' || b, 1, [-a, b % 4] FROM e UNION ALL SELECT doc_id, content, 2, [-a, b % 4, pos * 7 % 5] FROM e)
SELECT doc_id, content, CAST(depth AS BIGINT) AS depth, array_to_string(path, '.') AS path, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS pos FROM n""")
def document_elements_tree(spark, sf):
    """Parts of twenty lines in falling order, sections of five, lines in an order of their own."""
    e = C.lines(docs(spark, sf)).withColumn("pos", F.col("pos").cast("long")).withColumns({"a": F.floor(F.col("pos") / 20), "b": F.floor(F.col("pos") / 5)})
    text = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    node = lambda key, parent, order, content: ("doc_id", key.alias("element_id"), parent.alias("parent_id"), order.cast("long").alias("ord"), content.alias("content"))
    parts = e.select(*node(text("a", "a"), none, -F.col("a"), text("part ", "a"))).distinct()
    sections = e.select(*node(text("b", "b"), text("a", "a"), F.col("b") % 4, text("section ", "b"))).distinct()
    leaves = e.select(*node(text("c", "pos"), text("b", "b"), F.col("pos") * 7 % 5, F.col("content")))
    t = C.flatten_elements(parts.unionByName(sections).unionByName(leaves))
    return t.select("doc_id", "content", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "pos")


@query(f"WITH {LINES}, x AS (SELECT *, CASE WHEN pos % 3 <> 0 THEN pos * 0.5 END AS v FROM ele) SELECT doc_id, content, min(pos) AS chunk_index, arg_min(v, pos) FILTER (WHERE v IS NOT NULL)::DOUBLE AS first_value FROM x GROUP BY doc_id, content")
def dedup_chunks_exact(spark, sf):
    """Every third line has no vector; the others' vectors name their line."""
    i = F.col("pos").cast("long")
    rows = C.lines(docs(spark, sf)).select("doc_id", i.alias("chunk_index"), "content", F.when(i % 3 != 0, F.array(i * F.lit(0.5))).alias("embedding"))
    return C.dedup_chunks_exact(rows).select("doc_id", "content", "chunk_index", F.element_at("embedding", 1).alias("first_value"))


HEADINGS = rf"""
stp AS (SELECT doc_id, pos, content, regexp_replace(content, '^\s+|\s+$', '', 'g') AS c FROM ele),
knd AS (SELECT doc_id, pos, CASE WHEN regexp_matches(c, '^#{{1,2}}\s+\S') THEN 'markdown' WHEN regexp_matches(c, '^([0-9]+\.|[A-Z]\)|[IVX]+\.)\s+\S') THEN 'numbered'
  WHEN length(c) > 5 AND length(c) < 100 AND upper(c) = c AND lower(c) <> c THEN 'caps'
  WHEN length(c) > 10 AND length(c) < 80 AND regexp_matches(c, '^\p{{Lu}}') AND {WORDS.format('c')} >= 2 AND NOT regexp_matches(c, '[.:!?]$') THEN 'short_line' END AS kind FROM stp),
bnd AS (SELECT doc_id, pos, kind, CAST(CASE kind WHEN 'markdown' THEN 90 WHEN 'numbered' THEN 85 WHEN 'caps' THEN 75 ELSE 60 END AS BIGINT) AS priority FROM knd WHERE kind IS NOT NULL)"""


@query(f"WITH {LINES}, {HEADINGS} SELECT doc_id, pos, kind, priority FROM bnd")
def heading_boundaries(spark, sf):
    return C.heading_boundaries(C.lines(docs(spark, sf))).withColumns({"pos": F.col("pos").cast("long"), "priority": F.col("priority").cast("long")})


SEGMENTS = r"""
mrk AS (SELECT stp.doc_id, stp.pos, stp.c, sum(CASE WHEN bnd.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY stp.doc_id ORDER BY stp.pos) AS segment FROM stp LEFT JOIN bnd ON stp.doc_id = bnd.doc_id AND stp.pos = bnd.pos),
seg AS (SELECT doc_id, CAST(segment AS BIGINT) AS segment, string_agg(c, chr(10) || chr(10) ORDER BY pos) AS content FROM mrk GROUP BY doc_id, segment)"""


@query(f"WITH {LINES}, {HEADINGS}, {SEGMENTS} SELECT * FROM seg")
def assemble_segments(spark, sf):
    elements = C.lines(docs(spark, sf))
    return C.assemble_segments(elements, C.heading_boundaries(elements))


@query(rf"""WITH {WINDOWS}, lg AS (SELECT *, list_filter(regexp_split_to_array(coalesce(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), ''), '\s+'), lambda w: w <> '') AS b FROM win)
SELECT doc_id, chunk_index, CASE WHEN len(b) > 10 THEN array_to_string(list_slice(b, len(b) - 9, len(b)), ' ') || ' ' || content ELSE content END AS content FROM lg""")
def overlap_prefix(spark, sf):
    return C.overlap_prefix(C.chunk_token_window(docs(spark, sf))).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(rf"""WITH {WINDOWS} SELECT w.doc_id, chunk_index, sha256(w.doc_id::VARCHAR || '|' || chunk_index::VARCHAR || '|' || content) AS chunk_id, regexp_extract('/data/' || source, '([^/]*)$', 1) AS basename, CASE WHEN chunk_index % 2 = 0 THEN array_to_string(list_concat(['make', 'page'], list_filter(['get', 'set', 'create', 'delete', 'enum', 'record', 'interface', 'error'], lambda t: contains(lower(content), t))), ',') END AS keywords FROM win w JOIN documents d ON w.doc_id = d.doc_id""")
def enrich_chunk_metadata(spark, sf):
    d = docs(spark, sf)
    chunks = C.chunk_token_window(d).join(d.select("doc_id", F.concat(F.lit("/data/"), "source").alias("source")).hint("merge"), "doc_id")
    named = chunks.withColumn("name", F.when(F.col("chunk_index") % 2 == 0, "MakePage"))
    return C.enrich_chunk_metadata(named).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "basename", F.array_join("keywords", ",").alias("keywords"))


#: Patterns of one's own beside the library's.
OWN = [("number", r"[0-9]{3,}", 65), ("email", r"[a-zA-Z0-9._]+@[a-zA-Z0-9.]+", 95), ("license", r"[Ll]icen[sc]e", 75)]
SOUGHT = sorted([*C.PATTERNS, *OWN], key=lambda p: (-p[2], p[0]))


@query(rf"""WITH {LINES}, m AS (SELECT doc_id, pos, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p, _ in SOUGHT)}], lambda x: x IS NOT NULL), ',') AS names FROM ele) SELECT * FROM m WHERE names <> ''""")
def match_patterns(spark, sf):
    return C.match_patterns(C.lines(docs(spark, sf)), [*C.PATTERNS, *OWN]).select("doc_id", F.col("pos").cast("long").alias("pos"), "names")


STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH RECURSIVE {LINES}, e AS MATERIALIZED (SELECT doc_id, pos, {STRIPPED.format('content')} AS c, {WORDS.format('content')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM ele),
t AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM e),
f AS MATERIALIZED (SELECT a.doc_id, a.k, greatest(coalesce(b.k, a.m + 1), a.k + 1) AS nxt, a.m FROM t a ASOF LEFT JOIN t b ON a.doc_id = b.doc_id AND a.total - a.n + 200 < b.total),
g AS (SELECT doc_id, 1::BIGINT AS k, 0::BIGINT AS i FROM (SELECT DISTINCT doc_id FROM t) UNION ALL SELECT g.doc_id, CASE WHEN f.m BETWEEN 4 AND 10000 THEN f.nxt ELSE f.m + 1 END, g.i + 1 FROM g JOIN f ON f.doc_id = g.doc_id AND f.k = g.k),
s AS (SELECT doc_id, i, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS till FROM g)
SELECT s.doc_id, s.i AS chunk_index, string_agg(t.c, chr(10) || chr(10) ORDER BY t.k) AS content FROM s JOIN t ON t.doc_id = s.doc_id AND t.k >= s.k AND t.k < s.till GROUP BY 1, 2""")
def pack_paragraphs(spark, sf):
    return C.pack_lines(docs(spark, sf).where("doc_id is not null")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def segments(spark, sf):
    e = C.lines(docs(spark, sf))
    return C.assemble_segments(e, C.heading_boundaries(e)).withColumn("chunk_index", F.col("segment").cast("int"))


@query()
def split_oversized(spark, sf):
    return C.split_oversized(segments(spark, sf))


@query(rf"""WITH {LINES}, e AS (SELECT doc_id, pos, {STRIPPED.format('content')} AS c, {WORDS.format('content')} < 50 AS short, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ele),
r AS (SELECT *, coalesce(max(CASE WHEN NOT short THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, lead(c) OVER (PARTITION BY doc_id ORDER BY k) AS nxt, lead(pos) OVER (PARTITION BY doc_id ORDER BY k) AS np FROM e),
a AS (SELECT *, short AND (k - b) % 2 = 1 AND nxt IS NOT NULL AS takes FROM r),
z AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY k), FALSE) AS gone FROM a)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, CASE WHEN takes THEN c || chr(10) || chr(10) || nxt ELSE c END AS content, takes::BIGINT AS merged, CASE WHEN takes THEN pos || ',' || np ELSE pos::VARCHAR END AS merged_from FROM z WHERE NOT gone""")
def merge_undersized(spark, sf):
    rows = C.lines(docs(spark, sf)).select("doc_id", F.col("pos").alias("chunk_index"), strip("content").alias("content"))
    return C.merge_undersized(rows).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.col("merged").cast("long").alias("merged"), F.array_join("merged_from", ",").alias("merged_from"))


@query(rf"""WITH n AS (SELECT lang, {WORDS.format('text')} AS n FROM documents), r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM n)
SELECT lang, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, max(CASE WHEN i = c * 50 // 100 THEN n END) AS p50, max(CASE WHEN i = c * 90 // 100 THEN n END) AS p90, max(CASE WHEN i = c * 95 // 100 THEN n END) AS p95, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY lang""")
def token_distribution(spark, sf):
    return C.token_distribution(docs(spark, sf).withColumn("n", F.size(words("text")).cast("long")), ["lang"])


@query("SELECT coalesce(event_type, 'mixed') AS element_type, count(*) AS n FROM events GROUP BY 1")
def element_type_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.coalesce("event_type", F.lit("mixed")).alias("element_type")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT greatest(1, 100 // count(DISTINCT lang)) AS k FROM documents), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) AS r FROM documents)
SELECT doc_id, lang FROM r, k WHERE r <= k""")
def stratified_sample(spark, sf):
    return C.stratified_sample(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 100)

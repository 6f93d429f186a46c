"""Queries over the chunk graph (one interface for each brand, methods from parts) and over page links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import graph as G
from gleaner.plans.chunking import LINES
from gleaner.plans.registry import query
from gleaner.session import table

DOC = "CAST(substr(p_brand, 7) AS BIGINT)"


def entities(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Interfaces with methods and parameters, enums with values, of 5 documents."""
    p = table(spark, sf, "part").selectExpr(f"{DOC} % 5 AS doc_id", f"'I' || {DOC} AS raw", "p_partkey", "p_size", "p_type", f"{DOC} AS b").withColumn("name", F.concat(F.lit("IBrand"), F.col("b").cast("string")))
    param = lambda n, t, d: F.struct(n.alias("name"), t.alias("type"), d.alias("description"))
    s = F.col("p_size").cast("string")
    params = F.array(param(F.concat(F.lit("a"), s), F.lit("long"), F.lit("")), param(F.lit("b"), F.concat(F.lit("EType"), (F.col("p_partkey") % 6).cast("string")), F.lit("the kind")))
    methods = p.groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("Get"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("IBrand"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("returns"), params.alias("params"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("description")))).alias("methods"))
    enums = p.select("doc_id", F.concat(F.lit("EType"), (F.col("p_partkey") % 6).cast("string")).alias("name"), F.col("p_size").alias("k")).distinct().groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("v"), F.col("k").cast("string")).alias("name"), F.col("k").cast("string").alias("value")))).alias("values"))
    return methods, enums


def others(spark, sf) -> dict[str, DataFrame]:
    """A property (every fourth without an interface), a paragraph, a table, an error code and a record field of each part."""
    p = table(spark, sf, "part").selectExpr(f"{DOC} % 5 AS doc_id", f"CASE WHEN p_partkey % 4 <> 0 THEN 'IBrand' || {DOC} END AS interface", "p_partkey AS k", "p_size", "p_name", "p_type")
    k = F.col("k").cast("string")
    fields = F.sort_array(F.collect_list(F.struct(F.concat(F.lit("f"), k).alias("name"), F.lit("long").alias("type"))))
    return {
        "properties": p.select("doc_id", "interface", F.concat(F.lit("Prop"), k).alias("name"), F.lit("long").alias("type"), F.when(F.col("k") % 3 == 0, "read").alias("access"), F.col("p_name").alias("description")),
        "paragraphs": p.select("doc_id", "interface", F.col("k").alias("pos"), F.col("p_name").alias("content")),
        "tables": p.select("doc_id", F.col("k").alias("pos"), F.col("p_type").alias("content")),
        "errors": p.select("doc_id", F.concat(F.lit("err"), k).alias("name"), (-F.col("p_size")).alias("value"), F.col("p_type").alias("description")),
        "records": p.groupBy("doc_id", F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("name")).agg(fields.alias("fields")),
    }


def metadata(spark, sf) -> DataFrame:
    return G.node_metadata(*entities(spark, sf), **others(spark, sf))


def nodes(spark, sf) -> DataFrame:
    return G.build_chunk_graph(*entities(spark, sf), **others(spark, sf)).withColumn("level", F.col("level").cast("long"))


NODES = f"""pt AS MATERIALIZED (SELECT {DOC} % 5 AS doc_id, 'IBrand' || {DOC} AS i, 'Get' || p_partkey AS m, 'IBrand' || (p_partkey % 25 + 1) AS r, 'a' || p_size AS a, 'EType' || (p_partkey % 6) AS t, p_size, p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN 'IBrand' || {DOC} END AS itf, p_name, p_type FROM part),
em AS MATERIALIZED (SELECT DISTINCT doc_id, t, p_size FROM pt), ev AS MATERIALIZED (SELECT doc_id, t, string_agg('v' || p_size || ' = ' || p_size, ', ' ORDER BY 'v' || p_size) AS vs FROM em GROUP BY 1, 2),
nod AS MATERIALIZED (SELECT DISTINCT doc_id, md5(doc_id || '/' || i) AS chunk_id, NULL AS parent_id, 'interface' AS kind, 0::BIGINT AS level, i AS name, 'Interface ' || i AS content FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/' || i || '/' || m), md5(doc_id || '/' || i), 'method', 1, m, r || ' ' || m || '(long ' || a || ', ' || t || ' b)' FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/' || i || '/' || m || '/' || a), md5(doc_id || '/' || i || '/' || m), 'parameter', 2, a, a || ': long' FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/' || i || '/' || m || '/b'), md5(doc_id || '/' || i || '/' || m), 'parameter', 2, 'b', 'b: ' || t FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/' || t), NULL, 'enum', 0, t, 'Enum ' || t || ': ' || vs FROM ev
UNION ALL SELECT doc_id, md5(doc_id || '/' || t || '/v' || p_size), md5(doc_id || '/' || t), 'enum_value', 1, 'v' || p_size, 'v' || p_size || ' = ' || p_size FROM em
UNION ALL SELECT doc_id, md5(doc_id || '/property/' || coalesce(itf, '') || '/Prop' || k), md5(doc_id || '/' || itf), 'property', CASE WHEN itf IS NULL THEN 0 ELSE 1 END, 'Prop' || k, 'Prop' || k || ': long' FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/paragraph/' || k), md5(doc_id || '/' || itf), 'paragraph', CASE WHEN itf IS NULL THEN 0 ELSE 1 END, 'Paragraph ' || k, p_name FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/table/' || k), NULL, 'generic_table', 0, 'Table ' || k, p_type FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/error/err' || k), NULL, 'error_code', 0, 'err' || k, 'err' || k || ' = ' || -p_size || ': ' || p_type FROM pt
UNION ALL SELECT doc_id, md5(doc_id || '/record/R' || p_size), NULL, 'record', 0, 'R' || p_size, 'Record R' || p_size || ': ' || string_agg('f' || k || ': long', ', ' ORDER BY 'f' || k) FROM pt GROUP BY doc_id, p_size
UNION ALL SELECT doc_id, md5(doc_id || '/record/R' || p_size || '/f' || k), md5(doc_id || '/record/R' || p_size), 'record_field', 1, 'f' || k, 'f' || k || ': long' FROM pt)"""
# ranked nodes: all methods, parameters, properties and record fields, by document as query
FOUND = "fnd AS (SELECT doc_id AS query_id, chunk_id, rank, round(1.0 / rank, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rank FROM nod WHERE kind IN ('method', 'parameter', 'property', 'record_field')))"


def found(spark, sf, n: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")).cast("long")
    return n.where("kind in ('method', 'parameter', 'property', 'record_field')").select(F.col("doc_id").alias("query_id"), "chunk_id", rank.alias("rank")).withColumn("score", F.round(1 / F.col("rank"), 6))


@query(f"WITH {NODES} SELECT * FROM nod")
def build_chunk_graph(spark, sf):
    return nodes(spark, sf)


@query(f"WITH {NODES} SELECT doc_id, kind, count(*) AS n FROM nod WHERE level < 2 GROUP BY 1, 2")
def prune_chunk_graph(spark, sf):
    return G.build_chunk_graph(*entities(spark, sf), max_depth=2, **others(spark, sf)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT parent_id AS chunk_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS children FROM nod WHERE parent_id IS NOT NULL GROUP BY 1")
def graph_children(spark, sf):
    return G.graph_children(nodes(spark, sf)).select("chunk_id", F.array_join("child_ids", ",").alias("children"))


@query(f"WITH {NODES} SELECT chunk_id, parent_id, kind, level, name, content FROM nod")
def graph_from_json(spark, sf):
    return G.graph_from_json(G.graph_to_json(nodes(spark, sf))).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {NODES}, {FOUND}, p1 AS (SELECT query_id, nod.parent_id AS chunk_id FROM fnd JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL), p2 AS (SELECT query_id, nod.parent_id AS chunk_id FROM p1 JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL) SELECT query_id, chunk_id FROM fnd UNION SELECT * FROM p1 UNION SELECT * FROM p2")
def expand_parents(spark, sf):
    n = nodes(spark, sf)
    return G.expand_parents(found(spark, sf, n), n)


REFS = r"""ref AS (SELECT query_id, nod.doc_id, score, unnest(list_distinct(regexp_extract_all(content, '\b([IE][A-Z]\w*)\b', 1))) AS tn FROM fnd JOIN nod USING (chunk_id)), idx AS (SELECT doc_id, name AS tn, chunk_id AS target FROM nod WHERE kind IN ('interface', 'enum')),
exp AS (SELECT query_id, chunk_id FROM fnd UNION SELECT query_id, target FROM ref JOIN idx USING (doc_id, tn))"""


@query(f"WITH {NODES}, {FOUND}, {REFS} SELECT * FROM exp")
def expand_type_refs(spark, sf):
    n = nodes(spark, sf)
    return G.expand_type_refs(found(spark, sf, n), n)


@query(f"""WITH {NODES}, {FOUND}, {REFS}, bc AS (SELECT query_id, nod.parent_id AS chunk_id, score FROM fnd JOIN nod USING (chunk_id) WHERE nod.parent_id IS NOT NULL UNION ALL SELECT query_id, target, score FROM ref JOIN idx USING (doc_id, tn)), bs AS (SELECT query_id, chunk_id, round(max(score) * 0.7, 6) AS o FROM bc GROUP BY 1, 2)
SELECT exp.query_id, exp.chunk_id, coalesce(fnd.score, o) AS score FROM exp LEFT JOIN fnd ON fnd.query_id = exp.query_id AND fnd.chunk_id = exp.chunk_id LEFT JOIN bs ON bs.query_id = exp.query_id AND bs.chunk_id = exp.chunk_id""")
def propagate_scores(spark, sf):
    n = nodes(spark, sf)
    f = found(spark, sf, n)
    return G.propagate_scores(G.expand_type_refs(f, n), f, n)


KEYWORDS = """SELECT DISTINCT md5(doc_id || '/' || i) AS chunk_id, i AS keywords FROM pt
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m), i || ' ' || m || ' ' || r || ' Parameters: ' || a || ' (long); b (' || t || '): the kind' || CASE WHEN k % 2 = 0 THEN ' ' || p_type ELSE '' END FROM pt
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m || '/' || a), i || ' ' || m || ' ' || a || ' long' FROM pt
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m || '/b'), i || ' ' || m || ' b ' || t || ' the kind' FROM pt
UNION ALL SELECT md5(doc_id || '/' || t), t || ' ' || string_agg('v' || p_size, ', ' ORDER BY 'v' || p_size) FROM em GROUP BY doc_id, t
UNION ALL SELECT md5(doc_id || '/' || t || '/v' || p_size), t || ' v' || p_size FROM em
UNION ALL SELECT md5(doc_id || '/property/' || coalesce(itf, '') || '/Prop' || k), concat_ws(' ', itf, 'Prop' || k, 'long', p_name) FROM pt
UNION ALL SELECT md5(doc_id || '/paragraph/' || k), p_name FROM pt
UNION ALL SELECT md5(doc_id || '/table/' || k), p_type FROM pt
UNION ALL SELECT md5(doc_id || '/error/err' || k), 'err' || k || ' ' || -p_size || ' ' || p_type FROM pt
UNION ALL SELECT md5(doc_id || '/record/R' || p_size), 'R' || p_size FROM pt GROUP BY doc_id, p_size
UNION ALL SELECT md5(doc_id || '/record/R' || p_size || '/f' || k), 'R' || p_size || ' f' || k || ' long' FROM pt"""


@query(f"WITH {NODES} {KEYWORDS}")
def keyword_text(spark, sf):
    return G.keyword_text(metadata(spark, sf))


@query(f"WITH {NODES}, {FOUND} SELECT query_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE kind = 'method'), '') AS functions, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE kind IN ('interface', 'enum')), '') AS types FROM fnd JOIN nod USING (chunk_id) GROUP BY 1")
def collect_names(spark, sf):
    n = nodes(spark, sf)
    return G.collect_names(found(spark, sf, n), n)


@query(f"WITH {NODES} SELECT doc_id AS query_id, chunk_id, rank, round(1.0 / rank, 6) AS score, kind, name, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rank FROM nod WHERE kind IN ('method', 'parameter', 'property', 'record_field'))")
def resolve_sources(spark, sf):
    n = nodes(spark, sf)
    extra = found(spark, sf, n)
    return G.resolve_sources(extra.unionByName(extra.limit(1).withColumn("chunk_id", F.lit("unknown"))), n)


@query(f"WITH {NODES}, {FOUND} SELECT query_id, string_agg(DISTINCT name, ',' ORDER BY name) AS params FROM fnd JOIN nod USING (chunk_id) WHERE rank <= 100 AND kind IN ('parameter', 'property', 'record_field') GROUP BY 1")
def canonical_params(spark, sf):
    n = nodes(spark, sf)
    return G.canonical_params(found(spark, sf, n), n)


# -- links: a conversation is a document, a turn a page, half a turn's text a chunk ------------------

LINKS = """cv AS (SELECT conv_id AS doc_id, turn AS page, text, split_part(text, ' ', 1) AS w FROM conversations), chk AS (SELECT doc_id, page, page * 2 + h AS chunk_index FROM cv, (SELECT unnest(range(0, 2)) AS h)),
lnk AS (SELECT c.doc_id, c.page AS source_page, d.page AS target_page, CASE WHEN c.page % 3 = 0 THEN 'https://ex.org/' || c.doc_id || '/' || c.page END AS uri, c.w AS anchor FROM cv c LEFT JOIN cv d ON d.doc_id = c.doc_id AND d.page = c.page + 2),
lo AS (SELECT l.doc_id, a.chunk_index, b.chunk_index AS target, uri, anchor FROM lnk l JOIN chk a ON a.doc_id = l.doc_id AND a.page = l.source_page LEFT JOIN chk b ON b.doc_id = l.doc_id AND b.page = l.target_page)"""


def links(spark, sf) -> tuple[DataFrame, DataFrame]:
    cv = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.split_part("text", F.lit(" "), F.lit(1)).alias("anchor"))
    chunks = cv.select("doc_id", "page", F.explode(F.array(F.col("page") * 2, F.col("page") * 2 + 1)).alias("chunk_index"))
    target = cv.select("doc_id", (F.col("page") - 2).alias("source_page"), F.col("page").alias("target_page"))
    uri = F.when(F.col("source_page") % 3 == 0, F.concat(F.lit("https://ex.org/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("source_page").cast("string")))
    out = cv.withColumnRenamed("page", "source_page").join(target.hint("merge"), ["doc_id", "source_page"], "left").withColumn("uri", uri)
    return out, chunks


@query(f"WITH {LINKS} SELECT DISTINCT doc_id, chunk_index, target, uri, anchor FROM lo WHERE target IS NOT NULL OR uri IS NOT NULL")
def resolve_links(spark, sf):
    return G.resolve_links(*links(spark, sf))[0]


@query(f"WITH {LINKS}, b AS (SELECT DISTINCT doc_id, target AS chunk_index, chunk_index AS target, anchor FROM lo WHERE target IS NOT NULL) SELECT doc_id, chunk_index, target, anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY target, anchor) AS n FROM b) WHERE n <= 10")
def resolve_backlinks(spark, sf):
    return G.resolve_links(*links(spark, sf))[1]


@query(f"""WITH {LINKS}, eg AS (SELECT DISTINCT doc_id, chunk_index, target FROM lo WHERE target IS NOT NULL UNION SELECT doc_id, target, chunk_index FROM lo WHERE target IS NOT NULL), rk AS (SELECT c.doc_id % 10 AS query_id, c.doc_id, chunk_index, round(1.0 / (1 + chunk_index), 6) AS score FROM chk c JOIN conversations u ON u.conv_id = c.doc_id AND u.turn = c.page AND u.role = 'user'),
nw AS (SELECT query_id, r.doc_id, target AS chunk_index, round(max(score) * 0.85, 6) AS score FROM rk r JOIN eg ON eg.doc_id = r.doc_id AND eg.chunk_index = r.chunk_index GROUP BY 1, 2, 3), al AS (SELECT *, 0 AS new FROM rk UNION ALL SELECT *, 1 FROM nw WHERE NOT EXISTS (SELECT 1 FROM rk r WHERE r.query_id = nw.query_id AND r.doc_id = nw.doc_id AND r.chunk_index = nw.chunk_index)),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new, score DESC, doc_id, chunk_index) AS n, count(CASE WHEN new = 0 THEN 1 END) OVER (PARTITION BY query_id) AS m FROM al) SELECT query_id, doc_id, chunk_index, score FROM nn WHERE n <= m * 2""")
def expand_with_links(spark, sf):
    """What users say is ranked; links lead on to the rest."""
    l, chunks = links(spark, sf)
    forward, _ = G.resolve_links(l, chunks)
    one = forward.where("target is not null").select("doc_id", "chunk_index", "target")
    edges = one.unionByName(one.select("doc_id", F.col("target").alias("chunk_index"), F.col("chunk_index").alias("target")))
    asked = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    ranked = chunks.join(asked.hint("merge"), ["doc_id", "page"]).select((F.col("doc_id") % 10).alias("query_id"), "doc_id", "chunk_index", F.round(1 / (1 + F.col("chunk_index")), 6).alias("score"))
    return G.expand_with_links(ranked, edges)


# -- metadata of document lines -----------------------------------------------------------------

META = f"""{LINES}, mta AS (SELECT doc_id, pos AS idx, content, CASE (doc_id + pos) % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'COM_ENUM' WHEN 2 THEN 'mixed' WHEN 3 THEN NULL WHEN 4 THEN 'record' ELSE 'property' END AS kind, CASE WHEN pos % 4 <> 3 THEN 'I' || (doc_id % 30) END AS interface, CASE WHEN pos % 5 <> 4 THEN 'name' || pos END AS name,
CASE WHEN pos % 3 = 0 THEN 'Part ' || doc_id END AS section, CASE pos % 5 WHEN 0 THEN '' || pos END AS p1, CASE pos % 5 WHEN 1 THEN 'x' END AS p2, CASE pos % 5 WHEN 2 THEN '' || (pos - 2) WHEN 3 THEN '' || (doc_id + 1) END AS p3 FROM ele)"""


def meta(spark, sf) -> DataFrame:
    from gleaner.operators.chunking import lines

    e = lines(table(spark, sf, "documents")).withColumn("pos", F.col("pos").cast("long"))
    return e.selectExpr(
        "doc_id",
        "pos AS idx",
        "content",
        "CASE (doc_id + pos) % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'COM_ENUM' WHEN 2 THEN 'mixed' WHEN 3 THEN NULL WHEN 4 THEN 'record' ELSE 'property' END AS kind",
        "CASE WHEN pos % 4 <> 3 THEN 'I' || (doc_id % 30) END AS interface",
        "CASE WHEN pos % 5 <> 4 THEN 'name' || pos END AS name",
        "CASE WHEN pos % 3 = 0 THEN 'Part ' || doc_id END AS section",
        "CASE pos % 5 WHEN 0 THEN '' || pos END AS p1",
        "CASE pos % 5 WHEN 1 THEN 'x' END AS p2",
        "CASE pos % 5 WHEN 2 THEN '' || (pos - 2) WHEN 3 THEN '' || (doc_id + 1) END AS p3",
    )


def _positive(c: str) -> str:
    return f"CASE WHEN try_cast({c} AS BIGINT) > 0 THEN try_cast({c} AS BIGINT) END"


@query(f"WITH {META} SELECT doc_id, idx, coalesce({', '.join(_positive(c) for c in ('p1', 'p2', 'p3'))}, 1) AS page FROM mta")
def resolve_page(spark, sf):
    return meta(spark, sf).select("doc_id", "idx", G.resolve_page(F.col("p1"), F.col("p2"), F.col("p3")).alias("page"))


@query(f"WITH {META} SELECT doc_id, idx, concat_ws(' | ', 'Interface: ' || interface, 'Section: ' || section, 'Element: ' || name) AS prefix FROM mta")
def context_prefix(spark, sf):
    return meta(spark, sf).select("doc_id", "idx", G.context_prefix(F.col("interface"), F.col("section"), F.col("name")).alias("prefix"))


@query(f"WITH {META} SELECT doc_id, idx, CASE WHEN kind IS NOT NULL AND name IS NOT NULL THEN CASE kind WHEN 'COM_ENUM' THEN 'Com Enum' ELSE upper(left(kind, 1)) || substr(kind, 2) END || ': ' || name || chr(10) || content WHEN section IS NOT NULL THEN section || chr(10) || content WHEN kind IS NOT NULL THEN '[' || kind || '] ' || content ELSE content END AS text FROM mta")
def augment_text(spark, sf):
    return meta(spark, sf).select("doc_id", "idx", G.augment_text(F.col("content"), F.col("kind"), F.col("name"), F.col("section")).alias("text"))


@query(f"WITH {META} SELECT doc_id, idx, concat_ws(',', CASE WHEN kind <> 'mixed' AND interface IS NULL THEN 'interface' END, CASE WHEN kind <> 'mixed' AND name IS NULL THEN 'element_name' END, CASE WHEN kind = 'function' AND NOT contains(lower(content), 'return') THEN 'return' END) AS warnings FROM mta")
def validate_required_fields(spark, sf):
    return G.required_fields(meta(spark, sf)).select("doc_id", "idx", "warnings")


@query(f"WITH {META}, w AS (SELECT doc_id, (kind <> 'mixed' AND interface IS NULL)::INT + (kind <> 'mixed' AND name IS NULL)::INT + (kind = 'function' AND NOT contains(lower(content), 'return'))::INT AS n FROM (SELECT * REPLACE (coalesce(kind, 'mixed') AS kind) FROM mta)) SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE n = 0) AS passed, CAST(sum(n) AS BIGINT) AS n_warnings FROM w GROUP BY 1")
def validation_summary(spark, sf):
    return G.required_fields_summary(G.required_fields(meta(spark, sf)), "doc_id")


@query(f"""WITH {META}, q AS (SELECT doc_id, idx, 0 AS k, 'How do I use ' || name || '?' AS question FROM mta WHERE name IS NOT NULL UNION ALL SELECT doc_id, idx, 1, 'What is ' || interface || '.' || name || '?' FROM mta WHERE name IS NOT NULL AND interface IS NOT NULL)
SELECT doc_id, n AS place, question FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS n FROM q) WHERE n <= 10""")
def suggest_queries(spark, sf):
    return G.suggest_queries(meta(spark, sf))


@query(f"WITH {NODES} SELECT chunk_id, md5(to_json) AS node FROM (SELECT chunk_id, '{{' || coalesce('\"parent_id\":\"' || parent_id || '\",', '') || '\"kind\":\"' || kind || '\",\"level\":' || level || ',\"name\":\"' || name || '\",\"content\":\"' || content || '\"}}' AS to_json FROM nod)")
def graph_to_json(spark, sf):
    return G.graph_to_json(nodes(spark, sf)).select("chunk_id", F.md5(F.col("node").cast("binary")).alias("node"))


def _texts(compact: bool, signatures: bool, descriptions: bool) -> str:
    """The text of each node, from the parts that it was made of."""
    label = lambda long, short: short if compact else long
    told = lambda before, c: f" || '{before}' || {c}" if descriptions else ""
    some = f" || CASE WHEN k % 2 = 0 THEN ': ' || p_type ELSE '' END || chr(10) || '  b: the kind'" if descriptions else ""
    colon = "" if compact else " || ':'"
    method = f"m || '(' || a || ': long, b: ' || t || ') -> ' || r" if signatures else "m"
    return f"""SELECT md5(doc_id || '/' || i) AS chunk_id, '{label("Interface ", "I: ")}' || i{colon} || chr(10) || '{label("Methods", "M")}: ' || string_agg(m, ', ' ORDER BY m) || coalesce(chr(10) || '{label("Properties", "P")}: ' || string_agg('Prop' || k, ', ' ORDER BY 'Prop' || k) FILTER (WHERE itf IS NOT NULL), '') AS text FROM pt GROUP BY doc_id, i
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m), {method}{some} FROM pt
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m || '/' || a), a || ': long' FROM pt
UNION ALL SELECT md5(doc_id || '/' || i || '/' || m || '/b'), 'b: ' || t{told(" - ", "'the kind'")} FROM pt
UNION ALL SELECT md5(doc_id || '/' || t), '{label("Enum ", "E: ")}' || t || '{label(": ", " - ")}' || string_agg('v' || p_size, ', ' ORDER BY 'v' || p_size) FROM em GROUP BY doc_id, t
UNION ALL SELECT md5(doc_id || '/' || t || '/v' || p_size), 'v' || p_size || ' = ' || p_size FROM em
UNION ALL SELECT md5(doc_id || '/property/' || coalesce(itf, '') || '/Prop' || k), 'Prop' || k || ': long [' || CASE WHEN k % 3 = 0 THEN 'read' ELSE 'public' END || ']'{told(" - ", "p_name")} FROM pt
UNION ALL SELECT md5(doc_id || '/paragraph/' || k), p_name FROM pt
UNION ALL SELECT md5(doc_id || '/table/' || k), p_type FROM pt
UNION ALL SELECT md5(doc_id || '/error/err' || k), 'err' || k || ' (' || -p_size || ')'{told(": ", "p_type")} FROM pt
UNION ALL SELECT md5(doc_id || '/record/R' || p_size), '{label("Record ", "R: ")}R' || p_size{colon} || chr(10) || '{label("Fields", "F")}: ' || string_agg('f' || k, ', ' ORDER BY 'f' || k) FROM pt GROUP BY doc_id, p_size
UNION ALL SELECT md5(doc_id || '/record/R' || p_size || '/f' || k), 'f' || k || ': long' FROM pt"""


@query(f"WITH {NODES} {_texts(False, True, True)}")
def format_node_text(spark, sf):
    return G.format_node_text(metadata(spark, sf))


@query(f"WITH {NODES} {_texts(True, True, True)}")
def format_node_text_compact(spark, sf):
    return G.format_node_text(metadata(spark, sf), "compact")


@query(f"WITH {NODES} {_texts(False, False, False)}")
def format_node_text_bare(spark, sf):
    """Without signatures and descriptions."""
    return G.format_node_text(metadata(spark, sf), signatures=False, descriptions=False)


@query(f"WITH {NODES} SELECT chunk_id, kind || ': ' || name || ': ' || content AS text FROM nod")
def format_node_meta(spark, sf):
    return G.format_node_meta(nodes(spark, sf))


@query(f"WITH {NODES}, {FOUND} SELECT query_id, string_agg('[Source ' || rank || ']: ' || CASE kind WHEN 'interface' THEN '[Interface: ' || name || '] ' WHEN 'method' THEN '[Function: ' || name || '] ' ELSE '' END || content, chr(10) ORDER BY rank) AS sources FROM fnd JOIN nod USING (chunk_id) WHERE rank <= 10 GROUP BY 1")
def build_api_prompts(spark, sf):
    n = nodes(spark, sf)
    return G.build_api_prompts(found(spark, sf, n), n)


def _block(src: str, title: str) -> str:
    return f"SELECT doc_id, chunk_index, chr(10) || '{title}:' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS t FROM (SELECT s.doc_id, s.chunk_index, CASE WHEN s.target IS NULL THEN '- ' || s.uri || ' (external)' ELSE '- ' || coalesce(left(x.content, 150), '[deleted chunk]') || ' (internal)' END AS line, row_number() OVER (PARTITION BY s.doc_id, s.chunk_index ORDER BY s.target NULLS LAST, s.uri) AS place FROM {src} s LEFT JOIN ck x ON x.doc_id = s.doc_id AND x.chunk_index = s.target) WHERE place <= 3 GROUP BY 1, 2"


@query(f"""WITH {LINKS}, ck AS (SELECT c.doc_id, c.chunk_index, text AS content FROM chk c JOIN cv ON cv.doc_id = c.doc_id AND cv.page = c.page WHERE c.chunk_index % 5 <> 4), fw AS (SELECT DISTINCT doc_id, chunk_index, target, CASE WHEN target IS NULL THEN uri END AS uri FROM lo WHERE target IS NOT NULL OR uri IS NOT NULL), bk AS (SELECT DISTINCT doc_id, target AS chunk_index, chunk_index AS target, NULL AS uri FROM lo WHERE target IS NOT NULL),
b1 AS ({_block('fw', 'Links To')}), b2 AS ({_block('bk', 'Referenced From')}) SELECT ck.doc_id, ck.chunk_index, content || coalesce(b1.t, '') || coalesce(b2.t, '') AS text FROM ck LEFT JOIN b1 ON b1.doc_id = ck.doc_id AND b1.chunk_index = ck.chunk_index LEFT JOIN b2 ON b2.doc_id = ck.doc_id AND b2.chunk_index = ck.chunk_index""")
def augment_text_with_links(spark, sf):
    l, chunks = links(spark, sf)
    text = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("content"))
    forward, back = G.resolve_links(l, chunks)
    full = chunks.join(text.hint("merge"), ["doc_id", "page"]).where("chunk_index % 5 <> 4")
    return G.augment_text_with_links(full, forward, back)

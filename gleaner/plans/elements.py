"""Queries over code elements made from parts: 50 documents, positions by part number."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import elements as E
from gleaner.plans.registry import query
from gleaner.session import table

#: The same expressions in both dialects.
CONTENT = """CASE p_partkey % 7 WHEN 0 THEN 'long GetP' || p_partkey || '([in] long size, [out] Map<int,string> name)' WHEN 1 THEN 'public enum EP' || p_partkey || ' { A' || p_size || ' = 1, B = ' || p_size || ', C }'
WHEN 2 THEN '[propget] HRESULT get_P' || p_partkey || '(long* v)' WHEN 3 THEN 'record RP' || p_partkey || '(int a, string b)' WHEN 4 THEN 'interface IP' || p_partkey WHEN 5 THEN 'public enum EP' || p_partkey || 'Error { err' || p_size || ' = 1, errB = 2 }' ELSE p_name || ' is made of ' || p_type || ' => P' || p_partkey END"""
COLUMNS = ["p_partkey % 50 AS doc_id", "p_partkey AS pos", f"{CONTENT} AS content", "p_partkey * 7 % 22 AS font_size", "CASE p_partkey % 5 WHEN 0 THEN 'Courier New' WHEN 1 THEN 'Consolas' WHEN 2 THEN 'Arial' ELSE 'Times' END AS font_name"]
ELE = f"b AS (SELECT {", ".join(COLUMNS)} FROM part), ele AS (SELECT *, CASE WHEN font_size > 14 AND length(content) < 200 THEN 'HEADING' WHEN regexp_matches(font_name, '(?i)monospace|courier|consolas') THEN 'CODE_BLOCK' ELSE 'PARAGRAPH' END AS type FROM b)"
T = E.TYPES
CLS = f"cls AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(content, '{p}') THEN '{n}'" for n, p in E.CLASSES)} END AS kind FROM ele)"


def elements(spark, sf) -> DataFrame:
    e = table(spark, sf, "part").selectExpr(*COLUMNS)
    return e.withColumn("type", E.infer_element_type(F.col("font_size"), F.col("font_name"), F.col("content")))


def classified(spark, sf) -> DataFrame:
    return elements(spark, sf).withColumn("kind", E.classify_code_element("content"))


@query(f"WITH {ELE} SELECT doc_id, pos, type FROM ele")
def infer_element_type(spark, sf):
    return elements(spark, sf).select("doc_id", "pos", "type")


SIG = f"sig AS (SELECT doc_id, pos, 'signature' AS kind, CASE {' '.join(f"WHEN regexp_matches(content, '{p}') THEN {n}" for p, n in E.SIGNATURES)} END AS priority FROM ele)"
BLK = """blk AS (SELECT doc_id, pos, CASE WHEN type = 'CODE_BLOCK' THEN 'block_start' WHEN b = 'CODE_BLOCK' THEN 'block_end' END AS kind FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM ele))"""


@query(f"WITH {ELE}, {SIG} SELECT doc_id, pos, CAST(priority AS BIGINT) AS priority FROM sig WHERE priority IS NOT NULL")
def signature_boundaries(spark, sf):
    return E.signature_boundaries(elements(spark, sf)).select("doc_id", "pos", F.col("priority").cast("long").alias("priority"))


@query(f"WITH {ELE}, {BLK} SELECT * FROM blk WHERE kind IS NOT NULL")
def block_boundaries(spark, sf):
    return E.block_boundaries(elements(spark, sf)).select("doc_id", "pos", "kind")


@query(f"WITH {ELE}, {SIG}, {BLK}, u AS (SELECT doc_id, pos, kind, priority FROM sig WHERE priority IS NOT NULL UNION ALL SELECT doc_id, pos, kind, CASE kind WHEN 'block_start' THEN 70 ELSE 50 END FROM blk WHERE kind IS NOT NULL) SELECT doc_id, pos, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY priority DESC, kind) AS n FROM u) WHERE n = 1")
def detect_boundaries(spark, sf):
    return E.detect_boundaries(elements(spark, sf), [E.signature_boundaries, E.block_boundaries]).select("doc_id", "pos", "kind")


@query(f"WITH {ELE}, {CLS} SELECT pos, kind FROM cls")
def classify_code_element(spark, sf):
    return classified(spark, sf).select("pos", "kind")


@query(rf"""WITH {ELE}, {CLS} SELECT pos, nullif(CASE WHEN kind IN ('enum', 'error_code') THEN regexp_extract(content, 'enum\s+(E\w+)', 1) WHEN kind = 'record' THEN regexp_extract(content, '(?:record|struct)\s+(R?\w+)', 1) WHEN kind = 'method' THEN regexp_extract(content, '\b({T})\s+(\w+)\s*\(', 2)
WHEN kind = 'property' THEN regexp_extract(content, '\b(get_|set_)(\w+)', 2) END, '') AS name, nullif(CASE WHEN kind = 'method' THEN regexp_extract(content, '\b({T})\s+\w+\s*\(', 1) WHEN kind = 'property' THEN regexp_extract(content, '\b({T})\s+(get_|set_|\w+\s*\{{)', 1) END, '') AS return_type FROM cls""")
def code_element_names(spark, sf):
    k = F.col("kind")
    return classified(spark, sf).select("pos", E.code_element_name("content", k).alias("name"), E.code_return_type("content", k).alias("return_type"))


@query(rf"WITH {ELE} SELECT pos, last_value(nullif(regexp_extract(content, '^\s*(?:interface|coclass)\s+(\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interface FROM ele")
def interface_scope(spark, sf):
    return E.interface_scope(elements(spark, sf)).select("pos", "interface")


@query(rf"""WITH {ELE}, {CLS}, p AS (SELECT pos, list_filter(list_transform(string_split(regexp_extract(content, '\{{([^}}]*)\}}', 1), ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^\w+(\s*=.*)?$')) AS l FROM cls WHERE kind IN ('enum', 'error_code')), x AS (SELECT pos, unnest(range(0, len(l))) AS i, l FROM p)
SELECT pos, i, regexp_extract(l[i + 1], '^(\w+)', 1) AS name, trim(regexp_extract(l[i + 1], '=\s*(.*)$', 1)) AS value FROM x""")
def enum_members(spark, sf):
    rows = classified(spark, sf).where("kind in ('enum', 'error_code')").select("pos", F.posexplode(E.enum_members("content")).alias("i", "m"))
    return rows.select("pos", F.col("i").cast("long").alias("i"), "m.name", "m.value")


@query(rf"WITH {ELE}, {CLS} SELECT pos, array_to_string(regexp_extract_all(content, 'err\w+'), ',') AS members FROM cls WHERE kind = 'error_code'")
def error_members(spark, sf):
    return classified(spark, sf).where("kind = 'error_code'").select("pos", F.array_join(E.error_members("content"), ",").alias("members"))


@query(rf"""WITH {ELE}, {CLS}, n AS (SELECT pos, content, coalesce(CASE WHEN kind IN ('enum', 'error_code') THEN regexp_extract(content, 'enum\s+(E\w+)', 1) WHEN kind = 'record' THEN regexp_extract(content, '(?:record|struct)\s+(R?\w+)', 1) WHEN kind = 'method' THEN regexp_extract(content, '\b({T})\s+(\w+)\s*\(', 2) WHEN kind = 'property' THEN coalesce(nullif(regexp_extract(content, '\b(get_|set_)(\w+)', 2), ''), regexp_extract(content, '\b(\w+)\s*\{{\s*(get|set)', 1)) END, '') AS name FROM cls),
k AS (SELECT pos, list_concat(list_transform(list_filter(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: length(p) > 1), lambda p: lower(p)), list_filter([{", ".join(f"'{t}'" for t in E.TERMS)}], lambda t: contains(lower(content), t))) AS l FROM n)
SELECT pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keywords FROM k""")
def name_keywords(spark, sf):
    return classified(spark, sf).select("pos", F.array_join(E.name_keywords(F.coalesce(E.code_element_name("content", F.col("kind")), F.lit("")), F.col("content")), ",").alias("keywords"))


@query(rf"""WITH {ELE}, {CLS}, bd AS (SELECT pos, list_filter(list_transform(regexp_extract_all(regexp_extract(content, '\(([^)]*)\)', 1), '(?:[^,<]|<[^>]*>)+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM cls WHERE kind = 'method'),
u AS (SELECT pos, unnest(range(0, len(l))) AS i, l FROM bd), p AS (SELECT pos, i, l[i + 1] AS p, trim(regexp_replace(l[i + 1], '\[[^\]]*\]', '', 'g')) AS q FROM u)
SELECT pos, i, CASE WHEN contains(p, '[out]') THEN 'out' ELSE 'in' END AS direction, trim(regexp_replace(q, '\S+$', '')) AS type, regexp_extract(q, '(\S+)$', 1) AS name FROM p""")
def signature_params(spark, sf):
    rows = classified(spark, sf).where("kind = 'method'").select("pos", F.posexplode(E.signature_params("content")).alias("i", "p"))
    return rows.select("pos", F.col("i").cast("long").alias("i"), "p.direction", "p.type", "p.name")


@query(rf"""WITH {ELE}, l AS (SELECT pos, list_transform(string_split(replace(content, ', ', ',' || chr(10)), chr(10)), lambda x: trim(x)) AS l FROM ele), a AS (SELECT pos, l, list_position(list_transform(l, lambda x: contains(x, '(')), TRUE) AS st FROM l),
r AS (SELECT pos, st, list_slice(l, st, len(l)) AS r FROM a), e AS (SELECT pos, st, r, list_position(list_transform(r, lambda x: regexp_matches(x, '[);{{]$')), TRUE) AS e FROM r)
SELECT pos, CASE WHEN st > 0 THEN array_to_string(list_slice(r, 1, CASE WHEN e > 0 THEN e ELSE len(r) END), ' ') END AS signature FROM e""")
def reconstruct_signature(spark, sf):
    return E.reconstruct_signature(elements(spark, sf).withColumn("content", F.regexp_replace("content", ", ", ",\n"))).select("pos", "signature")


@query(rf"""WITH {ELE}, {CLS}, p AS (SELECT pos AS element, 'size' AS name FROM cls WHERE kind = 'method' UNION ALL SELECT pos, 'name' FROM cls WHERE kind = 'method') SELECT element, name, CASE name WHEN 'size' THEN 'the size ' || element ELSE 'what to call it' END AS description FROM p""")
def param_descriptions(spark, sf):
    m = classified(spark, sf).where("kind = 'method'")
    params = m.select(F.col("pos").alias("element"), F.explode(E.signature_params("content")).alias("p")).select("element", "p.name")
    text = F.array(F.concat(F.lit("size: the size "), F.col("pos").cast("string")), F.lit(" name - what to call it"), F.lit("other: x"))
    return E.param_descriptions(m.select(F.col("pos").alias("element"), F.posexplode(text).alias("line_no", "line")), params)


@query(rf"""WITH {ELE}, {CLS}, s AS (SELECT doc_id, pos // 500 AS segment, pos, type, nullif(CASE WHEN kind IN ('enum', 'error_code') THEN regexp_extract(content, 'enum\s+(E\w+)', 1) WHEN kind = 'record' THEN regexp_extract(content, '(?:record|struct)\s+(R?\w+)', 1) WHEN kind = 'method' THEN regexp_extract(content, '\b({T})\s+(\w+)\s*\(', 2) WHEN kind = 'property' THEN regexp_extract(content, '\b(get_|set_)(\w+)', 2) END, '') AS name,
nullif(CASE WHEN kind = 'method' THEN regexp_extract(content, '\b({T})\s+\w+\s*\(', 1) END, '') AS rt, CASE WHEN kind = 'method' THEN content END AS sg, CASE WHEN pos % 3 = 0 THEN 'Part/' || pos END AS sp FROM cls) SELECT doc_id, segment, arg_max(sg, pos) FILTER (WHERE sg IS NOT NULL) AS signature, arg_max(sp, pos) FILTER (WHERE sp IS NOT NULL) AS section_path, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'mixed' END AS element_type, arg_min(name, pos) FILTER (WHERE name IS NOT NULL) AS name, arg_max(rt, pos) FILTER (WHERE rt IS NOT NULL) AS return_type, bool_or(type = 'CODE_BLOCK') AS has_code FROM s GROUP BY 1, 2""")
def segment_metadata(spark, sf):
    k = F.col("kind")
    rows = classified(spark, sf).withColumns({"segment": F.floor(F.col("pos") / 500), "name": E.code_element_name("content", k), "return_type": F.when(k == "method", E.code_return_type("content", k)), "signature": F.when(k == "method", F.col("content")), "section_path": F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Part/"), F.col("pos").cast("string")))})
    return E.segment_metadata(rows)

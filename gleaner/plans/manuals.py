"""Queries over API manuals made from parts: one manual for each brand."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import manuals as M
from gleaner.plans.registry import query
from gleaner.session import table

#: Elements of the manuals, in both dialects: a heading, a paragraph, a label and one or two tables for each part.
DOC = "CAST(substr(p_brand, 7) AS BIGINT)"
PARAGRAPH = [
    ("heading", "p_partkey % 3 = 0", 0, "CASE p_partkey % 6 WHEN 0 THEN 'IP' || p_partkey || ' Interface' ELSE 'Section about enum P' || p_partkey || '.' END", "CASE p_partkey % 6 WHEN 0 THEN 'Heading 2' ELSE 'heading' || (1 + p_partkey % 4) END", "CAST(CASE p_partkey % 6 WHEN 0 THEN 2 ELSE 1 + p_partkey % 4 END AS BIGINT)", "FALSE"),
    ("text", "TRUE", 1, "'About ' || p_name", "'Normal'", "CAST(-1 AS BIGINT)", "FALSE"),
    ("label", "p_partkey % 2 = 0", 2, "CASE p_partkey % 7 WHEN 0 THEN 'Functions' WHEN 1 THEN ' Error  codes ' WHEN 2 THEN 'Properties' WHEN 3 THEN 'Enumerated Types' WHEN 4 THEN 'Records / Structures' ELSE 'Notes' END", "'Normal'", "CAST(-1 AS BIGINT)", "TRUE"),
]
TABLES = [("p_partkey % 4 <> 3", 3), ("p_partkey % 5 = 0", 4)]
HEADERS = {
    0: ["Method", "Parameters", "Returns", "Description"],
    1: ["Name", "Type", "Access", "Remarks"],
    2: ["Value", "Description"],
    3: ["Error Code", "Summary"],
    4: ["A", "B"],
    5: ["", "RName = ("],
    6: ["enum", "EName"],
    7: ["HRESULT", "F(x)"],
    8: ["Access to names", "•"],
}
CELLS = "CASE p_partkey % 7 WHEN 0 THEN 'a = 1' WHEN 1 THEN 'x • y' WHEN 6 THEN 'Get or set x' WHEN 2 THEN 'f([in] long a)' WHEN 3 THEN 'e = -5' WHEN 4 THEN 'R = (' ELSE 'plain | text' END"


def _texts(array: str) -> str:
    return " UNION ALL ".join(f"SELECT {DOC} AS doc_id, p_partkey * 10 + {at} AS position, 'paragraph' AS kind, {text} AS text, {style} AS style_name, {level} AS heading_level, {bold} AS bold, CAST(NULL AS {array}) AS headers, CAST(NULL AS VARCHAR) AS cell FROM part WHERE {on}" for _, on, at, text, style, level, bold in PARAGRAPH)


def _headers(fmt) -> str:
    return f"CASE (p_partkey + {{k}}) % {len(HEADERS)} " + " ".join(f"WHEN {i} THEN {fmt(h)}" for i, h in HEADERS.items()) + " END"


RAW = "raw AS (" + _texts("VARCHAR[]") + "".join(f" UNION ALL SELECT {DOC}, p_partkey * 10 + {at}, 'table', NULL, NULL, NULL, NULL, {_headers(lambda h: str(h)).format(k=at)}, {CELLS} FROM part WHERE {on}" for on, at in TABLES) + ")"


def raw_elements(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    out = None
    for _, on, at, text, style, level, bold in PARAGRAPH:
        rows = part.where(on).selectExpr(f"{DOC} AS doc_id", f"p_partkey * 10 + {at} AS position", "'paragraph' AS kind", f"{text} AS text", f"{style} AS style_name", f"{level} AS heading_level", f"{bold} AS bold", "CAST(NULL AS ARRAY<STRING>) AS headers", "CAST(NULL AS STRING) AS cell")
        out = rows if out is None else out.unionByName(rows)
    for on, at in TABLES:
        heads = _headers(lambda h: "array(" + ", ".join(f"'{x}'" for x in h) + ")").format(k=at)
        rows = part.where(on).selectExpr(f"{DOC} AS doc_id", f"p_partkey * 10 + {at} AS position", "'table' AS kind", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS style_name", "CAST(NULL AS BIGINT) AS heading_level", "CAST(NULL AS BOOLEAN) AS bold", f"{heads} AS headers", f"{CELLS} AS cell")
        out = out.unionByName(rows)
    return out.withColumn("rows", F.when(F.col("cell").isNotNull(), F.array(F.array("cell", F.lit("b")))))


def _any(words) -> str:
    return f"regexp_matches(lower(array_to_string(headers, chr(10))), '{'|'.join(words)}')"


HEADER_TYPE = "CASE " + " ".join(f"WHEN {' AND '.join(_any(s) for s in sets)} THEN '{k}'" for k, sets in M.TABLE_TYPES.items()) + " ELSE 'unknown' END"
_HEADS = "coalesce(headers, [])"
_EVERY = f"list_append({_HEADS}, cell)"


def _some(cells: str, pattern: str) -> str:
    return f"len(list_filter({cells}, lambda x: regexp_matches(x, '{pattern}'))) > 0"


SIGNAL_TYPE = (
    f"CASE WHEN len({_HEADS}) > 1 AND headers[1] = '' AND contains(headers[2], '= (') THEN 'record' WHEN {_some(_HEADS, '(?i)property|access to|•')} OR {_some(_EVERY, r'(?i)get or set')} THEN 'property' "
    + rf"WHEN {_some(_EVERY, r'(?i)\(\[(in|out)\]')} OR regexp_matches(headers[1], '{M.RETURN_TYPE}') THEN 'method' WHEN lower(headers[1]) = 'enum' AND regexp_matches(cell, '\w+\s*=\s*') THEN CASE WHEN regexp_matches(cell, '=\s*[\-–]\d') THEN 'error_code' ELSE 'enum' END ELSE 'unknown' END"
)
LABEL = "CASE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.LABELS.items()) + " ELSE '' END"
LAB = f"lab AS (SELECT * FROM (SELECT *, nullif(last_value(CASE WHEN kind = 'paragraph' AND bold THEN {LABEL} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS label, sum(f) OVER (PARTITION BY doc_id ORDER BY position) AS island FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY position) = 'table' THEN 0 ELSE 1 END AS f FROM raw)) WHERE kind = 'table')"


@query(f"""WITH {RAW} SELECT doc_id, position, CAST(CASE WHEN regexp_matches(s, '^(heading|head|title|caption)[1-6]$') THEN right(s, 1)::BIGINT WHEN regexp_matches(s, '^(heading|head|title|caption)$') THEN 0 WHEN s = 'subtitle' THEN 2 ELSE -1 END AS BIGINT) AS level FROM (SELECT *, lower(regexp_replace(style_name, '[ -]', '', 'g')) AS s FROM raw WHERE kind = 'paragraph')""")
def heading_level(spark, sf):
    return raw_elements(spark, sf).where("kind = 'paragraph'").select("doc_id", "position", M.heading_level("style_name").alias("level"))


@query(f"WITH {RAW} SELECT doc_id, position, {HEADER_TYPE} AS type FROM raw WHERE kind = 'table'")
def classify_table_headers(spark, sf):
    return raw_elements(spark, sf).where("kind = 'table'").select("doc_id", "position", M.classify_table_headers("headers").alias("type"))


@query(f"WITH {RAW} SELECT doc_id, position, {SIGNAL_TYPE} AS type FROM raw WHERE kind = 'table'")
def classify_table_signals(spark, sf):
    return raw_elements(spark, sf).where("kind = 'table'").select("doc_id", "position", M.classify_table_signals("headers", "rows").alias("type"))


@query(f"WITH {RAW}, {LAB} SELECT doc_id, position, label FROM lab")
def label_from_paragraph(spark, sf):
    return M.label_from_paragraph(raw_elements(spark, sf)).select("doc_id", "position", "label")


CLASSED = f"cl AS (SELECT doc_id, position, first_value(coalesce(label, nullif({HEADER_TYPE}, 'unknown'), {SIGNAL_TYPE})) OVER (PARTITION BY doc_id, island ORDER BY position) AS table_type FROM lab)"


@query(f"WITH {RAW}, {LAB}, {CLASSED} SELECT * FROM cl")
def classify_tables(spark, sf):
    return M.classify_tables(raw_elements(spark, sf))


CTX = """hs AS (SELECT t.doc_id, t.position, h.heading_level AS l, max(h.position) AS p FROM raw t JOIN raw h ON t.kind = 'table' AND h.kind = 'paragraph' AND h.heading_level >= 0 AND h.doc_id = t.doc_id AND h.position < t.position GROUP BY 1, 2, 3),
ac AS (SELECT a.* FROM hs a WHERE NOT EXISTS (SELECT 1 FROM hs b WHERE b.doc_id = a.doc_id AND b.position = a.position AND b.l < a.l AND b.p > a.p)),
ctx AS (SELECT t.doc_id, t.position, coalesce(arg_max(r.text, ac.l), '') AS heading, count(ac.l) AS depth FROM raw t LEFT JOIN ac ON ac.doc_id = t.doc_id AND ac.position = t.position LEFT JOIN raw r ON r.doc_id = ac.doc_id AND r.position = ac.p WHERE t.kind = 'table' GROUP BY 1, 2)"""


@query(f"WITH {RAW}, {CTX} SELECT * FROM ctx")
def heading_context(spark, sf):
    return M.heading_context(raw_elements(spark, sf))


@query(f"WITH {RAW}, {LAB}, {CLASSED}, {CTX} SELECT doc_id, position, CASE WHEN regexp_matches(heading, '(?i)\\benum') THEN 'enum' WHEN regexp_matches(heading, '(?i)\\berror') THEN 'error_code' WHEN regexp_matches(heading, '(?i)\\brecord') THEN 'record' ELSE table_type END AS table_type FROM cl JOIN ctx USING (doc_id, position)")
def override_type_by_heading(spark, sf):
    e = raw_elements(spark, sf)
    rows = M.classify_tables(e).join(M.heading_context(e).hint("merge"), ["doc_id", "position"])
    return rows.select("doc_id", "position", M.override_type_by_heading("heading", F.col("table_type")).alias("table_type"))


NAMED = r"coalesce(nullif(regexp_extract({0}, '\b(I[A-Z][A-Za-z0-9]*)\b', 1), ''), nullif(regexp_replace(trim({0}), '[.:]+$', ''), ''))"


@query(f"WITH {RAW} SELECT doc_id, position, {NAMED.format('text')} AS name FROM raw WHERE heading_level >= 0")
def interface_name(spark, sf):
    return raw_elements(spark, sf).where("heading_level >= 0").select("doc_id", "position", M.interface_name("text").alias("name"))


@query(f"WITH {RAW}, {CTX} SELECT doc_id, position, {NAMED.format('heading')} AS parent FROM ctx")
def parent_interface(spark, sf):
    return M.heading_context(raw_elements(spark, sf)).select("doc_id", "position", M.interface_name("heading").alias("parent"))


@query(rf"""WITH {RAW}, n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY position) AS nx FROM raw WHERE kind = 'paragraph' AND trim(text) <> '') SELECT doc_id, regexp_extract(text, '\b(I[A-Z][A-Za-z0-9]*)\b', 1) AS name, arg_max(nx, position) AS description FROM n WHERE heading_level IN (2, 3) AND nx IS NOT NULL AND regexp_matches(text, '\b(I[A-Z][A-Za-z0-9]*)\b') GROUP BY 1, 2""")
def interface_descriptions(spark, sf):
    return M.interface_descriptions(raw_elements(spark, sf))


@query(f"WITH {RAW}, {CTX} SELECT r.doc_id, r.position, '| ' || replace(cell, '|', '\\|') || ' | b |' AS content FROM raw r JOIN ctx ON ctx.doc_id = r.doc_id AND ctx.position = r.position WHERE heading <> ''")
def render_generic_table(spark, sf):
    e = raw_elements(spark, sf)
    parents = M.heading_context(e).where("heading <> ''")
    return e.where("kind = 'table'").join(parents.hint("merge"), ["doc_id", "position"]).select("doc_id", "position", M.render_generic_table("rows").alias("content"))


# -- table rows: a signature row and up to two continuation rows for each part -------------------

ROWS = [
    ("TRUE", "p_partkey * 4", "CASE p_partkey % 9 WHEN 8 THEN '' ELSE 'long' END", "'GetP' || p_partkey || '([in] long a' || p_size || ', [out] BSTR* b, c)'", "'Gets ' || p_name"),
    ("p_size % 3 >= 1", "p_partkey * 4 + 1", "''", "'a' || p_size || ' : long [optional] = ' || p_size", "'more'"),
    ("p_size % 3 = 2", "p_partkey * 4 + 2", "' '", "'b : BSTR'", "''"),
]
API = "api AS (" + " UNION ALL ".join(f"SELECT p_partkey % 40 AS table_id, {i} AS row_idx, {a} AS c0, {b} AS c1, {c} AS c2 FROM part WHERE {on}" for on, i, a, b, c in ROWS) + ")"
CODES = [("p_partkey % 3 = 0", "p_partkey", "''", "CASE p_partkey % 4 WHEN 0 THEN '{' ELSE 'E_P' || p_partkey || ' = ' || CASE p_partkey % 5 WHEN 0 THEN '0x8007' || p_size || ',' WHEN 1 THEN '-' || p_size WHEN 2 THEN 'S_OK' ELSE '' || p_size END END", "' ' || p_name"), ("p_partkey % 3 = 1", "p_partkey", "''", "'E_BARE'", "''")]
COD = "cod AS (" + " UNION ALL ".join(f"SELECT p_partkey % 40 AS table_id, {i} AS row_idx, {a} AS c0, {b} AS c1, {c} AS c2 FROM part WHERE {on}" for on, i, a, b, c in CODES) + ")"


def _rows(spark, sf, parts) -> DataFrame:
    part, out = table(spark, sf, "part"), None
    for on, i, a, b, c in parts:
        rows = part.where(on).selectExpr("p_partkey % 40 AS table_id", f"{i} AS row_idx", f"{a} AS c0", f"{b} AS c1", f"{c} AS c2")
        out = rows if out is None else out.unionByName(rows)
    return out


def _glued(c: str) -> str:
    return f"coalesce(string_agg({c}, chr(10) ORDER BY row_idx) FILTER (WHERE trim({c}) <> ''), '') AS {c}"


MERGED = f"mg AS (SELECT table_id, CAST(island AS BIGINT) AS island, {_glued('c0')}, {_glued('c1')}, {_glued('c2')} FROM (SELECT *, sum(CASE WHEN trim(c0) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_idx) AS island FROM api) WHERE island > 0 GROUP BY 1, 2)"


@query(f"WITH {API}, {MERGED} SELECT * FROM mg")
def merge_continuation_rows(spark, sf):
    return M.merge_continuation_rows(_rows(spark, sf, ROWS))


# a signature, some of several lines or an alias; notes on a parameter and on the function; a row that says nothing; an empty row and what it cuts off
METHODS = [
    ("TRUE", "p_partkey * 8", "' long '", "CASE WHEN p_partkey % 11 = 0 THEN 'Old_vb(Visual Basic compatible function of Get' || p_partkey || ')' WHEN p_partkey % 13 = 0 THEN '' ELSE 'GetP' || p_partkey || ' ([in] long a' || p_size || ', BSTR* b)' || CASE WHEN p_partkey % 7 = 0 THEN chr(10) || 'a' || p_size || chr(10) || 'second line' ELSE '' END END", "p_name || CASE WHEN p_partkey % 7 = 0 THEN chr(10) || 'its size' ELSE '' END"),
    ("p_size % 3 >= 1", "p_partkey * 8 + 1", "''", "'a' || p_size", "'the size'"),
    ("p_size % 3 = 2", "p_partkey * 8 + 2", "' '", "' More detail'", "''"),
    ("p_partkey % 4 = 0", "p_partkey * 8 + 3", "''", "''", "'says nothing'"),
    ("p_partkey % 5 = 0", "p_partkey * 8 + 4", "''", "' '", "''"),
    ("p_partkey % 5 = 0", "p_partkey * 8 + 5", "''", "'cut off'", "'too'"),
]


@query("""WITH p AS (SELECT *, p_partkey % 11 = 0 AS alias, p_partkey % 11 <> 0 AND p_partkey % 13 = 0 AS bare, p_partkey % 7 = 0 AS lines, p_size % 3 >= 1 AS sized, p_size % 3 = 2 AS more FROM part)
SELECT p_partkey % 40 AS table_id, p_partkey * 8 AS position, 'long' AS return_type, CASE WHEN alias THEN 'Old_vb' WHEN bare THEN 'unnamed' ELSE 'GetP' || p_partkey END AS name,
CASE WHEN alias OR bare THEN '' ELSE 'a' || p_size || '=' || CASE WHEN lines THEN 'its size' WHEN sized THEN 'the size' ELSE '' END || ',b=' END AS params,
CASE WHEN alias THEN 'VB-compatible alias for Get' || p_partkey ELSE p_name || CASE WHEN lines AND bare THEN ' its size' WHEN lines THEN ' second line' ELSE '' END END || CASE WHEN sized AND (alias OR bare) THEN ' a' || p_size || ' the size' ELSE '' END || CASE WHEN more THEN ' More detail' ELSE '' END AS description FROM p""")
def method_rows_to_functions(spark, sf):
    f = M.method_functions(_rows(spark, sf, METHODS).where("c1 is not null"))
    return f.select("table_id", "position", "return_type", "name", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["description"])), ",").alias("params"), "description")


@query(r"WITH p AS (SELECT p_partkey, unnest(range(0, 3)) AS i, ['a' || p_size, 'b', 'c'] AS n FROM part) SELECT p_partkey, i, n[i + 1] AS name, CASE i WHEN 0 THEN 'long' WHEN 1 THEN 'BSTR*' ELSE 'unknown' END AS type, i = 1 AS optional FROM p")
def parse_inline_params(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "'[in] long a' || p_size || ', [out] BSTR* b, c,' AS s")
    return rows.select("p_partkey", F.posexplode(M.parse_inline_params("s")).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), "p.name", "p.type", "p.optional")


@query("WITH p AS (SELECT p_partkey, p_size, unnest(range(0, 2)) AS i FROM part) SELECT p_partkey, i, CASE i WHEN 0 THEN 'a' || p_size ELSE 'b' END AS name, CASE i WHEN 0 THEN 'long' ELSE 'unknown' END AS type, i = 0 AS optional, CASE i WHEN 0 THEN p_size::VARCHAR END AS default_value FROM p")
def parse_param_lines(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit(" : long [optional] = "), F.col("p_size").cast("string"), F.lit("\n\n b")).alias("s"))
    return rows.select("p_partkey", F.posexplode(M.parse_param_lines("s")).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), "p.name", "p.type", "p.optional", "p.default_value")


PROPERTY = "CASE p_partkey % 4 WHEN 0 THEN 'Name' || p_size || ' • the ' || p_name WHEN 1 THEN 'Item [long i] of ' || p_name WHEN 2 THEN 'the maxSize of ' || p_name ELSE p_name END"


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Name' || p_size WHEN 1 THEN 'Item' WHEN 2 THEN 'maxSize' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN 'of ' || p_name WHEN 2 THEN 'the of ' || p_name ELSE '' END AS description FROM part")
def property_rows(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{PROPERTY} AS s").select("p_partkey", M.property_name("s").alias("p")).select("p_partkey", "p.name", "p.description")


VALUE = "CASE p_partkey % 5 WHEN 0 THEN '0x' || p_size WHEN 1 THEN '-' || p_size WHEN 2 THEN ' S_' || p_size WHEN 3 THEN '' ELSE '0xZZ' END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ('0x' || p_size)::BIGINT WHEN 1 THEN -p_size::BIGINT END AS value_int, CASE p_partkey % 5 WHEN 2 THEN 'S_' || p_size WHEN 4 THEN '0xZZ' END AS value_str FROM part")
def parse_code_value(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{VALUE} AS s").select("p_partkey", M.parse_code_value("s").alias("v")).select("p_partkey", "v.value_int", "v.value_str")


@query(r"""WITH """ + COD + r""", f AS (SELECT *, regexp_extract(trim(c1), '^(\w+)\s*=\s*(.+?)(?:,\s*)?$', 1) AS n, regexp_extract(trim(c1), '^(\w+)\s*=\s*(.+?)(?:,\s*)?$', 2) AS v FROM cod WHERE trim(c1) NOT IN ('', '{', '}')), g AS (SELECT *, CASE WHEN n <> '' THEN trim(v) ELSE trim(c1) END AS r FROM f)
SELECT table_id, row_idx, CASE WHEN n <> '' THEN n ELSE trim(c1) END AS name, CASE WHEN regexp_matches(r, '^0[xX][0-9a-fA-F]+$') OR regexp_matches(r, '^[+-]?[0-9]+$') THEN r::BIGINT END AS value_int, CASE WHEN NOT regexp_matches(r, '^0[xX][0-9a-fA-F]+$') AND NOT regexp_matches(r, '^[+-]?[0-9]+$') THEN r END AS value_str, trim(c2) AS description FROM g""")
def error_code_rows(spark, sf):
    return M.code_rows(_rows(spark, sf, CODES))


@query("""WITH f AS (SELECT p_partkey % 8 AS doc_id, CASE WHEN p_partkey % 6 <> 5 THEN 'I' || (p_partkey % 6) ELSE 'Unknown' END AS interface, p_partkey AS position, p_type AS heading, CASE WHEN p_partkey % 3 = 0 THEN 'properties' ELSE 'functions' END AS kind, 'N' || p_size AS name FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, interface, kind, name ORDER BY position) AS n FROM f)
SELECT doc_id, interface, coalesce(string_agg(name, ',' ORDER BY position) FILTER (WHERE n = 1 AND kind = 'functions'), '') AS functions, coalesce(string_agg(name, ',' ORDER BY position) FILTER (WHERE n = 1 AND kind = 'properties'), '') AS properties,
CASE WHEN doc_id % 2 = 0 THEN 'About ' || interface ELSE arg_min(heading, position) END AS description FROM k GROUP BY 1, 2""")
def assemble_interfaces(spark, sf):
    """Every third name is a property's; interfaces of every second document have a description."""
    f = table(spark, sf, "part").selectExpr("p_partkey % 8 AS doc_id", "CASE WHEN p_partkey % 6 <> 5 THEN 'I' || (p_partkey % 6) END AS interface", "p_partkey AS position", "p_type AS heading", "'N' || p_size AS name")
    described = f.select("doc_id", F.coalesce("interface", F.lit("Unknown")).alias("interface")).where("doc_id % 2 = 0").distinct().withColumn("description", F.concat(F.lit("About "), F.col("interface")))
    return M.assemble_interfaces(f.where("position % 3 <> 0"), f.where("position % 3 = 0"), described)


GROUPS = [
    ("p_partkey % 10 = 0 AND p_partkey % 30 <> 0", "p_partkey", "''", "'E' || p_partkey || ' {'", "''"),
    ("p_partkey % 10 IN (1, 2, 3)", "p_partkey", "'int'", "'v' || p_partkey || ' = ' || p_size || ','", "p_type"),
    ("p_partkey % 10 = 4", "p_partkey", "'int'", "'plain' || p_partkey", "''"),
    ("p_partkey % 10 = 5", "p_partkey", "''", "'}'", "''"),
]


def _grouped(parts: list) -> str:
    return "grp AS (" + " UNION ALL ".join(f"SELECT p_partkey // 10 AS table_id, {i} AS row_idx, {a} AS c0, {b} AS c1, {c} AS c2 FROM part WHERE {on}" for on, i, a, b, c in parts) + ")"


def _group_rows(spark, sf, parts) -> DataFrame:
    return _rows(spark, sf, parts).withColumn("table_id", F.floor(F.col("row_idx") / 10))


@query(f"WITH {_grouped(GROUPS)} SELECT table_id, row_idx, CASE WHEN table_id % 3 = 0 THEN 'UnknownEnum' ELSE 'E' || (table_id * 10) END AS enum_name, CASE row_idx % 10 WHEN 4 THEN c1 ELSE 'v' || row_idx END AS name, CASE row_idx % 10 WHEN 4 THEN NULL ELSE p_size::BIGINT END AS value_int, CAST(NULL AS VARCHAR) AS value_str, c2 AS description FROM grp JOIN part ON p_partkey = row_idx WHERE row_idx % 10 BETWEEN 1 AND 4")
def enum_rows(spark, sf):
    return M.enum_rows(_group_rows(spark, sf, GROUPS))


RECORDS = [(on, i, a, b.replace(" {", " = (").replace("}", ")").replace(" || ' = ' || p_size || ','", " || ','"), c) for on, i, a, b, c in GROUPS]


@query(f"WITH {_grouped(RECORDS)} SELECT table_id, row_idx, CASE WHEN table_id % 3 = 0 THEN 'UnknownRecord' ELSE 'E' || (table_id * 10) END AS record_name, 'int' AS type, CASE row_idx % 10 WHEN 4 THEN 'plain' ELSE 'v' END || row_idx AS name FROM grp WHERE row_idx % 10 BETWEEN 1 AND 4")
def record_rows(spark, sf):
    return M.record_rows(_group_rows(spark, sf, RECORDS))


@query(rf"""WITH {RAW}, n AS (SELECT *, sum(CASE WHEN heading_level >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS island FROM raw WHERE kind = 'paragraph' AND trim(text) <> ''), m AS (SELECT *, first_value(CASE WHEN heading_level IN (2, 3) THEN regexp_extract(text, '\b(I[A-Z][A-Za-z0-9]*)\b', 1) END) OVER w AS name, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY doc_id, island ORDER BY position))
SELECT doc_id, CAST(island AS BIGINT) AS island, name, string_agg(text, chr(10) ORDER BY position) AS paragraphs FROM m WHERE k > 2 AND name <> '' GROUP BY 1, 2, 3""")
def interface_paragraphs(spark, sf):
    return M.interface_paragraphs(raw_elements(spark, sf))

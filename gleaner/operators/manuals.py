"""API manuals: raw elements (paragraphs and tables in order) to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import col, strip

# What table headers say, by meaning; a header counts if it contains one of them.
METHOD = ("method", "function", "procedure")
PARAMETER = ("parameter", "param", "argument", "arg")
RETURN = ("return", "retval", "ret value")
DESCRIPTION = ("description", "desc", "remarks", "summary", "comment")
NAME = ("name", "property", "member", "identifier")
TYPE = ("type", "datatype")
ACCESS = ("access",)
VALUE = ("value", "constant")
CODE = ("code", "error", "hr", "hresult")
# Which meanings make a table of a type, the first that fits counts.
TABLE_TYPES = {"method": (METHOD, PARAMETER, RETURN, DESCRIPTION), "property": (NAME, TYPE, ACCESS, DESCRIPTION), "enum": (VALUE, DESCRIPTION), "error_code": (CODE, DESCRIPTION)}
# Bold labels in front of tables.
LABELS = {"functions": "method", "properties": "property", "enumerated types": "enum", "error codes": "error_code", "records / structures": "record"}
# What a first header that is a return type looks like.
RETURN_TYPE = r"^(void|long|unsigned long|double|float|int|bool|BSTR|SAFEARRAY|HRESULT|VARIANT|BOOL|DWORD|UINT|LONG|[A-Z][A-Za-z]*\*)$"


def heading_level(style: Column | str) -> Column:
    """-1: no heading; 0: a bare heading or title style; 1 to 6; subtitle: 2."""
    s = F.lower(F.regexp_replace(col(style), r"[ \-]", ""))
    n = F.regexp_extract(s, r"^(?:heading|head|title|caption)([1-6])$", 1)
    return F.when(n != "", n.try_cast("long")).when(s.rlike(r"^(heading|head|title|caption)$"), 0).when(s == "subtitle", 2).otherwise(-1).cast("long")


def classify_table_headers(headers: Column | str) -> Column:
    low = F.array_join(F.transform(col(headers), lambda h: F.lower(strip(h))), "\n")
    has = lambda words: low.rlike("|".join(words))
    out = None
    for kind, sets in TABLE_TYPES.items():
        on = has(sets[0])
        for s in sets[1:]:
            on = on & has(s)
        out = F.when(on, kind) if out is None else out.when(on, kind)
    return out.otherwise("unknown")


def classify_table_signals(headers: Column | str, rows: Column | str) -> Column:
    """What headers and cells look like where the headers' words say nothing; from the narrowest sign to the broadest."""
    heads, body = F.coalesce(col(headers), F.array().cast("array<string>")), F.coalesce(F.flatten(col(rows)), F.array().cast("array<string>"))
    first, second = (F.coalesce(strip(F.get(heads, F.lit(i))), F.lit("")) for i in range(2))
    any_of = lambda cells, p: F.exists(cells, lambda c: c.rlike(p))
    every = F.concat(heads, body)
    record = (F.size(heads) > 1) & (first == "") & (second.contains("= (") | second.endswith("=("))
    prop = any_of(heads, r"(?i)property|access to|•") | any_of(every, r"(?i)get or set")
    method = any_of(every, r"(?i)\(\[(in|out)\]") | first.rlike(RETURN_TYPE)
    assigned = (F.lower(first) == "enum") & any_of(body, r"\w+\s*=\s*")
    return F.when(record, "record").when(prop, "property").when(method, "method").when(assigned & any_of(body, r"=\s*[\-–]\d"), "error_code").when(assigned, "enum").otherwise("unknown")


def label_from_paragraph(elements: DataFrame) -> DataFrame:
    """Tables with the type that the nearest bold paragraph before them names; another bold text names none."""
    norm = F.lower(strip(F.regexp_replace("text", r"\s+", " ")))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), norm)
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when((F.col("kind") == "paragraph") & F.col("bold"), F.struct(label.alias("l"))), ignorenulls=True).over(w)
    return elements.withColumn("label", last.getField("l")).where("kind = 'table'")


def classify_tables(elements: DataFrame) -> DataFrame:
    """Label, else the type of the table directly before, else headers, else cells: doc_id, position, table_type."""
    w = Window.partitionBy("doc_id").orderBy("position")
    islands = elements.withColumn("_f", F.when(F.lag("kind").over(w) == "table", 0).otherwise(1)).withColumn("island", F.sum("_f").over(w))
    tables = label_from_paragraph(islands)
    own = F.coalesce("label", F.nullif(classify_table_headers("headers"), F.lit("unknown")), classify_table_signals("headers", "rows"))
    first = F.first(own).over(Window.partitionBy("doc_id", "island").orderBy("position"))
    return tables.withColumn("table_type", first).select("doc_id", "position", "table_type")


def heading_context(elements: DataFrame, levels: int = 6) -> DataFrame:
    """Tables with the deepest active heading and how many are active.

    A heading is active until one of the same or a higher rank follows: for each level the last one,
    if no heading of a smaller level came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = elements
    for n in range(levels + 1):
        here = (F.col("kind") == "paragraph") & (F.col("heading_level") == n)
        rows = rows.withColumn(f"_h{n}", F.last(F.when(here, F.struct("position", "text")), ignorenulls=True).over(w))
    active = []
    for n in range(levels + 1):
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"_h{m}.position"), F.lit(-1)) for m in range(n))) if n else F.lit(-1)
        active.append(F.when(F.col(f"_h{n}.position") > above, F.col(f"_h{n}.text")))
    rows = rows.withColumn("_active", F.array_compact(F.array(*active)))
    return rows.where("kind = 'table'").select("doc_id", "position", F.coalesce(F.try_element_at("_active", F.lit(-1)), F.lit("")).alias("heading"), F.size("_active").cast("long").alias("depth"))


def interface_name(heading: Column | str, loose: bool = False) -> Column:
    """The I-name in a heading, else the heading without dots and colons at its end.

    loose: anywhere and in any case, as older manuals need it.
    """
    pattern = r"(?i)(?:interface\s*:?\s*)?(i[a-z][a-z0-9]*)" if loose else r"\b(I[A-Z][A-Za-z0-9]*)\b"
    got = F.regexp_extract(col(heading), pattern, 1)
    rest = F.regexp_replace(strip(heading), r"[.:]+$", "")
    return F.when(got != "", got).when(rest != "", rest)


def interface_descriptions(elements: DataFrame) -> DataFrame:
    """The next paragraph after an interface's heading (level 2 or 3); the last one of a name wins: doc_id, name, description."""
    full = elements.where((F.col("kind") == "paragraph") & (strip("text") != ""))
    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("position"))
    name = F.regexp_extract("text", r"\b(I[A-Z][A-Za-z0-9]*)\b", 1)
    rows = full.withColumn("next", nxt).where(F.col("heading_level").isin(2, 3) & (name != "") & F.col("next").isNotNull())
    return rows.groupBy("doc_id", name.alias("name")).agg(F.max_by("next", "position").alias("description"))


def override_type_by_heading(heading: Column | str, table_type: Column, patterns: dict[str, str | list[str]] | None = None) -> Column:
    """A heading that fits a pattern decides the type; a pattern may be one expression or a list."""
    out = table_type
    for kind, p in reversed((patterns or {"enum": r"(?i)\benum", "error_code": r"(?i)\berror", "record": r"(?i)\brecord"}).items()):
        out = F.when(col(heading).rlike("|".join(p) if isinstance(p, list) else p), kind).otherwise(out)
    return out


def merge_continuation_rows(rows: DataFrame) -> DataFrame:
    """Rows whose first cell is empty join the row before, cell by cell with line breaks; leading ones are dropped."""
    w = Window.partitionBy("table_id").orderBy("row_idx")
    marked = rows.withColumn("island", F.sum(F.when(strip("c0") != "", 1).otherwise(0)).over(w)).where("island > 0")
    cell = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(strip(c) != "", F.struct("row_idx", F.col(c).alias("v"))))), lambda s: s.v), "\n").alias(c)
    return marked.groupBy("table_id", "island").agg(cell("c0"), cell("c1"), cell("c2"))


def parse_inline_params(params: Column | str) -> Column:
    """array<struct<name, type, optional>> of a signature's parameters, split on commas."""
    parts = F.filter(F.transform(F.split(col(params), ","), strip), lambda p: p != "")
    bare = lambda p: strip(F.regexp_replace(p, r"^\[[^\]]*\]", ""))
    kind = lambda p: strip(F.regexp_replace(bare(p), r"\S+$", ""))
    return F.transform(
        F.filter(parts, lambda p: bare(p) != ""),
        lambda p: F.struct(F.regexp_extract(bare(p), r"(\S+)$", 1).alias("name"), F.when(kind(p) == "", "unknown").otherwise(kind(p)).alias("type"), p.rlike(r"(?i)^\[[^\]]*(out|optional)").alias("optional")),
    )


def parse_param_lines(cell: Column | str) -> Column:
    """array<struct<name, type, optional, default_value>> of `name : type [optional] = default` lines."""
    lines = F.filter(F.transform(F.split(col(cell), "\n"), strip), lambda x: x != "")
    blank = lambda c: F.when(c != "", c)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\w+)", 1).alias("name"),
            F.coalesce(blank(strip(F.regexp_extract(x, r":\s*([^\[=]+)", 1))), F.lit("unknown")).alias("type"),
            x.rlike(r"(?i)\[optional\]").alias("optional"),
            blank(strip(F.regexp_extract(x, r"=\s*(.*)$", 1))).alias("default_value"),
        ),
    )


def property_name(text: Column | str) -> Column:
    """struct<name, description> of a combined cell: bullet, bracket, first camel-case name, else all of it is the name."""
    t = strip(text)
    ident = r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)*|[a-z]+[A-Z][a-zA-Z0-9]*)\b"
    name = F.regexp_extract(t, ident, 1)
    at = F.position(name, t)
    rest = strip(F.concat_ws(" ", strip(F.left(t, at - 1)), strip(F.right(t, F.length(t) - at - F.length(name) + 1))))
    return (
        F.when(F.contains(t, F.lit(" • ")), F.struct(strip(F.regexp_extract(t, r"^(.*?) • ", 1)).alias("name"), strip(F.regexp_replace(t, r"^.*? • ", "")).alias("description")))
        .when(F.contains(t, F.lit(" [")), F.struct(strip(F.regexp_extract(t, r"^(.*?) \[", 1)).alias("name"), F.when(t.rlike(r" \[[^\]]*\]"), strip(F.regexp_replace(t, r"^.*? \[[^\]]*\]", ""))).otherwise("").alias("description")))
        .when(name != "", F.struct(name.alias("name"), rest.alias("description")))
        .otherwise(F.struct(t.alias("name"), F.lit("").alias("description")))
    )


def parse_code_value(raw: Column | str) -> Column:
    """struct<value_int, value_str>: hexadecimal or decimal numbers as numbers, other text as text, nothing as nulls."""
    r = strip(raw)
    hexed = F.when(r.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(r, 3, 20), 16, 10).try_cast("long"))
    number = F.coalesce(hexed, F.when(r.rlike(r"^[+-]?[0-9]+$"), r.try_cast("long")))
    return F.struct(number.alias("value_int"), F.when(number.isNull() & (r != ""), r).alias("value_str"))


def code_rows(rows: DataFrame) -> DataFrame:
    """Rows `name = value` or a bare name: table_id, row_idx, name, value_int, value_str, description; braces are skipped."""
    c = strip("c1")
    full = rows.where((c != "") & ~c.isin("{", "}"))
    name, value = F.regexp_extract(c, r"^(\w+)\s*=\s*(.+?)(?:,\s*)?$", 1), F.regexp_extract(c, r"^(\w+)\s*=\s*(.+?)(?:,\s*)?$", 2)
    v = parse_code_value(F.when(name != "", value).otherwise(c))
    return full.select("table_id", "row_idx", F.when(name != "", name).otherwise(c).alias("name"), v.getField("value_int").alias("value_int"), v.getField("value_str").alias("value_str"), strip("c2").alias("description"))


#: What the type of a `_vb` function's only parameter says, and what such a function becomes. Fixed values.
VB_MARK, VB_TEXT = "Visual Basic compatible function of", "VB-compatible alias for "


def method_functions(rows: DataFrame) -> DataFrame:
    """Functions of method tables: table_id, position, return_type, name, params array<struct<name, type, optional, description>>, description.

    rows: table_id, row_idx, c0, c1, c2, as they stand in the tables. A row with a first cell (the return type) opens a
    function, `name(params)` in the second; an empty row closes it, and what follows up to the next opening is left out. Rows below
    an opening, and further lines of its cells, are notes: a parameter's name with a text describes the parameter, the
    first of them counts; all other text goes to the function's description, behind the first line of the opening's
    third cell. A row with a third cell only says nothing. A function that is marked as an alias for Visual Basic has no
    parameters, and its description begins anew. Null cells are empty.
    """
    cells = [strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("c0", "c1", "c2")]
    w = Window.partitionBy("table_id").orderBy("row_idx")
    marked = rows.select("table_id", "row_idx", *cells).withColumn("island", F.sum(F.when(F.col("c0") != "", 1).otherwise(0)).over(w)).where("island > 0")
    empty = F.when(F.concat("c0", "c1", "c2") == "", 1).otherwise(0)
    open_ = marked.withColumn("closed", F.sum(empty).over(Window.partitionBy("table_id", "island").orderBy("row_idx"))).where("closed = 0")
    own = open_.groupBy("table_id", "island").agg(F.sort_array(F.collect_list(F.struct("row_idx", "c0", "c1", "c2"))).alias("r"))  # a function's rows
    head = F.col("r")[0]
    own = own.select("table_id", head["row_idx"].alias("position"), head["c0"].alias("return_type"), head["c1"].alias("c1"), head["c2"].alias("c2"), "r")

    note = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
    one, two = F.split("c1", "\n"), F.split("c2", "\n")
    line = lambda cell, i: strip(F.coalesce(F.get(cell, i), F.lit("")))
    inner = F.transform(F.sequence(F.lit(0), F.greatest(F.size(one), F.size(two)) - 1), lambda i: note(line(one, i), line(two, i)))
    below = F.filter(F.transform(F.col("r"), lambda x: note(x["c1"], x["c2"])), lambda x, i: (i > 0) & (x["name"] != ""))
    signature = F.instr("c1", "(") > 0
    name = strip(F.when(signature, F.regexp_extract("c1", r"(?s)^(.*?)\(", 1)).otherwise(F.get(one, F.lit(0))))
    listed = F.when(signature, parse_inline_params(F.regexp_extract("c1", r"(?s)\(([^)]*)", 1)))
    own = own.select("table_id", "position", "return_type", F.when(name == "", "unnamed").otherwise(name).alias("name"), F.coalesce(listed, F.array().cast("array<struct<name:string,type:string,optional:boolean>>")).alias("params"), F.slice(inner, 2, F.size(inner)).alias("inner"), below.alias("below"), line(two, F.lit(0)).alias("first"))

    alias = F.col("name").endswith("_vb") & (F.size("params") == 1) & F.coalesce(F.contains(F.get(F.col("params"), F.lit(0))["type"], F.lit(VB_MARK)), F.lit(False))
    original = F.get(F.col("params"), F.lit(0))["name"]
    own = own.select("table_id", "position", "return_type", "name", F.when(alias, F.array().cast("array<struct<name:string,type:string,optional:boolean>>")).otherwise(F.col("params")).alias("params"), F.when(alias, F.col("below")).otherwise(F.concat("inner", "below")).alias("notes"), F.when(alias, F.concat(F.lit(VB_TEXT), original)).otherwise(F.col("first")).alias("first"))
    about = lambda n: F.exists("params", lambda p: p["name"] == n["name"]) & (n["text"] != "")
    texts = F.flatten(F.transform(F.filter("notes", lambda n: ~about(n)), lambda n: F.array(n["name"], n["text"])))
    described = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["optional"].alias("optional"), F.coalesce(F.get(F.filter("notes", lambda n: (n["name"] == p["name"]) & (n["text"] != "")), F.lit(0))["text"], F.lit("")).alias("description")))
    return own.select("table_id", "position", "return_type", "name", described.alias("params"), F.array_join(F.filter(F.concat(F.array("first"), texts), lambda t: t != ""), " ").alias("description"))


def assemble_interfaces(functions: DataFrame, properties: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """Functions and properties by interface; of equal names the first counts: doc_id, interface, functions, properties (in order, joined by commas), description.

    functions, properties: doc_id, interface (null: Unknown), position, name, and heading where descriptions are wanted;
    descriptions: doc_id, interface, description. An interface without one is described by its first heading.
    """
    kinds = [("functions", functions), *([("properties", properties)] if properties is not None else [])]
    heading = lambda df: F.col("heading") if "heading" in df.columns else F.lit(None).cast("string")
    rows = [df.select("doc_id", F.coalesce("interface", F.lit("Unknown")).alias("interface"), "position", "name", heading(df).alias("heading"), F.lit(kind).alias("kind")) for kind, df in kinds]
    both = reduce(DataFrame.unionByName, rows)
    first = F.row_number().over(Window.partitionBy("doc_id", "interface", "kind", "name").orderBy("position"))
    names = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("_n") == 1) & (F.col("kind") == kind), F.struct("position", "name")))), lambda s: s["name"]), ",").alias(kind)
    out = both.withColumn("_n", first).groupBy("doc_id", "interface").agg(names("functions"), names("properties"), F.min_by("heading", "position").alias("heading"))
    if descriptions is None:
        return out.withColumnRenamed("heading", "description")
    known = descriptions.select("doc_id", "interface", F.col("description").alias("_d")).hint("merge")
    return out.join(known, ["doc_id", "interface"], "left").select("doc_id", "interface", "functions", "properties", F.coalesce("_d", "heading").alias("description"))


def render_generic_table(rows: Column | str) -> Column:
    """Rows as pipe-table text, pipes in cells escaped."""
    return F.array_join(F.transform(col(rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(strip(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))), "\n")


_ASSIGNED = r"^(\w+)\s*=\s*(.+?)(?:,\s*)?$"


def _grouped(rows: DataFrame, opening: str) -> DataFrame:
    """Rows of each table with the name that its first opening row (`Name {` or `Name = (`) gives."""
    c = strip("c1")
    head = c.rlike(rf"[ =]\{opening}$")
    name = strip(F.regexp_replace(F.regexp_replace(c, rf"\{opening}$", ""), r"\s*=?\s*$", ""))
    names = rows.where(head).groupBy("table_id").agg(F.min_by(name, "row_idx").alias("group_name"))
    return rows.where(~head).join(names.hint("merge"), "table_id", "left")


def enum_rows(rows: DataFrame) -> DataFrame:
    """Members of enum tables: `Name {` names the enum, braces alone are skipped; without a name it is UnknownEnum."""
    c = strip("c1")
    full = _grouped(rows, "{").where((c != "") & ~c.isin("{", "}"))
    name = F.regexp_extract(c, _ASSIGNED, 1)
    v = parse_code_value(F.when(name != "", F.regexp_extract(c, _ASSIGNED, 2)).otherwise(""))
    return full.select("table_id", "row_idx", F.coalesce("group_name", F.lit("UnknownEnum")).alias("enum_name"), F.when(name != "", name).otherwise(c).alias("name"), v.getField("value_int").alias("value_int"), v.getField("value_str").alias("value_str"), strip("c2").alias("description"))


def record_rows(rows: DataFrame) -> DataFrame:
    """Fields of record tables: typed rows are fields, parentheses alone are skipped; without a name it is UnknownRecord."""
    c = strip("c1")
    full = _grouped(rows, "(").where((strip("c0") != "") & (c != "") & ~c.isin("(", ")"))
    return full.select("table_id", "row_idx", F.coalesce("group_name", F.lit("UnknownRecord")).alias("record_name"), strip("c0").alias("type"), F.regexp_replace(c, r",\s*$", "").alias("name"))


def interface_paragraphs(elements: DataFrame) -> DataFrame:
    """Prose under an interface's heading (level 2 or 3) up to the next heading, without its first paragraph."""
    full = elements.where((F.col("kind") == "paragraph") & (strip("text") != ""))
    w = Window.partitionBy("doc_id").orderBy("position")
    rows = full.withColumn("island", F.sum(F.when(F.col("heading_level") >= 0, 1).otherwise(0)).over(w))
    named = F.when(F.col("heading_level").isin(2, 3), F.regexp_extract("text", r"\b(I[A-Z][A-Za-z0-9]*)\b", 1))
    own = Window.partitionBy("doc_id", "island").orderBy("position")
    rows = rows.withColumn("name", F.first(named).over(own)).withColumn("n", F.row_number().over(own)).where("n > 2 and name <> ''")
    return rows.groupBy("doc_id", "island", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n").alias("paragraphs"))

"""The chunk graph of API manuals: building, texts, expansion along parents, names and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.operators.vectors import DIGITS

NODE = ["doc_id", "chunk_id", "parent_id", "kind", "level", "name", "content"]


def path_id(*parts: Column) -> Column:
    """A stable id: the digest of a node's path."""
    return F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)).cast("binary"))


def _nodes(rows: DataFrame, kind: str, level: Column, parent: Column, own: list[Column], name: Column, content: Column) -> DataFrame:
    doc = F.col("doc_id")
    return rows.select(doc, path_id(doc, *own).alias("chunk_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), level.alias("level"), name.alias("name"), content.alias("content"))


def other_nodes(properties: DataFrame | None = None, paragraphs: DataFrame | None = None, tables: DataFrame | None = None, errors: DataFrame | None = None, records: DataFrame | None = None) -> list[DataFrame]:
    """Nodes of further entities.

    properties: doc_id, interface, name, type; paragraphs: doc_id, interface, pos, content; both stand below
    their interface, or at the top where that is null. tables: doc_id, pos, content; errors: doc_id, name,
    value, description; records: doc_id, name, fields array<struct<name, type>>.
    """
    doc, none, c = F.col("doc_id"), F.lit(None).cast("string"), F.col
    below = F.when(c("interface").isNotNull(), 1).otherwise(0) if properties is not None or paragraphs is not None else None
    above = F.when(c("interface").isNotNull(), path_id(doc, c("interface"))) if below is not None else None
    out = []
    if properties is not None:
        out.append(_nodes(properties, "property", below, above, [F.lit("property"), F.coalesce("interface", F.lit("")), c("name")], c("name"), F.concat("name", F.lit(": "), "type")))
    if paragraphs is not None:
        out.append(_nodes(paragraphs, "paragraph", below, above, [F.lit("paragraph"), c("pos")], F.concat(F.lit("Paragraph "), c("pos").cast("string")), c("content")))
    if tables is not None:
        out.append(_nodes(tables, "generic_table", F.lit(0), none, [F.lit("table"), c("pos")], F.concat(F.lit("Table "), c("pos").cast("string")), c("content")))
    if errors is not None:
        out.append(_nodes(errors, "error_code", F.lit(0), none, [F.lit("error"), c("name")], c("name"), F.concat("name", F.lit(" = "), c("value").cast("string"), F.lit(": "), "description")))
    if records is not None:
        fields = F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["type"])), ", ")
        out.append(_nodes(records, "record", F.lit(0), none, [F.lit("record"), c("name")], c("name"), F.concat(F.lit("Record "), c("name"), F.lit(": "), fields)))
        each = records.select(doc, c("name").alias("r"), F.explode("fields").alias("f"))
        out.append(_nodes(each, "record_field", F.lit(1), path_id(doc, F.lit("record"), c("r")), [F.lit("record"), c("r"), c("f.name")], c("f.name"), F.concat("f.name", F.lit(": "), "f.type")))
    return out


def build_chunk_graph(interfaces: DataFrame, enums: DataFrame, max_depth: int = 10, **others: DataFrame) -> DataFrame:
    """Entities to nodes, one explode for each level; nodes at max_depth or deeper are left out.

    interfaces: doc_id, name, methods array<struct<name, returns, params array<struct<name, type>>>>;
    enums: doc_id, name, values array<struct<name, value>>; others: what other_nodes takes.
    """
    doc = F.col("doc_id")
    top = interfaces.select(doc, path_id(doc, F.col("name")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("interface").alias("kind"), F.lit(0).alias("level"), "name", F.concat(F.lit("Interface "), F.col("name")).alias("content"))
    m = interfaces.select(doc, F.col("name").alias("i"), F.explode("methods").alias("m"))
    methods = m.select(
        doc,
        path_id(doc, F.col("i"), F.col("m.name")).alias("chunk_id"),
        path_id(doc, F.col("i")).alias("parent_id"),
        F.lit("method").alias("kind"),
        F.lit(1).alias("level"),
        F.col("m.name").alias("name"),
        F.concat("m.returns", F.lit(" "), "m.name", F.lit("("), F.array_join(F.transform("m.params", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", "), F.lit(")")).alias("content"),
    )
    p = m.select(doc, "i", F.col("m.name").alias("m"), F.explode("m.params").alias("p"))
    params = p.select(doc, path_id(doc, F.col("i"), F.col("m"), F.col("p.name")).alias("chunk_id"), path_id(doc, F.col("i"), F.col("m")).alias("parent_id"), F.lit("parameter").alias("kind"), F.lit(2).alias("level"), F.col("p.name").alias("name"), F.concat("p.name", F.lit(": "), "p.type").alias("content"))
    values = F.array_join(F.transform("values", lambda v: F.concat(v["name"], F.lit(" = "), v["value"])), ", ")
    e = enums.select(doc, path_id(doc, F.col("name")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("enum").alias("kind"), F.lit(0).alias("level"), "name", F.concat(F.lit("Enum "), F.col("name"), F.lit(": "), values).alias("content"))
    v = enums.select(doc, F.col("name").alias("e"), F.explode("values").alias("v"))
    members = v.select(doc, path_id(doc, F.col("e"), F.col("v.name")).alias("chunk_id"), path_id(doc, F.col("e")).alias("parent_id"), F.lit("enum_value").alias("kind"), F.lit(1).alias("level"), F.col("v.name").alias("name"), F.concat("v.name", F.lit(" = "), "v.value").alias("content"))
    return reduce(DataFrame.unionByName, (top, methods, params, e, members, *other_nodes(**others))).where(F.col("level") < max_depth)


def graph_children(nodes: DataFrame) -> DataFrame:
    """chunk_id with its children's ids in order; roots are the nodes without a parent."""
    return nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.array_sort(F.collect_list("chunk_id")).alias("child_ids"))


def graph_to_json(nodes: DataFrame) -> DataFrame:
    """One JSON text for each node."""
    return nodes.select("chunk_id", F.to_json(F.struct("parent_id", "kind", "level", "name", "content")).alias("node"))


def graph_from_json(texts: DataFrame) -> DataFrame:
    """Nodes from their JSON; a missing kind is `section`, a missing level 0, missing text empty."""
    n = F.from_json("node", "parent_id string, kind string, level int, name string, content string")
    rows = texts.select("chunk_id", n.alias("n")).select("chunk_id", "n.*")
    return rows.select("chunk_id", "parent_id", F.coalesce("kind", F.lit("section")).alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("content"))


def expand_parents(found: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, chunk_id) with the ancestors of up to `most` levels."""
    up = nodes.where("parent_id is not null").select(F.col("chunk_id").alias("_c"), F.col("parent_id").alias("_p"))
    now = out = found.select("query_id", "chunk_id")
    for _ in range(most):
        now = now.join(up.hint("merge"), now.chunk_id == F.col("_c")).select("query_id", F.col("_p").alias("chunk_id")).distinct()
        out = out.unionByName(now)
    return out.distinct()


def type_names(content: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(content) if isinstance(content, str) else content, F.lit(r"\b([IE][A-Z]\w*)\b"), F.lit(1)))


def name_index(nodes: DataFrame) -> DataFrame:
    """type name, chunk_id of its node in each document; an interface goes before an enum of the same name."""
    rows = nodes.where(F.col("kind").isin("interface", "enum"))
    first = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(F.desc("kind"), "chunk_id"))
    return rows.withColumn("n", first).where("n = 1").select("doc_id", F.col("name").alias("type_name"), F.col("chunk_id").alias("target"))


def expand_type_refs(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, chunk_id) with the nodes of the types that the contents name: one hop."""
    refs = found.select("query_id", "chunk_id").join(nodes.select("doc_id", "chunk_id", "content").hint("merge"), "chunk_id").select("query_id", "doc_id", F.explode(type_names("content")).alias("type_name"))
    hit = refs.join(name_index(nodes).hint("merge"), ["doc_id", "type_name"]).select("query_id", F.col("target").alias("chunk_id"))
    return found.select("query_id", "chunk_id").unionByName(hit).distinct()


def propagate_scores(expanded: DataFrame, ranked: DataFrame, nodes: DataFrame, factor: float = 0.7) -> DataFrame:
    """Scores of expanded nodes: their own, else factor times the best of scored children and of scored nodes that name their type."""
    scored = ranked.select("query_id", "chunk_id", "score")
    info = nodes.select("doc_id", "chunk_id", "parent_id", "content")
    s = scored.join(info.hint("merge"), "chunk_id")
    by_child = s.where("parent_id is not null").select("query_id", F.col("parent_id").alias("chunk_id"), "score")
    named = s.select("query_id", "doc_id", "score", F.explode(type_names("content")).alias("type_name")).join(name_index(nodes).hint("merge"), ["doc_id", "type_name"]).select("query_id", F.col("target").alias("chunk_id"), "score")
    best = by_child.unionByName(named).groupBy("query_id", "chunk_id").agg(F.round(F.max("score") * factor, DIGITS).alias("from_others"))
    rows = expanded.join(scored.hint("merge"), ["query_id", "chunk_id"], "left").join(best.hint("merge"), ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", F.coalesce("score", "from_others").alias("score"))


def collect_names(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per query the distinct function and type names among its nodes, sorted."""
    rows = found.join(nodes.select("chunk_id", "kind", "name").hint("merge"), "chunk_id")
    pick = lambda *kinds: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("name")))), ",")
    return rows.groupBy("query_id").agg(pick("method").alias("functions"), pick("interface", "enum").alias("types"))


def resolve_sources(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranked ids with content and name; unknown ids are dropped."""
    return ranked.join(nodes.select("chunk_id", "kind", "name", "content").hint("merge"), "chunk_id")


def canonical_params(found: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """Per query the sorted names of parameters, fields and properties among its first `most` nodes."""
    rows = found.where(F.col("rank") <= most).join(nodes.where("kind in ('parameter', 'record_field', 'property')").select("chunk_id", "name").hint("merge"), "chunk_id")
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("params"))


# -- links between pages -------------------------------------------------------------------


def resolve_links(links: DataFrame, chunks: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Page links to chunk links: (links, backlinks), both (doc_id, chunk_index, target, uri, anchor).

    An internal link goes from every chunk of its page to every chunk of the target page; backlinks
    are the same seen from the target, at most `most` for each chunk, in the order of the links.
    """
    at = chunks.select("doc_id", F.col("page").alias("source_page"), "chunk_index")
    to = chunks.select("doc_id", F.col("page").alias("target_page"), F.col("chunk_index").alias("target"))
    out = links.join(at.hint("merge"), ["doc_id", "source_page"]).join(to.hint("merge"), ["doc_id", "target_page"], "left")
    forward = out.where("target is not null or uri is not null").select("doc_id", "chunk_index", "target", "uri", "anchor").distinct()
    back = out.where("target is not null").select("doc_id", F.col("target").alias("chunk_index"), F.col("chunk_index").alias("target"), "anchor").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id", "chunk_index").orderBy("target", "anchor"))
    return forward, back.withColumn("n", n).where(F.col("n") <= most).drop("n")


def expand_with_links(ranked: DataFrame, edges: DataFrame, decay: float = 0.85, factor: int = 2) -> DataFrame:
    """Ranked chunks and their neighbours at decay times the best score that leads there; at most factor times as many.

    ranked: query_id, doc_id, chunk_index, score; edges: doc_id, chunk_index, target (links and backlinks).
    """
    if not decay:
        return ranked
    key = ["query_id", "doc_id", "chunk_index"]
    near = ranked.join(edges.select("doc_id", "chunk_index", "target").distinct().hint("merge"), ["doc_id", "chunk_index"])
    new = near.groupBy("query_id", "doc_id", F.col("target").alias("chunk_index")).agg(F.round(F.max("score") * decay, DIGITS).alias("score"))
    new = new.join(ranked.select(*key).hint("merge"), key, "left_anti")
    rows = ranked.select(*key, "score", F.lit(0).alias("new")).unionByName(new.withColumn("new", F.lit(1)))
    w = Window.partitionBy("query_id")
    n = F.row_number().over(w.orderBy("new", F.desc("score"), "doc_id", "chunk_index"))
    return rows.withColumn("n", n).withColumn("m", F.count(F.when(F.col("new") == 0, 1)).over(w)).where(F.col("n") <= F.col("m") * factor).select(*key, "score")


# -- chunk metadata ----------------------------------------------------------------------


def resolve_page(*places: Column) -> Column:
    """The first place that holds a positive number, else 1."""
    return F.coalesce(*(F.when(p.try_cast("long") > 0, p.try_cast("long")) for p in places), F.lit(1).cast("long"))


def context_prefix(interface: Column, section: Column, element: Column) -> Column:
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    return F.concat_ws(" | ", part("Interface: ", interface), part("Section: ", section), part("Element: ", element))


def augment_text(content: Column, kind: Column, name: Column, section: Column) -> Column:
    """A header of type and name, else the section path, else the type in brackets, in front of the text."""
    title = F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))
    return F.when(kind.isNotNull() & name.isNotNull(), F.concat(title, F.lit(": "), name, F.lit("\n"), content)).when(section.isNotNull(), F.concat(section, F.lit("\n"), content)).when(kind.isNotNull(), F.concat(F.lit("["), kind, F.lit("] "), content)).otherwise(content)


def required_fields(chunks: DataFrame) -> DataFrame:
    """Chunks with their warnings: typed chunks need interface and name; functions must mention a return."""
    typed = F.col("kind").isNotNull() & (F.col("kind") != "mixed")
    w = F.array_compact(F.array(F.when(typed & F.col("interface").isNull(), F.lit("interface")), F.when(typed & F.col("name").isNull(), F.lit("element_name")), F.when((F.col("kind") == "function") & ~F.contains(F.lower("content"), F.lit("return")), F.lit("return"))))
    return chunks.withColumn("warnings", F.array_join(w, ","))


def required_fields_summary(chunks: DataFrame, *by: str) -> DataFrame:
    """Of chunks with warnings: total, passed (without any) and the number of warnings, in all or by columns."""
    n = F.when(F.col("warnings") == "", 0).otherwise(F.size(F.split("warnings", ",")))
    return chunks.groupBy(*by).agg(F.count("*").alias("total"), F.count(F.when(n == 0, 1)).alias("passed"), F.sum(n).alias("n_warnings"))


def suggest_queries(chunks: DataFrame, most: int = 10) -> DataFrame:
    """Questions that the first named chunks of each document answer."""
    rows = chunks.where("name is not null").select("doc_id", "idx", F.posexplode(F.array_compact(F.array(F.concat(F.lit("How do I use "), "name", F.lit("?")), F.when(F.col("interface").isNotNull(), F.concat(F.lit("What is "), "interface", F.lit("."), "name", F.lit("?")))))).alias("k", "question"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "k"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("doc_id", F.col("n").cast("long").alias("place"), "question")


def _element(df: DataFrame, array: str) -> set[str]:
    """The field names of an array's structs."""
    return set(df.schema[array].dataType.elementType.names)


def node_metadata(interfaces: DataFrame, enums: DataFrame, **others: DataFrame) -> DataFrame:
    """chunk_id, kind and meta of build_chunk_graph's nodes, meta being a VARIANT with what the entity says, in fields of its kind.

    Takes what build_chunk_graph takes; entities, methods, parameters, values and fields may also have a description,
    properties also an access.
    """
    doc, c, none = F.col("doc_id"), F.col, F.lit(None).cast("string")
    own = lambda df, name: c(name) if name in df.columns else none
    part = lambda x, name, names: x[name] if name in names else none
    row = lambda df, kind, path, **meta: df.select(path_id(doc, *path).alias("chunk_id"), F.lit(kind).alias("kind"), F.parse_json(F.to_json(F.struct(*(v.alias(k) for k, v in meta.items())))).alias("meta"))
    m_names = _element(interfaces, "methods")
    p_names = set(interfaces.schema["methods"].dataType.elementType["params"].dataType.elementType.names)
    props = others.get("properties")
    held = None if props is None else props.where("interface is not null").groupBy("doc_id", c("interface").alias("name")).agg(F.array_sort(F.collect_list(c("name"))).alias("_props"))
    top = interfaces.withColumn("_props", F.lit(None).cast("array<string>")) if held is None else interfaces.join(held.hint("merge"), ["doc_id", "name"], "left")
    out = [row(top, "interface", [c("name")], interface_name=c("name"), description=own(interfaces, "description"), methods=F.transform("methods", lambda m: m["name"]), properties=c("_props"))]
    m = interfaces.select("doc_id", c("name").alias("i"), F.explode("methods").alias("m"))
    told = lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), part(p, "description", p_names).alias("description"))
    out.append(row(m, "method", [c("i"), c("m.name")], interface_name=c("i"), name=c("m.name"), return_type=c("m.returns"), description=part(c("m"), "description", m_names), parameters=F.transform("m.params", told)))
    p = m.select("doc_id", "i", c("m.name").alias("f"), F.explode("m.params").alias("p"))
    out.append(row(p, "parameter", [c("i"), c("f"), c("p.name")], interface_name=c("i"), function_name=c("f"), name=c("p.name"), type=c("p.type"), description=part(c("p"), "description", p_names)))
    v_names = _element(enums, "values")
    out.append(row(enums, "enum", [c("name")], type_name=c("name"), values=F.transform("values", lambda v: v["name"]), description=own(enums, "description")))
    v = enums.select("doc_id", c("name").alias("e"), F.explode("values").alias("v"))
    out.append(row(v, "enum_value", [c("e"), c("v.name")], type_name=c("e"), name=c("v.name"), value=c("v.value").cast("string"), description=part(c("v"), "description", v_names)))
    if props is not None:
        out.append(row(props, "property", [F.lit("property"), F.coalesce("interface", F.lit("")), c("name")], interface_name=c("interface"), name=c("name"), type=c("type"), access=own(props, "access"), description=own(props, "description")))
    if (rows := others.get("paragraphs")) is not None:
        out.append(row(rows, "paragraph", [F.lit("paragraph"), c("pos")], content=c("content")))
    if (rows := others.get("tables")) is not None:
        out.append(row(rows, "generic_table", [F.lit("table"), c("pos")], content=c("content")))
    if (rows := others.get("errors")) is not None:
        out.append(row(rows, "error_code", [F.lit("error"), c("name")], name=c("name"), code=c("value").cast("string"), description=own(rows, "description")))
    if (rows := others.get("records")) is not None:
        f_names = _element(rows, "fields")
        out.append(row(rows, "record", [F.lit("record"), c("name")], name=c("name"), fields=F.transform("fields", lambda f: f["name"]), description=own(rows, "description")))
        each = rows.select("doc_id", c("name").alias("r"), F.explode("fields").alias("f"))
        out.append(row(each, "record_field", [F.lit("record"), c("r"), c("f.name")], record_name=c("r"), name=c("f.name"), type=c("f.type"), description=part(c("f"), "description", f_names)))
    return reduce(DataFrame.unionByName, out)


def _said(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("meta", f"$.{name}", kind)


_PARAMS = "array<struct<name:string,type:string,description:string>>"


def format_node_text(metadata: DataFrame, style: str = "detailed", signatures: bool = True, descriptions: bool = True) -> DataFrame:
    """chunk_id, text of nodes by kind (chunk_id, kind, meta of node_metadata); style detailed or compact, methods with or without signature, all with or without descriptions."""
    compact = style == "compact"
    given = lambda x, before="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x)).otherwise("")
    told = lambda before: given(_said("description"), before) if descriptions else F.lit("")
    kind_of = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "any").otherwise(x)
    names = lambda name, label: given(F.array_join(_said(name, "array<string>"), ", "), f"\n{label}: ")
    head = lambda long, short, name: F.concat(F.lit(f"{short}: " if compact else f"{long} "), _said(name), told(" - ") if compact else F.when(told(": ") == "", ":").otherwise(told(": ")))
    typed = F.concat(_said("name"), F.lit(": "), kind_of(_said("type")))
    params = F.coalesce(_said("parameters", _PARAMS), F.array().cast(_PARAMS))
    listed = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(": "), kind_of(p["type"]))), ", ")
    returns = F.when(F.coalesce(_said("return_type"), F.lit("")) == "", "void").otherwise(_said("return_type"))
    about = F.array_join(F.transform(F.filter(params, lambda p: F.coalesce(p["description"], F.lit("")) != ""), lambda p: F.concat(F.lit("\n  "), p["name"], F.lit(": "), p["description"])), "") if descriptions else F.lit("")
    method = F.concat(F.concat(_said("name"), F.lit("("), listed, F.lit(") -> "), returns) if signatures else _said("name"), told(": "), about)
    value = _said("value")
    shown = F.when(value.isNull(), "").when(value.rlike("^-?[0-9]+$"), value).otherwise(F.concat(F.lit("'"), value, F.lit("'")))
    values = F.array_join(_said("values", "array<string>"), ", ")
    texts = {
        "interface": F.concat(head("Interface", "I", "interface_name"), names("methods", "M" if compact else "Methods"), names("properties", "P" if compact else "Properties")),
        "method": method,
        "property": F.concat(typed, F.lit(" ["), F.when(F.coalesce(_said("access"), F.lit("")) == "", "public").otherwise(_said("access")), F.lit("]"), told(" - ")),
        "enum": F.concat(F.lit("E: " if compact else "Enum "), _said("type_name"), F.lit(" - " if compact else ": "), values),
        "enum_value": F.concat(_said("name"), F.lit(" = "), shown, told(": ")),
        "error_code": F.concat(_said("name"), F.lit(" ("), F.coalesce(_said("code"), F.lit("")), F.lit(")"), told(": ")),
        "record": F.concat(head("Record", "R", "name"), names("fields", "F" if compact else "Fields")),
        "paragraph": _said("content"),
        "generic_table": _said("content"),
    }
    text = F.concat(typed, told(" - "))  # parameters and fields of records
    for kind, own in texts.items():
        text = F.when(F.col("kind") == kind, own).otherwise(text)
    return metadata.select("chunk_id", F.coalesce(text, F.lit("")).alias("text"))


def keyword_text(metadata: DataFrame) -> DataFrame:
    """chunk_id, keywords for the lexical index: a node's names, types, parameters, values and codes by kind, and its description."""
    params = F.coalesce(_said("parameters", _PARAMS), F.array().cast(_PARAMS))
    full = lambda x: F.coalesce(x, F.lit("")) != ""
    told = F.transform(params, lambda p: F.concat(p["name"], F.when(full(p["type"]), F.concat(F.lit(" ("), p["type"], F.lit(")"))).otherwise(""), F.when(full(p["description"]), F.concat(F.lit(": "), p["description"])).otherwise("")))
    own = {
        "interface": ["interface_name"],
        "method": ["interface_name", "name", "return_type"],
        "parameter": ["interface_name", "function_name", "name", "type"],
        "property": ["interface_name", "name", "type"],
        "enum": ["type_name"],
        "enum_value": ["type_name", "name"],
        "error_code": ["name", "code"],
        "record": ["name"],
        "record_field": ["record_name", "name", "type"],
    }
    parts = F.array(_said("content"))
    for kind, fields in own.items():
        more = [F.when(F.size(params) > 0, F.concat(F.lit("Parameters: "), F.array_join(told, "; ")))] if kind == "method" else [F.array_join(_said("values", "array<string>"), ", ")] if kind == "enum" else []
        parts = F.when(F.col("kind") == kind, F.array(*map(_said, fields), *more)).otherwise(parts)
    words_ = F.filter(F.transform(F.concat(parts, F.array(_said("description"))), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return metadata.select("chunk_id", F.array_join(words_, " ").alias("keywords"))


def format_node_meta(nodes: DataFrame) -> DataFrame:
    """The same from a node's own columns alone, where its entity is gone."""
    return nodes.select("chunk_id", F.concat_ws(": ", "kind", "name", F.nullif("content", F.lit(""))).alias("text"))


def build_api_prompts(found: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """One block of sources for each query, tagged by what they are."""
    rows = found.where(F.col("rank") <= most).join(nodes.select("chunk_id", "kind", "name", "content").hint("merge"), "chunk_id")
    tag = F.when(F.col("kind") == "interface", F.concat(F.lit("[Interface: "), "name", F.lit("] "))).when(F.col("kind") == "method", F.concat(F.lit("[Function: "), "name", F.lit("] "))).otherwise("")
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]: "), tag, "content")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda s: s.t), "\n").alias("sources"))


def augment_text_with_links(chunks: DataFrame, forward: DataFrame, back: DataFrame, n: int = 3, preview: int = 150) -> DataFrame:
    """Chunks with up to n distinct links and n distinct backlinks behind the text; targets by their first characters.

    A target that is gone reads `[deleted chunk]`; internal links come before external ones.
    """
    text = chunks.select("doc_id", F.col("chunk_index").alias("target"), F.left("content", F.lit(preview)).alias("seen"))
    key = ["doc_id", "chunk_index"]

    def block(edges: DataFrame, title: str, name: str) -> DataFrame:
        rows = edges.join(text.hint("merge"), ["doc_id", "target"], "left")
        line = F.when(F.col("target").isNull(), F.concat(F.lit("- "), "uri", F.lit(" (external)"))).otherwise(F.concat(F.lit("- "), F.coalesce("seen", F.lit("[deleted chunk]")), F.lit(" (internal)")))
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("target").asc_nulls_last(), "uri"))
        kept = rows.withColumn("line", line).withColumn("place", place).where(F.col("place") <= n)
        return kept.groupBy(*key).agg(F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n")).alias(name))

    # an internal link may also carry an address: the target decides
    links = forward.select(*key, "target", F.when(F.col("target").isNull(), F.col("uri")).alias("uri")).distinct()
    backlinks = back.select(*key, "target").distinct().withColumn("uri", F.lit(None).cast("string"))
    out = chunks.join(block(links, "Links To", "_l").hint("merge"), key, "left").join(block(backlinks, "Referenced From", "_b").hint("merge"), key, "left")
    return out.select(*key, F.concat("content", F.coalesce("_l", F.lit("")), F.coalesce("_b", F.lit(""))).alias("text"))

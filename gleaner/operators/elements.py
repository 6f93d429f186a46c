"""Code elements of documents: boundaries, classes, names, parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import col, strip

# Return types of code signatures.
TYPES = (
    r"long|void|int|bool|double|string|ELongBoolean|E\w+Result|short|byte|float|uint|ulong|HWND|IntPtr|object|char|decimal|sbyte|ushort|SafeArray|Array|DateTime|Guid|Variant|dynamic"
)
# What begins a new chunk in code, with its priority; the first that fits counts.
SIGNATURES: list[tuple[str, int]] = [
    (rf"\b({TYPES})\s+\w+\s*\(", 90),
    (r"\[ComImport\]", 100),
    (r"\[Guid\([^)]*\)\]", 100),
    (r"\[InterfaceType\([^)]*\)\]", 100),
    (r"\[DllImport\([^)]*\)\]", 100),
    (r"interface\s+I\w+", 95),
    (r"\b(def\s+|function\s+)", 80),
    (r"\b(class\s+\w+)", 80),
    (r"(public|private|protected)\s+\w+\s+\w+\s*\(", 80),
    (r"=>", 60),
]
# Classes of code elements; the first that fits counts.
CLASSES: list[tuple[str, str]] = [
    ("error_code", r"(public\s+)?enum\s+E\w+(Error|Warning|Code)s?\s*\{"),
    ("enum", r"(public\s+)?enum\s+E\w+\s*\{"),
    ("record", r"(public\s+)?(readonly\s+)?(record\s+(struct\s+)?(class\s+)?R\w+|struct\s+\w+)"),
    ("property", r"\[prop(get|put)\]|\{\s*(get|set)\s*(;\s*(get|set)\s*)?;\s*\}|\b(get_|set_)\w+\s*\("),
    ("method", rf"\b({TYPES})\s+\w+\s*\("),
]
MONOSPACE = r"(?i)monospace|courier|consolas"


def infer_element_type(font_size: Column, font_name: Column, content: Column) -> Column:
    """Large and short: heading; monospace: code; else paragraph."""
    return F.when((font_size > 14) & (F.length(content) < 200), "HEADING").when(font_name.rlike(MONOSPACE), "CODE_BLOCK").otherwise("PARAGRAPH")


def signature_boundaries(elements: DataFrame, classified: Column | None = None) -> DataFrame:
    """(doc_id, pos, kind, priority) of elements that begin with a code signature; classified elements are left out."""
    hit = F.coalesce(*(F.when(F.col("content").rlike(p), F.lit(n)) for p, n in SIGNATURES))
    rows = elements if classified is None else elements.where(~F.coalesce(classified, F.lit(False)))
    return rows.withColumn("priority", hit).where("priority is not null").select("doc_id", "pos", F.lit("signature").alias("kind"), "priority")


def block_boundaries(elements: DataFrame, kinds: tuple[str, ...] = ("CODE_BLOCK", "TABLE")) -> DataFrame:
    """A code or table element begins a boundary, and so does the element after one."""
    before = F.lag("type").over(Window.partitionBy("doc_id").orderBy("pos"))
    kind = F.when(F.col("type").isin(*kinds), "block_start").when(F.col("_before").isin(*kinds), "block_end")
    return elements.withColumn("_before", before).withColumn("kind", kind).where("kind is not null").select("doc_id", "pos", "kind", F.when(F.col("kind") == "block_start", 70).otherwise(50).alias("priority"))


Detector = Callable[[DataFrame], DataFrame]


def detect_boundaries(elements: DataFrame, detectors: list[Detector]) -> DataFrame:
    """The best boundary of each element over any number of detectors."""
    found = reduce(DataFrame.unionByName, (d(elements) for d in detectors))
    best = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("priority"), "kind"))
    return found.withColumn("n", best).where("n = 1").drop("n")


def classify_code_element(content: Column | str) -> Column:
    return F.coalesce(*(F.when(col(content).rlike(p), F.lit(n)) for n, p in CLASSES))


def _extract(content: Column | str, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(col(content), pattern, group)
    return F.when(got != "", got)


def code_element_name(content: Column | str, kind: Column) -> Column:
    return (
        F.when(kind.isin("enum", "error_code"), _extract(content, r"enum\s+(E\w+)"))
        .when(kind == "record", _extract(content, r"(?:record|struct)\s+(R?\w+)"))
        .when(kind == "method", _extract(content, rf"\b({TYPES})\s+(\w+)\s*\(", 2))
        .when(kind == "property", F.coalesce(_extract(content, r"\b(get_|set_)(\w+)", 2), _extract(content, r"\b(\w+)\s*\{\s*(get|set)")))
    )


def code_return_type(content: Column | str, kind: Column) -> Column:
    return F.when(kind == "method", _extract(content, rf"\b({TYPES})\s+\w+\s*\(")).when(kind == "property", _extract(content, rf"\b({TYPES})\s+(get_|set_|\w+\s*\{{)"))


def interface_scope(elements: DataFrame) -> DataFrame:
    """Each element with the interface declared last before it in its document."""
    declared = _extract("content", r"^\s*(?:interface|coclass)\s+(\w+)")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("interface", F.last(declared, ignorenulls=True).over(w))


def enum_members(content: Column | str) -> Column:
    """array<struct<name, value>> of what stands between braces."""
    body = F.regexp_extract(col(content), r"\{([^}]*)\}", 1)
    parts = F.filter(F.transform(F.split(body, ","), strip), lambda p: p.rlike(r"^\w+(\s*=.*)?$"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1).alias("name"), strip(F.regexp_extract(p, r"=\s*(.*)$", 1)).alias("value")))


def error_members(content: Column | str) -> Column:
    return F.regexp_extract_all(col(content), F.lit(r"(err\w+)"), F.lit(1))


#: Common terms looked for in names. Fixed values of this library.
TERMS = ("get", "set", "create", "delete", "enum", "record", "interface", "error")


def name_keywords(name: Column, content: Column) -> Column:
    """Parts of a camel-case name longer than one character, then common terms that the content has; each once, lower case."""
    parts = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))
    terms = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower(content), t))
    return F.array_distinct(F.concat(F.transform(F.filter(parts, lambda p: F.length(p) > 1), F.lower), terms))


def signature_params(content: Column | str) -> Column:
    """array<struct<direction, type, name>> of the first parentheses, split on commas outside angle brackets."""
    body = F.regexp_extract(col(content), r"\(([^)]*)\)", 1)
    parts = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"((?:[^,<]|<[^>]*>)+)"), F.lit(1)), strip), lambda p: p != "")
    plain = lambda p: strip(F.regexp_replace(p, r"\[[^\]]*\]", ""))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"\[out\]"), "out").otherwise("in").alias("direction"), strip(F.regexp_replace(plain(p), r"\S+$", "")).alias("type"), F.regexp_extract(plain(p), r"(\S+)$", 1).alias("name")))


def param_descriptions(lines: DataFrame, params: DataFrame) -> DataFrame:
    """(element, name, description): lines of an element that begin with one of its parameters."""
    m = lines.join(params.hint("merge"), "element").where(F.startswith(strip("line"), F.col("name")))
    text = strip(F.regexp_replace(F.expr("substring(trim(line), length(name) + 1)"), r"^\s*[:\-]\s*", ""))
    return m.groupBy("element", "name").agg(F.max_by(text, "line_no").alias("description"))


def reconstruct_signature(elements: DataFrame) -> DataFrame:
    """The first run of lines that belong to a signature, joined by spaces: up to a closing parenthesis, a semicolon or a brace."""

    rows = F.transform(F.split("content", "\n"), strip)
    at = F.array_position(F.transform(rows, lambda x: F.contains(x, F.lit("("))), F.lit(True))
    rest = F.slice(rows, F.greatest(at, F.lit(1)), F.greatest(F.size(rows), F.lit(1)))
    last = F.array_position(F.transform(rest, lambda x: x.rlike(r"[);{]$")), F.lit(True))
    signature = F.array_join(F.slice(rest, F.lit(1), F.when(last > 0, last).otherwise(F.greatest(F.size(rest), F.lit(1)))), " ")
    return elements.withColumn("signature", F.when(at > 0, signature))


#: What a segment takes from its last element that has it, beside the return type.
LAST = ("signature", "parameters", "error_codes", "keywords", "section_path")


def segment_metadata(elements: DataFrame) -> DataFrame:
    """Per segment: one element type or `mixed`, first name, last return type, whether it has code.

    Of the columns LAST that elements have, the last value that isn't null, too.
    """
    kinds = F.collect_set("type")
    first = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("pos")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("return_type", *LAST) if c in elements.columns]
    return elements.groupBy("doc_id", "segment").agg(F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed").alias("element_type"), first.alias("name"), *last, F.max(F.col("type") == "CODE_BLOCK").alias("has_code"))

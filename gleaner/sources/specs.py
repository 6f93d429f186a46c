"""Service descriptions, evaluation sets, index tables and reports as sources and sinks."""

from __future__ import annotations

from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import listed
from gleaner.sources import segments

#: The verbs of a path.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
#: Parameters, body and answers have any form, so they stay JSON texts.
OPERATION = "struct<operationId:string,summary:string,description:string,parameters:array<string>,requestBody:string,responses:map<string,string>,tags:array<string>>"


def openapi_endpoints(specs: DataFrame) -> DataFrame:
    """spec_id, path, method, operation_id, summary, description, parameters, request_body, responses, tags of specs (spec_id, spec as text).

    A text that doesn't begin as a JSON object is read as YAML, where PyYAML is installed; texts that
    are no spec give nothing. parameters is an array of JSON texts, request_body one or null,
    responses an array of status codes.
    """
    is_json = F.ltrim("spec").startswith("{")
    text = F.when(is_json, F.col("spec")).otherwise(yaml_to_json(F.when(~is_json, F.col("spec")))) if find_spec("yaml") else F.col("spec")
    s = F.from_json(text, f"openapi string, swagger string, paths map<string,map<string,{OPERATION}>>")
    known = specs.select("spec_id", s.alias("s")).where("s.openapi is not null or s.swagger is not null")
    paths = known.select("spec_id", F.explode("s.paths").alias("path", "methods"))
    ops = paths.select("spec_id", "path", F.explode("methods").alias("method", "op")).where(F.lower("method").isin(*VERBS))
    none = F.array().cast("array<string>")
    name = F.coalesce("op.operationId", F.concat("method", F.lit("_"), "path"))
    return ops.select("spec_id", "path", F.lower("method").alias("method"), name.alias("operation_id"), *(F.coalesce(f"op.{c}", F.lit("")).alias(c) for c in ("summary", "description")), F.coalesce("op.parameters", none).alias("parameters"), F.col("op.requestBody").alias("request_body"), F.coalesce(F.map_keys("op.responses"), none).alias("responses"), F.array_join(F.coalesce("op.tags", none), ",").alias("tags"))


def yaml_to_json(text: Column) -> Column:
    """JSON text of a YAML spec; null where it can't be read."""
    @F.pandas_udf("string")
    def convert(col: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str | None) -> str | None:
            try:
                return json.dumps(yaml.safe_load(t), default=str) if t else None
            except yaml.YAMLError:
                return None

        return col.map(one)

    return convert(text)


def openapi_overview(endpoints: DataFrame) -> DataFrame:
    """A Markdown list of each spec's endpoints."""
    line = F.concat(F.lit("- **"), F.upper("method"), F.lit("** `"), "path", F.lit("` "), "summary")
    return endpoints.groupBy("spec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "method", line.alias("t")))), lambda s: s.t), "\n").alias("overview"))


def load_eval_dataset(texts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """set_id, question_id, question, document, expected_sources, expected_keywords, min_answer_length; sets without version or questions give nothing.

    With documents (document, content), missing_sources lists the expected sources that the question's
    document does not contain; a question whose document is unknown has none.
    """
    schema = "version string, questions array<struct<id:string,question:string,document:string,expected_sources:array<string>,expected_keywords:array<string>,min_answer_length:long>>"
    s = texts.select("set_id", F.from_json("json", schema).alias("s")).where("s.version is not null and size(s.questions) > 0")
    rows = s.select("set_id", F.explode("s.questions").alias("q")).select("set_id", F.col("q.id").alias("question_id"), "q.question", "q.document", "q.expected_sources", "q.expected_keywords", F.coalesce("q.min_answer_length", F.lit(0)).alias("min_answer_length"))
    if documents is None:
        return rows
    known = documents.select("document", F.col("content").alias("_content")).hint("merge")
    absent = F.filter("expected_sources", lambda x: ~F.contains(F.col("_content"), x))
    missing = F.coalesce(absent, F.array().cast("array<string>"))
    return rows.join(known, "document", "left").withColumn("missing_sources", missing).drop("_content")


def eval_report(summary: DataFrame) -> DataFrame:
    """Lines of a Markdown table, a row for each metric, a column for each of the (few) back ends."""
    names = sorted(r.backend for r in summary.select("backend").distinct().collect())
    wide = summary.groupBy("metric").pivot("backend", names).agg(F.first("mean"))
    cells = F.array(*(F.format_number(F.col(n), 4) for n in names))
    return wide.select("metric", F.concat(F.lit("| "), "metric", F.lit(" | "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


def question_report(results: DataFrame) -> DataFrame:
    """question, lines: Markdown of each question, a heading, then its metrics by back end; results: question, backend, metric, value."""
    item = F.concat(F.lit("- "), "metric", F.lit(": "), F.format_number("value", 4))
    own = results.groupBy("question", "backend").agg(listed(item, F.col("metric")).alias("items"))
    block = F.concat(F.array(F.concat(F.lit("**"), "backend", F.lit("**"))), F.col("items"))
    blocks = own.groupBy("question").agg(F.flatten(listed(block, F.col("backend"))).alias("lines"))
    return blocks.select("question", F.concat(F.array(F.concat(F.lit("### "), F.col("question").cast("string"))), F.col("lines")).alias("lines"))


def write_eval_report(summary: DataFrame, path: str, results: DataFrame | None = None) -> None:
    """The summary, and with results the metrics of each question, as JSON lines and as Markdown below a folder."""
    summary.write.mode("overwrite").json(f"{path}/json")
    eval_report(summary).orderBy("metric").select("line").write.mode("overwrite").text(f"{path}/markdown")
    if results is not None:
        results.write.mode("overwrite").json(f"{path}/questions-json")
        question_report(results).orderBy("question").select(F.explode("lines")).write.mode("overwrite").text(f"{path}/questions-markdown")


def persist_index(rows: DataFrame, path: str, key: str = "chunk_id", replaced: DataFrame | None = None) -> None:
    """Write rows by a key. Keys that are written again are replaced, all others stay and their files aren't touched.

    replaced: keys (column key) whose old rows go even where no new row comes. Rows without a key are left
    out. One writer at a time.
    """
    segments.write(rows, path, key, replaced)


def load_index(spark: SparkSession, path: str, owners: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """The rows of a persisted index, with owners (key and any columns) only those of known owners."""
    rows = segments.read(spark, path, key)
    return rows if owners is None else rows.join(owners.hint("merge"), key)


#: The parts of a document's index.
PARTS = ("nodes", "postings", "vectors")


def persist_documents(path: str, nodes: DataFrame, postings: DataFrame, vectors: DataFrame) -> None:
    """Write the index of some documents: nodes, postings and vectors, each with doc_id and chunk_id.

    A document among the nodes is replaced in all parts, so one written without vectors has none afterwards.
    """
    ids = segments.add(nodes, f"{path}/nodes", "doc_id")  # told by what was written, so nodes are made once
    for name, rows in zip(PARTS[1:], (postings, vectors), strict=True):
        persist_index(rows, f"{path}/{name}", "doc_id", ids)
    segments.merge_newest(nodes.sparkSession, f"{path}/nodes", "doc_id")


def load_documents(spark: SparkSession, path: str, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with embedding, null where a document is searched by words only; postings), of known owners only if given."""
    nodes, postings, vectors = (load_index(spark, f"{path}/{name}", owners if name != "vectors" else None, "doc_id") for name in PARTS)
    return nodes.join(vectors.select("doc_id", "chunk_id", "embedding").hint("merge"), ["doc_id", "chunk_id"], "left"), postings

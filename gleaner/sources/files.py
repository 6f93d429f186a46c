"""Files as documents: scanning a tree, checking uploads, and a registry of parsers by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension: what a file of that kind begins with (None: nothing to check). Fixed values.
KINDS = {"pdf": "%PDF", "docx": "PK", "txt": None, "md": None, "json": None, "yaml": None, "yml": None, "html": None}
MOST = 50 << 20


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of all .txt and .md files below a folder; bytes that aren't UTF-8 become a mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "utf-8").alias("text"))


def validate_uploads(files: DataFrame, most: int = MOST) -> DataFrame:
    """files (path, content, length) with kind and reason: why a file is rejected, else null."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.decode(F.substring("content", 1, 4), "iso-8859-1")
    wrong = F.lit(False)
    for k, magic in KINDS.items():
        if magic:
            wrong = wrong | ((F.col("kind") == k) & ~F.startswith(head, F.lit(magic)))
    known = F.col("kind").isin(*KINDS)
    return files.withColumn("kind", kind).withColumn("reason", F.when(~known, "extension").when(F.col("length") > most, "size").when(wrong, "content"))


Parser = Callable[[bytes], str]
PARSERS: dict[str, Parser] = {k: (lambda b: b.decode("utf-8", "ignore")) for k in ("txt", "md", "json", "yaml", "yml", "html")}


def register_parser(extension: str, parser: Parser) -> None:
    """Parse files of this extension by a function of one file's bytes."""
    PARSERS[extension.lower()] = parser


def parse_files(files: DataFrame) -> DataFrame:
    """path, text, error: each file through the parser of its extension; a failure is a row, not an exception."""
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                parse = parsers.get(path.rpartition(".")[2].lower())
                try:
                    rows.append((path, parse(content), None) if parse else (path, None, "no parser"))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")

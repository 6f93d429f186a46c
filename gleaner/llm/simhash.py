"""SimHash near-duplicates: exact links at a Hamming radius by vantage-point trees.

Fingerprints (64 bits) come from 3-word shingles with repeats. Distinct fingerprints alone are
linked, so a group of copies of any size is one point. A top tree, its vantage points taken from a
bounded sample, deals them into shards: at a node with vantage v and radius r, what lies within r
goes left, what lies beyond r goes right, and by the triangle inequality every link across the
border has its near end within (r - radius, r], so those points go to both sides. Each shard is
searched by a tree of its own and hands on a star of links for each connected group it holds, never
all pairs. Stars are joined by contraction rounds with checkpoints in the shared folder.

Edge cases: a null text has the fingerprint of no words, zero, which links like any other; rows with
a null id get the component of their fingerprint but are never its smallest id; repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import components
from gleaner.llm.hamming import link_groups, route, top_tree

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints that a shard of the top tree aims at, the tree's greatest depth, sampled points: sized for 2^31 fingerprints.
SHARD, DEPTH, SAMPLE = 1 << 14, 17, 1 << 20


def _fingerprint(text: str, n: int = SHINGLE, block: int = 1 << 18) -> int:
    """Majority bits of the XXH64 values of all n-word shingles; zero without words."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone
    words = raw.split()  # at space and 0x09 to 0x0D
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = [0, *(ends[:-n] + 1).tolist()]
    stop = ends[n - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begin), block):
        values = np.array([h(joined[a:b], SEED) for a, b in zip(begin[at : at + block], stop[at : at + block], strict=True)], dtype=">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text, as a signed long."""

    @F.pandas_udf("long")
    def udf(col: pd.Series) -> pd.Series:
        return pd.Series(np.array([_fingerprint(t) if isinstance(t, str) else 0 for t in col], dtype=np.uint64).view(np.int64))

    return udf(text)


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Star links (a, b) that connect exactly what is connected within the radius; points: distinct longs, column fp."""
    n = points.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD)))))
    sample = (points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 << depth)).toPandas()["fp"].to_numpy(np.int64) if depth else np.empty(0, np.int64)).view(np.uint64)
    root, _ = top_tree(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, shard = route(root, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(fp[at], pa.int64())], names=["shard", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy(np.int64))
        first = link_groups(fp.view(np.uint64), radius)
        on = first != np.arange(len(fp))
        return pd.DataFrame({"a": fp[on], "b": fp[first[on]]})

    return points.select("fp").mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id (smallest key reachable)."""
    from gleaner.session import materialise

    rows = materialise(df.select(F.col(key).alias("_key"), fingerprint(F.col(text).cast("string")).alias("fp")), "simhash")
    least = rows.groupBy("fp").agg(F.min("_key").alias("least"))
    group = components(links(least.select("fp"), radius))  # fp, root; linked fingerprints only
    known = least.join(group.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return rows.join(by_fp.hint("merge"), "fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

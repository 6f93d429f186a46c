"""Connected components of a link table by contraction rounds.

In each round every node is renamed to that node among itself and its neighbours whose round hash is
smallest, links are renamed alike, and those within one name are dropped. Hashing anew in each round
shortens chains by a constant share, so rounds grow with the logarithm of the size. The last TAIL links,
a bounded number at any size of the table, are settled in one task. Only renamings are kept, as
checkpoints in the shared folder; nothing but row counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.hamming import settle
from gleaner.session import cut

#: Links that one task may settle at the end.
TAIL = 1 << 14


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(old, new) for every node of at most TAIL links."""
    links = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches if batch.num_rows]
    if not links:
        return
    nodes, at = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    labels, (a, b) = np.arange(len(nodes)), at.reshape(2, -1)
    settle(labels, a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], names=["old", "new"])


def _renamed(names: DataFrame | None, step: DataFrame) -> DataFrame:
    if names is None:
        return step.select(F.col("old").alias("fp"), F.col("new").alias("root"))
    return cut(names.join(step.hint("merge"), names.root == step.old, "left").select("fp", F.coalesce("new", "root").alias("root")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root) for every node of links (a, b); nodes of a component share a root, some node of it."""
    now = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names: DataFrame | None = None
    for k in range(rounds):
        left = now.count()
        if left == 0:
            break
        if left <= TAIL:
            step = cut(now.coalesce(1).mapInArrow(_tail, "old long, new long"))
            names = _renamed(names, step)
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        weigh = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        step = cut(both.groupBy("u").agg(F.min(weigh("v")).alias("m")).select(F.col("u").alias("old"), F.least(F.col("m"), weigh("u")).getField("v").alias("new")))
        moved = step.hint("merge")
        now = now.join(moved, now.a == moved.old).select(F.col("new").alias("a"), "b")
        now = now.join(moved, now.b == moved.old).select("a", F.col("new").alias("b"))
        now = cut(now.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        names = _renamed(names, step)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return names if names is not None else now.select(F.col("a").alias("fp"), F.col("b").alias("root"))

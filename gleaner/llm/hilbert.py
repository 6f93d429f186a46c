"""Nearest neighbours by cosine over shifted Hilbert orderings, made exact by bounded blocks.

Each ordering projects the unit vectors on a few random directions, spreads the coordinates over
[0, 1), shifts them, and sorts the rows along a Hilbert curve; Spark cuts it into blocks at quantile
bounds of the keys. A query meets the rows of its own key window and of the neighbouring windows in
every ordering; what it finds is merged and reranked by exact cosines. That gives each query a score
to beat. A block of the first ordering is then skipped only if its centre and radius show that it
holds nothing better; the others are scored too, so every row is covered and recall is 1 whatever
the data. With exact=False the windows alone count.

Equal vectors are one candidate that carries its smallest ids, as many as a result can hold, so a
vector held by a third of all rows weighs no more than any other.

Edge cases: null vectors, zero vectors, vectors with null or non-finite components, and vectors of
another length than most take no part, as query or candidate; rows with a null id neither; repeated
rows (the same id and vector) count once, an id with several vectors is one candidate at its nearest; fewer candidates than k give fewer rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.ranges import range_bounds, range_of
from gleaner.session import materialise

#: Orderings, projected dimensions, bits for each; key windows on either side of a query's own.
ORDERINGS, DIMS, BITS, REACH = 3, 8, 7, 1
#: Rows of a block, until MOST_BLOCKS blocks are reached; queries that meet a block in one task.
BLOCK, MOST_BLOCKS, QUERIES = 2048, 4096, 1 << 16


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates (rows by dimensions)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, coarsest first
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def ordering(vectors: np.ndarray, k: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors in the k-th ordering."""
    d = vectors.shape[1]
    rng = np.random.default_rng(1000 + k)
    basis, _ = np.linalg.qr(rng.normal(size=(d, min(d, dims))))
    z = vectors @ basis * np.sqrt(d)
    spread = 1 / (1 + np.exp(-1.702 * z))  # nearly uniform for directions without preference
    shifted = (spread + rng.random(basis.shape[1])) / 2
    return hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].d if sizes else 0))


def _score(queries: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(q, c, score): for each query the best `most` rows of each slot it visits, exact cosines."""

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b = _matrix(left["q_v"]), _matrix(right["c_v"])
        ua, ub = _unit(a), _unit(b)
        qid, cid = left["q"].to_numpy(), right["c"].to_numpy()
        out = []
        step = max(1, (1 << 22) // len(b))
        for at in range(0, len(a), step):
            s = ua[at : at + step] @ ub.T
            keep = min(len(b), most + 8)  # a few more, as the product's rounding may swap close ones
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            rows_, cols = np.repeat(np.arange(len(best)), keep), best.ravel()
            x, y = a[at + rows_], b[cols]
            exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            odd = ~np.isfinite(exact)
            exact[odd] = (ua[at + rows_[odd]] * ub[cols[odd]]).sum(1)
            order = np.lexsort((cid[cols], -exact, rows_))
            order = order.reshape(len(best), keep)[:, : min(keep, most)].ravel()
            out.append(pd.DataFrame({"q": qid[at + rows_[order]], "c": cid[cols[order]], "score": exact[order]}))
        return pd.concat(out)

    # both sides descend from one table: new names keep them apart
    queries = queries.select(F.col("slot").alias("q_slot"), F.col("lot").alias("q_lot"), F.col("id").alias("q"), F.col("v").alias("q_v"))
    rows = rows.select(F.col("slot").alias("c_slot"), F.col("lot").alias("c_lot"), F.col("id").alias("c"), F.col("v").alias("c_v"))
    return queries.groupBy("q_slot", "q_lot").cogroup(rows.groupBy("c_slot", "c_lot")).applyInPandas(block, "q long, c long, score double")


def _best(found: DataFrame, most: int) -> DataFrame:
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= most)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, orderings: int = ORDERINGS, reach: int = REACH, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest other rows; is_query is a condition on column id."""
    most = k + 1
    valid = _valid(df, key, vector)
    # one row for each distinct vector with its smallest ids; the limit is applied before the shuffle too
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = valid.dropDuplicates(["id", "v"]).withColumn("nth", nth).where(F.col("nth") <= most)
    classes = few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1).to_numpy(zero_copy_only=False)))
            found = [pa.array(ordering(unit, j), pa.int64()) for j in range(orderings)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["id", "v", "ids", *(f"k{j}" for j in range(orderings))])

    schema = "id long, v array<double>, ids array<long>, " + ", ".join(f"k{j} long" for j in range(orderings))
    table = materialise(classes.select("id", "v", "ids").mapInArrow(keys, schema), "hilbert-rows")
    n = table.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK)))
    bounds = [range_bounds(table, f"k{j}", blocks) for j in range(orderings)]
    for j in range(orderings):
        table = table.withColumn(f"b{j}", range_of(f"k{j}", bounds[j]))

    asked = valid.where(is_query).select(F.col("id").alias("query_id"), "v").distinct()
    asked = materialise(asked.join(table.select("v", F.col("id").alias("q")).hint("merge"), "v").select("query_id", "q"), "hilbert-queries")
    wanted = asked.select(F.col("q").alias("id")).distinct()
    lots = max(1, -(-wanted.count() // QUERIES))
    queries = table.join(wanted.hint("merge"), "id", "left_semi").withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))

    def slot(j: int, place: Column) -> Column:
        return (F.lit(j * (MOST_BLOCKS + 1)) + place).cast("int")

    rows = windows = None
    for j in range(orderings):
        near = F.sequence(F.greatest(F.col(f"b{j}") - reach, F.lit(0)), F.least(F.col(f"b{j}") + reach, F.lit(len(bounds[j]))))
        r = table.select(slot(j, F.col(f"b{j}")).alias("slot"), "id", "v", every.alias("lot"))
        w = queries.select("id", "v", "lot", F.explode(near).alias("b")).withColumn("slot", slot(j, F.col("b"))).drop("b")
        rows, windows = (r, w) if rows is None else (rows.unionByName(r), windows.unionByName(w))
    found = materialise(_best(_score(windows, rows, most), most), "hilbert-windows")

    if exact and len(bounds[0]) > 0:

        def shape(key, pdf: pd.DataFrame) -> pd.DataFrame:
            unit = _unit(_matrix(pdf["v"]))
            centre = unit.mean(axis=0)
            return pd.DataFrame({"b": [int(key[0])], "centre": [centre.tolist()], "radius": [float(np.sqrt(((unit - centre) ** 2).sum(1)).max())]})

        # at most MOST_BLOCKS rows
        shapes = table.groupBy("b0").applyInPandas(shape, "b int, centre array<double>, radius double").toPandas()
        number, centres, radius = shapes["b"].to_numpy(np.int64), _matrix(shapes["centre"]), shapes["radius"].to_numpy()
        to_beat = found.groupBy("q").agg(F.when(F.count("*") >= most, F.min("score")).otherwise(-2.0).alias("least"))

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _unit(_matrix(batch.column(1).to_numpy(zero_copy_only=False)))
                least, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                may = unit @ centres.T + radius >= least[:, None] - 1e-9
                may &= np.abs(number[None, :] - own[:, None]) > reach
                i, b = np.nonzero(may)
                take = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), take.column(2), pa.array(number[b].astype(np.int32))], names=["id", "v", "lot", "slot"])

        open_ = queries.join(to_beat.withColumnRenamed("q", "id").hint("merge"), "id").select("id", "v", "lot", "least", "b0").mapInArrow(rest, "id long, v array<double>, lot int, slot int")
        first = table.select(slot(0, F.col("b0")).alias("slot"), "id", "v", every.alias("lot"))
        found = _best(found.select("q", "c", "score").unionByName(_score(open_, first, most)), most)

    listed = found.select("q", "c", "score").join(table.select(F.col("id").alias("c"), "ids").hint("merge"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(listed.hint("merge"), "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

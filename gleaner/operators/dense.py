"""Exact dense search through a coarse quantiser: lists of vectors are visited while their bound can still matter.

A table of lists is written once. Its cells come from k-means over a bounded sample; a cell's rows are packed, a list at
a time, while they stream by, so no list and no task grows with the table. A list knows its centre, its radius
and its greatest norm: the inner product of a query with any of its rows is at most q.c + |q| r, and at most |q| norm.
Each query visits the most promising list first, which gives a k-th score to beat, and then all lists whose bound
reaches it. Lists and the queries that visit them meet sorted: a list is followed by its queries, so that
neither has to be held for the other and nothing is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import materialise

#: Rows of a list, cells at most, sampled rows for each cell, rows that one task packs of a cell (in the mean).
ROWS, CELLS, SAMPLE, STREAM = 4096, 4096, 16, 1 << 22
#: Decimals of scores, and what rounding may add to one.
DIGITS = 6
SLACK = 2 * 10.0**-DIGITS
LIST = "part string, cell int, list long, n long, vectors binary, centre array<double>, radius double, norm double"


def sound(vector: str):
    """Whether a vector is there, has components, and all of them are finite numbers."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def part_of(vector: str, by: str | None):
    """Queries and chunks that may meet: of one length and, if given, one value of `by`."""
    return F.concat(F.size(vector).cast("string"), F.lit("|"), F.col(by).cast("string") if by else F.lit(""))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """k-means over sampled rows; an empty cell keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds if cells > 1 else 0):
        own = nearest(sample, centres)
        total, many = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(total, own, sample)
        centres[many > 0] = total[many > 0] / many[many > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.empty(0, np.int64)


def vector_lists(chunks: DataFrame, by: str | None = None, rows: int = ROWS, stream: int = STREAM) -> DataFrame:
    """The table of lists of chunks (chunk_id, embedding); chunks without a sound vector, or without `by`, are in none."""
    id_type = dict(chunks.dtypes)["chunk_id"]
    v = F.col("embedding").cast("array<double>")
    valid = chunks.select("chunk_id", v.alias("v"), *([by] if by else [])).where(sound("v"))
    valid = materialise(valid.select(part_of("v", by).alias("part"), "chunk_id", "v").where("part is not null"), "dense-rows")
    n = valid.count()
    cells = min(CELLS, max(1, -(-n // rows)))
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, centres = (sizes[0].d if sizes else 0), np.zeros((1, 0))
    if cells > 1:
        drawn = valid.where(F.size("v") == dim).orderBy(F.xxhash64("chunk_id", "v")).limit(SAMPLE * cells).select("v").toArrow()
        centres = centroids(_matrix(drawn.column("v").combine_chunks()), min(cells, drawn.num_rows))
    salts = max(1, -(-n // stream))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            cell = np.zeros(batch.num_rows, np.int32)  # vectors of rarer lengths share one cell each
            on = np.flatnonzero(lengths == dim)
            if cells > 1 and len(on):
                cell[on] = nearest(_matrix(batch.column("v").take(pa.array(on))), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def packed(part: str, cell: int, number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(batches)
        m = _matrix(own.column("v").combine_chunks())
        centre = m.mean(axis=0)
        row = {"part": [part], "cell": [cell], "list": [number], "n": [len(m)], "vectors": [m.tobytes()], "centre": [centre.tolist()], "radius": [float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())], "norm": [float(np.sqrt((m * m).sum(axis=1)).max())]}
        ids = own.column("chunk_id").combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(row.values(), kinds, strict=True)), listed], names=[*row, "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held, size, key = [], 0, None
        for batch in batches:
            parts, cell = batch.column("part").to_pylist(), batch.column("cell").to_pylist()
            at = 0
            while at < len(parts):
                now, stop = (parts[at], cell[at]), at
                if held and (now != key or size == rows):
                    yield packed(*key, number, held)
                    held, size, number = [], 0, number + 1
                key = now
                while stop < len(parts) and size + stop - at < rows and (parts[stop], cell[stop]) == key:
                    stop += 1
                held.append(batch.select(["chunk_id", "v"]).slice(at, stop - at))
                size, at = size + stop - at, stop
        if held:
            yield packed(*key, number, held)

    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")
    dealt = valid.mapInArrow(deal, f"part string, chunk_id {id_type}, v array<double>, cell int").withColumn("salt", salt)
    near = dealt.repartition("part", "cell", "salt").sortWithinPartitions("part", "cell", "salt").select("part", "chunk_id", "v", "cell")
    return near.mapInArrow(pack, f"{LIST}, ids array<{id_type}>")


@dataclass
class Found:
    """hits: query_id, chunk_id, score of the k best; pairs: (query_id, list, n) that were scored; least: query_id, least, if asked for."""

    hits: DataFrame
    pairs: DataFrame
    least: DataFrame | None = None


def search(queries: DataFrame, lists: DataFrame, k: int, by: str | None = None, least: bool = False) -> Found:
    """The k best inner products of each query (query_id, embedding), rounded, ties to the smaller chunk_id; lists: as written and read back."""
    q_type, c_type = dict(queries.dtypes)["query_id"], dict(lists.dtypes)["ids"][6:-1]
    v = F.col("embedding").cast("array<double>")
    asked = queries.select("query_id", v.alias("v"), *([by] if by else [])).where(sound("v")).select("query_id", "v", part_of("v", by).alias("part")).where("part is not null")
    asked = materialise(asked, "dense-queries")
    meta = lists.select("part", "cell", "list", "n", "centre", "radius", "norm")

    def bounds(q: np.ndarray, c: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.sqrt((q * q).sum(axis=1))
        mid, reach = (q * c).sum(axis=1), size * radius
        rounding = 1e-9 * (1 + size * norm)
        return np.minimum(mid + reach, size * norm) + rounding + SLACK, np.maximum(mid - reach, -size * norm) - rounding - SLACK

    tops: dict[str, tuple[np.ndarray, ...]] = {}
    if not by:

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, cell, centres, radii, norms in zip(*(b.column(x).to_pylist() for x in ("part", "cell", "centres", "radii", "norms")), strict=True):
                    m = np.array(centres)
                    mid = m.mean(axis=0)
                    reach = float((np.sqrt(((m - mid) ** 2).sum(axis=1)) + np.array(radii)).max())
                    yield pa.RecordBatch.from_pylist([{"part": key, "cell": cell, "centre": mid.tolist(), "radius": reach, "norm": max(norms)}], schema=pa.schema([("part", pa.string()), ("cell", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64())]))

        cells = meta.groupBy("part", "cell").agg(*(F.collect_list(x).alias(y) for x, y in (("centre", "centres"), ("radius", "radii"), ("norm", "norms"))))
        # at most CELLS rows, and one for each rarer length
        gathered = cells.mapInArrow(around, "part string, cell int, centre array<double>, radius double, norm double").toPandas()
        for key, own in gathered.groupby("part"):
            tops[str(key)] = own["cell"].to_numpy(), np.stack(own["centre"].to_numpy()), own["radius"].to_numpy(), own["norm"].to_numpy()

    def to_cells(one: bool):
        """Rows with each cell that may hold something, or only the most promising."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, key in enumerate(b.column("part").to_pylist()):
                    if key not in tops:
                        continue
                    cell, centre, radius, norm = tops[key]
                    q = np.asarray(b.column("v")[at].values.to_numpy(zero_copy_only=False))[None, :]
                    up, down = bounds(np.broadcast_to(q, centre.shape), centre, radius, norm)
                    on = up >= b.column("beat")[at].as_py()
                    if least:
                        on |= down <= b.column("under")[at].as_py()
                    own = cell[[int(np.argmax(up))]] if one else cell[on]
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(np.full(len(own), at))).columns, pa.array(own, pa.int32())], names=[*b.schema.names, "cell"])

        return run

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a query and a list that may hold something, with the bound."""
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda name: b.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            up, down, lengths = np.empty(b.num_rows), np.empty(b.num_rows), b.column("v").value_lengths().to_numpy()
            for own in (np.flatnonzero(lengths == d) for d in np.unique(lengths)):
                q, c = (_matrix(b.column(x).take(pa.array(own))) for x in ("v", "centre"))
                up[own], down[own] = bounds(q, c, col("radius")[own], col("norm")[own])
            on = up >= col("beat")
            if least:
                on |= down <= col("under")
            keep = pa.array(np.flatnonzero(on & (b.column("list").to_numpy() != col("seen"))))
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(keep) for x in ("query_id", "v", "list", "n")), pa.array(up).take(keep)], names=["query_id", "v", "list", "n", "up"])

    def pairs(rows: DataFrame, one: bool) -> DataFrame:
        if not by:
            rows = rows.select("query_id", "v", "part", "beat", "under", "seen").mapInArrow(to_cells(one), f"query_id {q_type}, v array<double>, part string, beat double, under double, seen long, cell int")
        met = rows.join(meta.hint("merge"), "part" if by else ["part", "cell"]).select("query_id", "v", "list", "n", "centre", "radius", "norm", "beat", "under", "seen")
        return met.mapInArrow(judge, f"query_id {q_type}, v array<double>, list long, n long, up double")

    def visit(met: DataFrame) -> DataFrame:
        """Sorted by list: the list itself, then its queries."""
        head = lists.join(met.select("list").distinct().hint("merge"), "list", "left_semi").select("list", F.lit(0).alias("kind"), "ids", "vectors", F.lit(None).cast(q_type).alias("query_id"), F.lit(None).cast("array<double>").alias("v"))
        tail = met.select("list", F.lit(1).alias("kind"), F.lit(None).cast(f"array<{c_type}>").alias("ids"), F.lit(None).cast("binary").alias("vectors"), "query_id", "v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = None, None
            for b in batches:
                kind = b.column("kind").to_numpy()
                for at in np.split(np.arange(len(kind)), np.flatnonzero((kind[1:] == 0) | (kind[:-1] == 0)) + 1) if len(kind) else []:
                    if kind[at[0]] == 0:
                        ids = b.column("ids").slice(at[0], 1).flatten()
                        m = np.frombuffer(b.column("vectors")[int(at[0])].as_py()).reshape(len(ids), -1)
                        place = np.empty(len(ids), np.int64)
                        place[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))
                        continue
                    s = np.round(_matrix(b.column("v").slice(at[0], len(at))) @ m.T, DIGITS) + 0.0
                    few = min(k, len(ids))
                    row, col = np.nonzero(s >= np.partition(s, len(ids) - few, axis=1)[:, [len(ids) - few]])
                    order = np.lexsort((place[col], -s[row, col], row))
                    row, col = row[order], col[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < few
                    row, col = row[kept], col[kept]
                    if least:
                        row, col = np.append(row, np.arange(len(at))), np.append(col, np.argmin(s, axis=1))
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(at[row])), ids.take(pa.array(col)), pa.array(s[row, col])], names=["query_id", "chunk_id", "score"])

        both = head.unionByName(tail).repartition("list").sortWithinPartitions("list", "kind")
        return both.mapInArrow(run, f"query_id {q_type}, chunk_id {c_type}, score double")

    low = F.lit(float("-inf")).alias("beat"), F.lit(float("inf")).alias("under"), F.lit(-1).cast("long").alias("seen")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("up"), "list"))
    first = materialise(pairs(asked.select("query_id", "v", "part", *low), True).withColumn("nth", nth).where("nth = 1").drop("nth", "up"), "dense-first")
    seed = materialise(visit(first), "dense-seed")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    beat = seed.dropDuplicates(["query_id", "chunk_id"]).withColumn("nth", best).where(F.col("nth") == k).select("query_id", F.col("score").alias("beat"))
    under = seed.groupBy("query_id").agg(F.min("score").alias("under"))
    known = asked.join(first.select("query_id", F.col("list").alias("seen")).hint("merge"), "query_id").join(beat.hint("merge"), "query_id", "left").join(under.hint("merge"), "query_id")
    known = known.select("query_id", "v", "part", F.coalesce("beat", F.lit(float("-inf"))).alias("beat"), "under", "seen")
    rest = materialise(pairs(known, False).drop("up"), "dense-rest")
    found = seed.unionByName(visit(rest)).dropDuplicates(["query_id", "chunk_id"])
    if least:
        found = materialise(found, "dense-found")
    hits = found.withColumn("nth", best).where(F.col("nth") <= k).drop("nth")
    scored = first.select("query_id", "list", "n").unionByName(rest.select("query_id", "list", "n"))
    return Found(hits, scored, found.groupBy("query_id").agg(F.min("score").alias("least")) if least else None)

"""Near-duplicates at a Jaccard similarity of word shingles: SimHash tables searched by vantage-point trees.

A text is the set of its 5-word shingles; equal sets are one point. A point's SimHash has tables of some bits and a
check part of 128. In every table, points whose parts differ in RADIUS bits or fewer are
candidates if their check parts differ in FAR bits or fewer. A pair at similarity 0.8 differs in 0.15 of
its bits; there are as many tables as let it pass in some table with probability RECALL, and a nearer pair more surely. A part
has two bits more than the number of points has, so a point meets about as many others by chance at any size of the table.

Each table is searched by vantage-point trees: a top tree from a bounded sample deals the points to shards,
border points to both sides, and each shard hands on a spanning forest of the candidate pairs that it finds, nearest first. Before
that, points with equal parts are followed in sorted order, in SALTS runs each, and those near the first of
their run are linked to it and stand back behind it in that table, so that a group of near copies of any size
leaves few points in a shard.

Candidates only form groups; what counts is the exact similarity of the sets, and within a group no link is
missed, whatever its size. A group is dealt into blocks of BLOCK points, each compared with the same LEADERS of the
group, or as a whole if it is one block. Then candidate pairs that are still apart are compared. Two points that are apart
after that can't both be in the group's largest part, so those outside it are compared with all blocks.

Edge cases: texts without words (null, empty, blank) are one point and in no candidate pair; a text shorter
than a shingle is one shingle; null and repeated keys and repeated rows are points like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.components import components
from gleaner.llm.hamming import forest, near_pairs, route, top_tree
from gleaner.llm.shingles import shingle_sets, simhash_bits
from gleaner.llm.textbatch import groups
from gleaner.session import materialise

SHINGLE, SEED = 5, 42
POINT = "point long, f0 long, f1 long, parts array<long>"
#: Similar from so many hundredths of the union on.
SIMILAR = 80
RADIUS, RECALL = 1, 0.976
#: Words of the SimHash, of which the last two are the check part; bits of it that a candidate may differ in; runs of equal parts.
WORDS, FAR, SALTS = 8, 36, 16
#: Points that a shard aims at, the top tree's greatest depth, its sampled points.
SHARD, DEPTH, SAMPLE = 1 << 14, 15, 1 << 18
#: Points compared in one task; points of a larger group that all others are compared with; products looked at together.
BLOCK, LEADERS, PRODUCTS = 512, 64, 1 << 21


def table_plan(points: int) -> np.ndarray:
    """Places of the bits of each table's part (tables by bits) for so many points."""
    bits = max(16, int(np.ceil(np.log2(max(points, 2)))) + 2)
    share = 0.85**bits + bits * 0.15 * 0.85 ** (bits - 1)  # of pairs at similarity 0.8 that pass in one table
    tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - share)))
    free, rng = 64 * WORDS - 128, np.random.default_rng(SEED)
    rounds = -(-tables // (free // bits))  # tables of one round share no bit
    return np.concatenate([rng.permutation(free)[: free // bits * bits].reshape(-1, bits) for _ in range(rounds)])[:tables]


def _describe(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bits_of = plan.shape
        weight = np.int64(1) << np.arange(bits_of, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in groups([t or "" for t in texts]):
                sets = shingle_sets(texts[lo:hi], SHINGLE)
                point = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                bits = simhash_bits(sets, WORDS)
                check = np.packbits(bits[:, -128:], axis=1).view(">i8").astype(np.int64)
                parts = bits[:, plan.ravel()].reshape(-1, tables, bits_of) @ weight
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, tables), pa.int32()), pa.array(parts.ravel()))
                columns = [batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(point), pa.array(check[:, 0]), pa.array(check[:, 1]), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "digest", "point", "f0", "f1", "parts"])

    return run


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing check bits of two rows each."""
    return np.bitwise_count((one ^ other).view(np.uint64)).sum(axis=1)  # of a negative number its bits, not its size's


def candidates(points: DataFrame, tables: int) -> DataFrame:
    """Candidate pairs (a, b) that connect what is connected by candidates; points: distinct rows of POINT with so many parts."""
    spark = points.sparkSession
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(points.count(), 1) / SHARD)))))
    sample = points.orderBy(F.xxhash64("point")).limit(min(SAMPLE, 64 << depth)).select("parts").toPandas()["parts"].tolist() if depth else []
    sampled = np.array(sample, dtype=np.uint64).reshape(-1, tables)
    trees = [top_tree(sampled[:, t], depth) for t in range(tables)]
    first = np.cumsum([0, *(n for _, n in trees)]).tolist()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            point, f0, f1 = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), tables) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(parts), pa.array(point), pa.array(f0), pa.array(f1)], names=["t", "part", "point", "f0", "f1"])

    def stand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by run: a row near its run's first becomes a link (shard below 0); other rows go to their shards."""
        last: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)  # t, part, salt, point, f0, f1
            new = (now[1:, :3] != now[:-1, :3]).any(axis=1)
            head = last is None or (now[0, :3] != last[:3]).any()
            at = np.maximum.accumulate(np.where(np.append(head, new), np.arange(len(now)), -1))
            lead = now[at]
            if last is not None:
                lead[at < 0] = last
            last = lead[-1]
            linked = (lead[:, 3] != now[:, 3]) & (_apart(lead[:, 4:], now[:, 4:]) <= FAR)
            rows = [np.stack([np.full(int(linked.sum()), -1), now[linked, 1], now[linked, 3], lead[linked, 3], now[linked, 5]], axis=1)]
            rows[0][:, 0] -= now[linked, 3] % 1024
            for t in np.unique(now[~linked, 0]):
                own = now[~linked & (now[:, 0] == t)]
                i, shard = route(trees[t][0], own[:, 1].astype(np.uint64), RADIUS)
                rows.append(np.column_stack([shard + first[t], own[i][:, [1, 3, 4, 5]]]))
            out = np.concatenate(rows)
            kinds = (np.int32, np.int64, np.int64, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, k].astype(kind)) for k, kind in enumerate(kinds)], names=["shard", "part", "point", "f0", "f1"])

    def nearest_first(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(_apart(f[a], f[b]), kind="stable")
        return forest(len(f), a[order], b[order])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if int(key[0]) < 0:
            return pd.DataFrame({"a": pdf["point"], "b": pdf["f0"]})
        own = pdf.sort_values("part", kind="stable")
        part, point, f = own["part"].to_numpy(), own["point"].to_numpy(), own[["f0", "f1"]].to_numpy()
        value, begin, many = np.unique(part, return_index=True, return_counts=True)
        same = np.flatnonzero(many > 1)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in [(same, same), *near_pairs(value.astype(np.uint64), RADIUS)]:
            stop = np.cumsum(many[i] * many[j])  # all rows of one value with all of the other, so many at a time
            for lo in range(0, int(stop[-1]) if len(stop) else 0, PRODUCTS):
                k = np.arange(lo, min(lo + PRODUCTS, int(stop[-1])))
                pair = np.searchsorted(stop, k, side="right")
                k -= stop[pair] - many[i[pair]] * many[j[pair]]
                wide = many[j[pair]]
                p, q = begin[i[pair]] + k // wide, begin[j[pair]] + k % wide
                near = (point[p] != point[q]) & (_apart(f[p], f[q]) <= FAR)
                a, b = np.append(a, p[near]), np.append(b, q[near])
                if len(a) > 1 << 18:
                    a, b = nearest_first(a, b, f)
        a, b = nearest_first(a, b, f)
        return pd.DataFrame({"a": point[a], "b": point[b]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = points.where("point <> 0").select("point", "f0", "f1", "parts").mapInArrow(spread, "t int, part long, point long, f0 long, f1 long")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int"))
    runs = rows.repartition(parts, "t", "part", "salt").sortWithinPartitions("t", "part", "salt", "point").select("t", "part", "salt", "point", "f0", "f1")
    dealt = runs.mapInArrow(stand_back, "shard int, part long, point long, f0 long, f1 long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def similar_to(own: np.ndarray, others: list[np.ndarray], hundredths: int = SIMILAR) -> np.ndarray:
    """Which of the other sets are similar to this one."""
    size = np.array([len(s) for s in others], np.int64)
    out = (100 * size >= hundredths * len(own)) & (100 * len(own) >= hundredths * size) & (size > 0)
    near = np.flatnonzero(out)
    if not len(near) or not len(own):
        return np.zeros(len(others), bool)
    flat = np.concatenate([others[i] for i in near])
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[place] == flat).astype(np.int64), np.append(0, np.cumsum(size[near])[:-1]))
    out[near] = 100 * both >= hundredths * (size[near] + len(own) - both)
    return out


def similar_groups(sets: list[np.ndarray], hundredths: int = SIMILAR) -> np.ndarray:
    """For each set the place of one set of its connected group, the same for all of it."""
    first = np.arange(len(sets))
    left = np.arange(len(sets))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        on = similar_to(sets[at], [sets[i] for i in left], hundredths)
        first[left[on]] = first[at]
        todo += left[on].tolist()
        left = left[~on]
    return first


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(s, np.int64).view(np.uint64) for s in column]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between similar sets: in whole groups, or between a block's points and the leaders of its group."""
    a, b = [], []
    for _, own in pdf.sort_values(["root", "place", "point"], kind="stable").groupby("root"):
        point, sets = own["point"].to_numpy(np.int64), _sets(own["set"])
        if own["whole"].iloc[0]:
            a.append(point)
            b.append(point[similar_groups(sets)])
            continue
        n = int((own["place"] <= LEADERS).sum())
        cluster, rest = similar_groups(sets[:n]), sets[n:]
        a.append(point[:n])
        b.append(point[cluster])
        for c in np.unique(cluster):
            left = np.arange(len(rest))
            for k in np.flatnonzero(cluster == c):
                on = similar_to(sets[k], [rest[i] for i in left])
                a.append(point[n + left[on]])
                b.append(np.full(int(on.sum()), point[k]))
                left = left[~on]
    x, y = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": x[x != y], "b": y[x != y]})


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (_sets(batch.column(i).to_pandas()) for i in (2, 3))
        on = pa.array([bool(similar_to(x, [y])[0]) for x, y in zip(one, other, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])


def _probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links from points outside their group's largest part to one point of each other part of the block that is similar."""
    a, b = [], []
    sets, part, point = _sets(right["set"]), right["part"].to_numpy(np.int64), right["point"].to_numpy(np.int64)
    for own, home, s in zip(left["q_point"], left["q_part"], _sets(left["q_set"]), strict=True):
        other = np.flatnonzero(part != home)
        on = other[similar_to(s, [sets[i] for i in other])] if len(other) else other
        _, first = np.unique(part[on], return_index=True)
        a += [own] * len(first)
        b += point[on[first]].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def text_digest(text: Column) -> Column:
    """What tells texts apart: the 128 bits of their MD5, nothing for null."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: key, digest (text_digest), group (the same for all rows connected by similar pairs)."""
    body = F.col(text).cast("string")
    texts = df.select(body.alias("text"), F.col(key).alias("_key"), text_digest(body).alias("digest"))
    kind = dict(texts.dtypes)["_key"]
    plan = table_plan(df.count())
    rows = materialise(texts.mapInArrow(_describe(plan), f"_key {kind}, digest binary, {POINT}"), "near-points")
    points = rows.groupBy("point").agg(F.min("digest").alias("digest"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("parts").alias("parts"))
    pairs = materialise(candidates(points, len(plan)), "near-pairs")
    maybe = components(pairs)  # fp, root

    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("fp"), "fp"))
    leaders = maybe.withColumn("place", place).where(F.col("place") <= LEADERS).select("fp", "place")
    sizes = maybe.groupBy("root").agg(F.count("*").alias("n"))
    chosen = maybe.join(sizes.hint("merge"), "root").join(leaders.hint("merge"), "fp", "left")
    chosen = chosen.join(rows.groupBy("point").agg(F.min("digest").alias("digest")).hint("merge"), F.col("point") == F.col("fp"))
    chosen = chosen.select("digest", "point", "root", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.coalesce("place", F.lit(LEADERS + 1)).alias("place"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(0).to_pylist(), SHINGLE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, 5)), pa.array(sets, pa.list_(pa.int64()))], names=["point", "root", "blocks", "place", "set"])

    once = texts.groupBy("digest").agg(F.first("text").alias("text")).join(chosen.hint("merge"), "digest").select("text", "point", "root", "blocks", "place")
    sets = materialise(once.mapInArrow(to_sets, "point long, root long, blocks int, place int, set array<long>"), "near-sets")

    whole = F.col("blocks") == 1
    tasks = max(1, sets.count() // block)
    own_block = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    # a whole group goes to one of the tasks, a large one's points to their blocks, its leaders to all of these
    blocks = F.when((F.col("place") <= LEADERS) & ~whole, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own_block))
    task = F.when(whole, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root"))
    met = sets.select(task.alias("task"), F.explode(blocks).alias("block"), whole.alias("whole"), "root", "point", "place", "set")
    links = materialise(met.groupBy("task", "whole", "block").applyInPandas(_compare, "a long, b long"), "near-links")

    large = sets.where(~whole).select("point", "root", "blocks", "set")
    if not large.isEmpty():

        def parts_of(group: DataFrame) -> DataFrame:
            return large.select("point", "root").join(group.select(F.col("fp").alias("point"), F.col("root").alias("part")).hint("merge"), "point", "left").select("point", "root", F.coalesce("part", "point").alias("part"))

        group = components(links)
        one, other = (parts_of(group).select(F.col("point").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
        apart = pairs.distinct().join(one.hint("merge"), "a").join(other.hint("merge"), "b").where("part_a <> part_b").select("a", "b")
        apart = materialise(apart, "near-apart")  # two of these tables descend from one: read anew, they join as two
        one, other = (large.select(F.col("point").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        beside = apart.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "set_a", "set_b")
        links = materialise(group.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(beside.mapInArrow(_check, "a long, b long")), "near-beside")

        # two points that are still apart aren't both in their group's largest part: the others meet all blocks
        group = components(links)
        part = materialise(parts_of(group), "near-parts")
        largest = part.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        told = part.join(largest.hint("merge"), "root").withColumn("out", F.col("part") != F.col("main"))
        lots = told.where("out").groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("lots"))
        side = told.join(lots.hint("merge"), "root").select("point", "part", "out", "lots")
        side = materialise(side.join(large.hint("merge"), "point").select("point", "root", "part", "out", "lots", "blocks", "set"), "near-sides")
        asked = side.where("out").select(F.col("root").alias("q_root"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"), F.pmod(F.xxhash64("point"), F.col("lots")).cast("int").alias("q_lot"), F.col("point").alias("q_point"), F.col("part").alias("q_part"), F.col("set").alias("q_set"))
        held = side.select("root", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "point", "part", "set")
        probed = asked.groupBy("q_root", "q_block", "q_lot").cogroup(held.groupBy("root", "block", "lot")).applyInPandas(_probe, "a long, b long")
        links = materialise(group.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(probed), "near-probed")
    known = components(links).select(F.col("fp").alias("point"), "root")
    found = rows.select("_key", "digest", "point", "f0", "f1").join(known.hint("merge"), "point", "left")
    # a text in no pair is told from others of the same 64-bit point by its check part
    alone = F.col("root").isNull()
    group = F.struct(F.coalesce("root", "point").alias("point"), *(F.when(alone, F.col(c)).alias(c) for c in ("f0", "f1")))
    return found.select(F.col("_key").alias(key), "digest", group.alias("group"))

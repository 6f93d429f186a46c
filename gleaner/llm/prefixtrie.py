"""The prefix trie of conversations, as a table of nodes.

Turns are numbered after a range sort by (conversation, turn), so that a conversation of any length is dealt
over tasks. A prefix is known by its depth and a 128-bit digest: a polynomial over the digests of its turns, so
that a piece of a conversation moves to another place by one multiplication, and pieces of a long one are
joined by their sums alone.

A node is a group of equal digests; its members and smallest member are counted by Spark with partial sums. A node
that has one member has only that conversation's own path below it, so its numbers are known at once; the
others and the root are summed up in shards:

* a node's value (its tokens saved, its leaves) belongs to its smallest member, and shards are blocks of whole
  conversations that own such nodes, with the digests of all their prefixes;
* a shard lists its distinct digests, gives each a slot by a minimal perfect hash (the digest kept there is
  compared at each look-up), scatters values into flat arrays and adds each depth to its parents' slots, deepest first;
* the sums of a node over all shards are added up by Spark.

So no group of nodes or conversations meets in one task, however many share a beginning. Only the ids of one node's
ends are hashed in one stream, from chunks that were joined beforehand.

Edge cases: rows with a null conversation take no part; ties of turn go by role, then text; repeated rows are turns like
others; donors are found by c - c % 5 with the sign of c, as SQL has it; an empty table has no nodes; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textbatch import mix
from gleaner.session import materialise

#: Conversations of one group lend their first member's beginning, of fewer turns than LENT.
GROUP, LENT = 5, 9
#: Rows of a shard, ids of a chunk.
SHARD, CHUNK = 1 << 18, 4096
BASES = np.array([0x5851F42D4C957F2D, 0xD1342543DE82EF95], np.uint64)
KEY = ["depth", "p0", "p1"]


def powers(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent (0 or more), modulo 2^64."""
    out, left = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * base, out)
        base, left = base * base, left >> np.uint64(1)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (part, conv, l, s0, s1, r0, r1, bytes): place in this part's run of the conversation, sums with and without the turn."""
    part = TaskContext.get().partitionId()
    last, held, before = None, 0, np.zeros(2, np.uint64)  # the conversation that the last batch ended in
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        new = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        goes_on = start < 0
        place = np.where(goes_on, at + held + 1, at - start + 1)
        turn = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(n, 2)
        sums = np.empty((n, 2), np.uint64)
        value = np.empty((n, 2), np.uint64)
        for k in range(2):
            value[:, k] = turn[:, k] * powers(BASES[k], place)
            total = np.append(np.uint64(0), np.cumsum(value[:, k]))
            sums[:, k] = total[1:] - total[np.maximum(start, 0)] + np.where(goes_on, before[k], np.uint64(0))
        last, held, before = conv[-1], int(place[-1]), sums[-1].copy()
        rest = sums - value
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(conv), pa.array(place), *map(_signed, (sums[:, 0].copy(), sums[:, 1].copy(), rest[:, 0].copy(), rest[:, 1].copy())), batch.column("bytes")]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv", "l", "s0", "s1", "r0", "r1", "bytes"])


_M = (1 << 64) - 1
_HEAD = "array<struct<o:long,s0:long,s1:long,r0:long,r1:long,bytes:long>>"


def _wrapped(x: int) -> int:
    x &= _M
    return x - (1 << 64) if x >> 63 else x


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation: its turns, its first turns, and what comes before each part's run."""
    bases = [int(b) for b in BASES]
    for batch in batches:
        heads, runs, sizes = [], [], []
        for parts in batch.column("runs").to_pylist():
            n, before, head, run = 0, [0, 0], [], []
            for r in sorted(parts, key=lambda r: r["part"]):
                shift = [pow(b, n, 1 << 64) for b in bases]
                run.append({"part": r["part"], "off": n, "o0": _wrapped(before[0]), "o1": _wrapped(before[1])})
                for x in sorted(r["head"], key=lambda x: x["l"]):
                    if n + x["l"] < LENT:
                        head.append({"o": n + x["l"], "bytes": x["bytes"]} | {f"{c}{k}": _wrapped(before[k] + shift[k] * x[f"{c}{k}"]) for c in "sr" for k in (0, 1)})
                before = [b + s * x for b, s, x in zip(before, shift, (r["s"]["s0"], r["s"]["s1"]), strict=True)]
                n += r["n"]
            heads.append(head)
            runs.append(run)
            sizes.append(n)
        head = pa.array(heads, pa.list_(pa.struct([(c, pa.int64()) for c in ("o", "s0", "s1", "r0", "r1", "bytes")])))
        run = pa.array(runs, pa.list_(pa.struct([("part", pa.int32()), ("off", pa.int64()), ("o0", pa.int64()), ("o1", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(sizes, pa.int64()), head, run], names=["conv", "n", "head", "runs"])


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns at their rebuilt places, with the digests of the prefixes that end in and before them."""
    for b in batches:
        off, l, h, m = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("off", "l", "h", "m"))  # noqa: E741
        depth = m + off + l - h
        digests = []
        for c in "sr":
            for k in range(2):
                whole = _unsigned(b, f"o{k}") + powers(BASES[k], off) * _unsigned(b, f"{c}{k}")
                # the own beginning of h turns gives way to one of m turns, m being h or less
                inverse = np.uint64(pow(int(BASES[k]), -1, 1 << 64))
                digests.append(_signed(_unsigned(b, f"d{k}") + (whole - _unsigned(b, f"b{k}")) * powers(inverse, h - m)))
        last = depth == b.column("length").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(depth), *digests, b.column("bytes"), pa.array(last)], names=["conv", "depth", "p0", "p1", "q0", "q1", "bytes", "last"])


class Slots:
    """A minimal perfect hash over distinct 128-bit keys: level by level, keys alone in their cell get its rank as slot."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        own, base = np.arange(len(k0)), 0
        slot = np.empty(len(k0), np.int64)
        while len(own):
            cells = max(8, len(own) + len(own) // 2)
            at = self._cell(k0[own], k1[own], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((cells, alone, rank))
            taken = alone[at]
            slot[own[taken]] = rank[at[taken]]
            own, base = own[~taken], base + int(alone.sum())
        self.k0, self.k1 = np.empty_like(k0), np.empty_like(k1)
        self.k0[slot], self.k1[slot] = k0, k1

    @staticmethod
    def _cell(k0: np.ndarray, k1: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mix(k0 ^ mix(k1 + np.uint64(level))) % np.uint64(cells)).astype(np.int64)

    def __call__(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The slots of keys; a key that isn't the one kept in its slot is an error."""
        out, own = np.full(len(k0), -1, np.int64), np.arange(len(k0))
        for level, (cells, alone, rank) in enumerate(self.levels):
            at = self._cell(k0[own], k1[own], level, cells)
            on = alone[at]
            out[own[on]] = rank[at[on]]
            own = own[~on]
        if len(own) or (self.k0[out] != k0).any() or (self.k1[out] != k1).any():
            raise ValueError("a prefix that isn't in the table")
        return out


def sum_up(depth: np.ndarray, p: np.ndarray, q: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, digest, sums) of every distinct node of the rows and of the root: values (rows by kinds) summed over its subtree."""
    salt = mix(depth.astype(np.uint64))  # a digest counts together with its depth
    keys, first = np.unique(np.stack([p[:, 0] ^ salt, p[:, 1]], axis=1), axis=0, return_index=True)
    slots = Slots(keys[:, 0].copy(), keys[:, 1].copy())
    own = slots(p[:, 0] ^ salt, p[:, 1])
    n = len(keys)
    sums, deep, digest, parent = np.zeros((n + 1, values.shape[1]), np.int64), np.zeros(n + 1, np.int64), np.zeros((n + 1, 2), np.uint64), np.full(n + 1, n)
    np.add.at(sums, own, values)
    deep[own[first]], digest[own[first]] = depth[first], p[first]
    inner = first[depth[first] > 1]
    parent[own[inner]] = slots(q[inner, 0] ^ mix(depth[inner].astype(np.uint64) - np.uint64(1)), q[inner, 1])
    order = np.argsort(-deep[:n], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1) if n else []:
        np.add.at(sums, parent[level], sums[level])
    return deep, digest, sums


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed(t: pa.Table) -> pa.RecordBatch:
        lane = lambda a, b: np.stack([t.column(c).to_numpy().view(np.uint64) for c in (a, b)], axis=1)
        deep, digest, sums = sum_up(t.column("depth").to_numpy(), lane("p0", "p1"), lane("q0", "q1"), np.stack([t.column(c).to_numpy() for c in ("leaves", "saved")], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(deep), *(_signed(digest[:, k].copy()) for k in (0, 1)), *(pa.array(sums[:, k]) for k in (0, 1))], names=[*KEY, "leaves", "saved"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        border = 0
        if size >= SHARD:
            other = np.flatnonzero(conv != last)
            if len(other):
                border = int(other[0])
                yield summed(pa.Table.from_batches([*held, batch.slice(0, border)]))
                held, size = [], 0
        held.append(batch.slice(border))
        size, last = size + batch.num_rows - border, conv[-1]
    if held:
        yield summed(pa.Table.from_batches(held))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p0, p1, conv) to joined ids, at most CHUNK of one node each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
        conv = batch.column("conv").to_numpy()
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        at = np.arange(len(conv))
        start = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % CHUNK == 0))
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(start, np.append(start[1:], len(conv)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[start, k]) for k in range(3)), pa.array(conv[start]), pa.array(ids, pa.string())], names=[*KEY, "conv", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True)) | {"list_sha256": sha.hexdigest()}])
    for batch in batches:
        for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if k != key:
                if key is not None:
                    yield row()
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if key is not None:
        yield row()


def lender(conv: Column) -> Column:
    """The conversation that lends its beginning."""
    return conv - conv % GROUP


def lent(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % LENT


def prefixes(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per prefix of each rebuilt conversation, one row per conversation with its rebuilt length)."""
    own, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), own.alias("role"), said.alias("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    rows = materialise(sorted_.mapInArrow(_number, "part int, conv long, l long, s0 long, s1 long, r0 long, r1 long, bytes long"), "trie-turns")

    first = F.collect_list(F.when(F.col("l") < LENT, F.struct("l", "s0", "s1", "r0", "r1", "bytes")))
    runs = rows.groupBy("conv", "part").agg(F.max("l").alias("n"), F.max_by(F.struct("s0", "s1"), "l").alias("s"), first.alias("head"))
    joined = runs.groupBy("conv").agg(F.collect_list(F.struct("part", "n", "s", "head")).alias("runs"))  # a conversation has a run in each part at most
    convs = materialise(joined.mapInArrow(_join_runs, f"conv long, n long, head {_HEAD}, runs array<struct<part:int,off:long,o0:long,o1:long>>"), "trie-conversations")
    lenders = convs.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("lender"), F.col("n").alias("its"), F.col("head").alias("beginning"))
    both = convs.withColumn("lender", lender(F.col("conv"))).join(lenders.hint("merge"), "lender", "left").withColumn("h", lent(F.col("conv")))
    both = both.withColumn("m", F.least("h", F.coalesce("its", F.lit(0))))
    at = lambda head, place, lane: F.coalesce(F.get(F.col(head), F.col(place).cast("int") - 1)[lane], F.lit(0).cast("long"))
    bases = [at(head, place, f"s{k}").alias(f"{name}{k}") for head, place, name in (("head", "h", "b"), ("beginning", "m", "d")) for k in (0, 1)]
    info = both.select("conv", "runs", "beginning", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), *bases)
    info = materialise(info, "trie-lengths")

    taken = info.select("conv", "length", F.explode(F.slice("beginning", F.lit(1), F.col("m").cast("int"))).alias("t")).select("conv", F.col("t.o").alias("depth"), *(F.col(f"t.{a}{k}").alias(f"{b}{k}") for a, b in ("sp", "rq") for k in (0, 1)), F.col("t.bytes").alias("bytes"), (F.col("t.o") == F.col("length")).alias("last"))
    by_run = info.select("conv", F.explode("runs").alias("r"), "h", "m", "length", "b0", "b1", "d0", "d1").select("conv", "r.*", "h", "m", "length", "b0", "b1", "d0", "d1")
    kept = rows.join(by_run.hint("merge"), ["conv", "part"]).where(F.col("off") + F.col("l") > F.col("h"))
    moved = kept.mapInArrow(_move, "conv long, depth long, p0 long, p1 long, q0 long, q1 long, bytes long, last boolean")
    return materialise(taken.unionByName(moved), "trie-prefixes"), info.select("conv", "length")


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def nodes(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows, lengths = prefixes(conversations, key, turn, role, text)
    silent = F.col("length") == 0
    top = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if(silent).alias("ends"), F.min(F.when(silent, F.col("conv"))).alias("end")).first()
    if not top.n:
        return spark.createDataFrame([], RESULT)
    last = F.col("last")
    found = materialise(
        rows.groupBy(*KEY).agg(
            F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.min("q0").alias("q0"), F.min("q1").alias("q1"), F.count_if(last).alias("ends"), F.min(F.when(last, F.col("conv"))).alias("end")
        ),
        "trie-nodes",
    )
    alone = F.col("n") == 1
    many = found.where("depth = 1").agg(F.count("*").alias("kids"), F.count_if(alone).alias("tails")).first()
    root = spark.createDataFrame([(0, 0, 0, top.conv, top.n, 0, None, None, top.ends, top.end, many.kids, many.tails)], "depth long, p0 long, p1 long, conv long, n long, bytes long, q0 long, q1 long, ends long, end long, kids long, tails long")
    below = found.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("q0").alias("p0"), F.col("q1").alias("p1")).agg(F.count("*").alias("kids"), F.count_if(alone).alias("tails"))
    zero = F.lit(0).cast("long")
    inner = found.where(~alone).join(below.hint("merge"), KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("kids", "tails")})
    shared = materialise(root.unionByName(inner), "trie-shared")

    # what each shared node adds to itself and to all above it
    leaves, saved = F.col("tails") + (F.col("kids") == 0).cast("long"), (F.col("n") - 1) * F.col("bytes")
    inside = shared.where("depth > 0")
    owners = inside.groupBy("conv").agg(F.max("depth").alias("deep"))
    ways = rows.join(owners.hint("merge"), "conv").where("depth <= deep").select("conv", *KEY, "q0", "q1", zero.alias("leaves"), zero.alias("saved"))
    values = ways.unionByName(inside.select("conv", *KEY, "q0", "q1", leaves.alias("leaves"), saved.alias("saved")))
    near = values.repartition(lender(F.col("conv"))).sortWithinPartitions(lender(F.col("conv")), "conv")
    sums = near.mapInArrow(_shards, "depth long, p0 long, p1 long, leaves long, saved long").groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    lists = shared.where("ends > 1").select(*KEY)
    ends = rows.where(last).select(*KEY, "conv").join(lists.where("depth > 0").hint("merge"), KEY, "left_semi")
    if top.ends > 1:
        ends = ends.unionByName(lengths.where(silent).select(zero.alias("depth"), zero.alias("p0"), zero.alias("p1"), "conv"))
    chunks = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_chunks, "depth long, p0 long, p1 long, conv long, ids string")
    hashes = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "conv").select(*KEY, "ids").mapInArrow(_hashes, "depth long, p0 long, p1 long, list_sha256 string")

    up = shared.select((F.col("depth") + 1).alias("depth"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv").alias("parent")).where("depth > 1")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.lit(top.conv)).otherwise(F.coalesce("parent", "conv")).cast("long")
    none = F.sha2(F.lit("").cast("binary"), 256)
    one = F.sha2(F.col("end").cast("string").cast("binary"), 256)
    summed = shared.join(sums.hint("merge"), KEY, "left").join(hashes.hint("merge"), KEY, "left").join(up.hint("merge"), ["depth", "q0", "q1"], "left")
    # the root's own share, which is in no shard
    extra = F.when(F.col("depth") == 0, leaves).otherwise(zero)
    out = summed.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        (F.coalesce("leaves", zero) + extra).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.when(F.col("ends") == 0, none).when(F.col("ends") == 1, one).otherwise(F.col("list_sha256")).alias("ends_sha256"),
    )
    tails = found.where(alone).join(up.hint("merge"), ["depth", "q0", "q1"], "left").select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), (1 - F.col("ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("ends") == 0, none).otherwise(one).alias("ends_sha256"),
    )
    return out.unionByName(tails)

"""The conversation trie against a plain dictionary of prefixes; odd rows; slots and shards alone."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gleaner.llm import prefixtrie, queries
from gleaner.session import table

SCHEMA = "conv_id long, turn long, role string, text string, depth string, lender int"


def brute(rows):
    """{(depth, prefix): node} by the definition; rows of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(first, [])[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        turns = tuple(rebuilt[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    out, sums = [], {}
    for x in sorted(members, key=len, reverse=True):
        own_saved = (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        sums[x] = (sum(sums[y][0] for y in children[x]) or 1, own_saved + sum(sums[y][1] for y in children[x]))
        up = members[x[:-1]][0] if x else None
        out.append((members[x][0], len(x), up, len(members[x]), len(children[x]), *sums[x], hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_query(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()
        got = queries.op12_trie(spark, d)
        assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in got.columns}
        assert found(got) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_crowded(spark, seed, monkeypatch):
    """Few texts, so that conversations share much; nulls, ties, repeated rows, one long conversation, tiny shards and chunks."""
    monkeypatch.setattr(prefixtrie, "SHARD", 20)
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    rng = random.Random(seed)
    rows = []
    for c in range(-12, 60):
        if rng.random() < 0.8:
            same = rng.random() < 0.4
            for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
                text = "again" if same else rng.choice(["a", "b", "é", "", None])
                rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None]) if not same else "user", text))
    rows += [rows[0], rows[5], (None, 1, "user", "a"), (None, None, None, None)]
    rows += [(1000 + seed, t, "user", rng.choice("ab")) for t in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert found(prefixtrie.nodes(df)) == brute(rows)


def test_turnless_and_empty(spark):
    """Conversations that give all their turns away for none have only the root."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    d = next(x for x in range(c + 1, 300) if x % 5 and zlib.crc32(str(x).encode()) % 9 > 1 and x - x % 5 != c - c % 5)
    rows = [(c, 0, "user", "a"), (d, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(prefixtrie.nodes(df)) == brute(rows) == [(c, 0, None, 2, 0, 1, 0, hashlib.sha256(f"{c},{d}".encode()).hexdigest())]
    assert found(prefixtrie.nodes(df.where(f"conv_id = {c}"))) == brute(rows[:1])
    assert found(prefixtrie.nodes(df.where("1 = 0"))) == []


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        keys[: n // 2, 0] = 7  # half a key alike
        slots = prefixtrie.Slots(keys[:, 0].copy(), keys[:, 1].copy())
        assert sorted(slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        slots(np.array([1], np.uint64), np.array([2], np.uint64))

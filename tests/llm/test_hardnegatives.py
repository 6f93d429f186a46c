"""Hard negatives against all pairs; boxes and packing alone; odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hardnegatives, queries, rtree
from gleaner.session import table


def brute(rows, scale=256):
    """Rows of (id, label, vector), all valid."""
    whole = [(i, y, [int(np.floor(scale * float(x))) for x in v]) for i, y, v in rows]
    out = []
    for a, ya, va in {repr(r): r for r in whole if r[0] % 100 == 0}.values():
        score = lambda v: sum(x * y for x, y in zip(va, v, strict=True))  # noqa: B023, E731
        others = sorted(((-score(v), c, y) for c, y, v in whole if c != a))
        for ps, c in [(-s, c) for s, c, y in others if y == ya][:5]:
            fits = [(-s, n) for s, n, y in others if y != ya and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, c, k + 1, n, ps, s) for k, (s, n) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert got(queries.op11_negatives(spark, sf)) == brute(rows)


@pytest.mark.parametrize("shard", [7, 40, 2048])
def test_clusters_and_copies(spark, shard):
    """Clustered vectors, a third of all alike, labels of very different size, small shards."""
    rng = random.Random(shard)
    rows = []
    for i in range(-100, 700):
        centre = random.Random(i % 6)
        v = [centre.gauss(0, 1) + rng.gauss(0, 0.2) for _ in range(6)] if i % 3 else [0.5, 0.25, -1.0, 0.0, 2.0, 1.0]
        rows.append((i, 1 if i % 4 else rng.choice([2, 3, -5]), v))
    rows += rows[:3] + [(200, 3, [1.0] * 6), (7, 1, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    assert got(hardnegatives.mine(df, F.col("id") % 100 == 0, shard=shard)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, 1, [1.0, 2.0]), (101, 1, [1.0, 1.0]), (102, 2, [0.5, 0.5]), (103, 2, [0.5, 0.5]), (200, 3, [-1.0, 0.0]), (201, 3, [1.0, 0.0]), (300, 4, [3e6, 3e6]), (301, 4, [3e6, 3e6 + 1]), (302, 5, [2e6, 1e6 + 1])]
    odd = [(1, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, 1, [1.0]), (400, 1, [])]
    schema = "vec_id long, label int, embedding array<double>, score int"
    df = spark.createDataFrame([(*r, None) for r in good + odd], schema)
    assert got(hardnegatives.mine(df, F.col("id") % 100 == 0)) == brute(good)
    huge = spark.createDataFrame([(100, 1, [1e200, 1.0], 0), (101, 1, [1e200, 0.0], 0), (102, 2, [1.0, 1.0], 0)], schema)
    assert {r.positive_score for r in hardnegatives.mine(huge, F.col("id") % 100 == 0).collect()} <= {(1 << 63) - 1}
    for rows in ([], odd, good[:1]):
        assert got(hardnegatives.mine(spark.createDataFrame([(*r, None) for r in rows], schema), F.col("id") % 100 == 0)) == []


def test_boxes_bound_products():
    rng = np.random.default_rng(2)
    for n, d in ((1, 3), (500, 4), (3000, 9)):
        vectors = rng.integers(-50, 50, (n, d)).astype(float)
        labels = rng.integers(0, 3, n)
        order = rtree.str_order(np.column_stack([labels, vectors]), 16)
        assert sorted(order.tolist()) == list(range(n))
        tree = rtree.RTree(np.arange(n), labels[order], vectors[order], leaf=16, fan=4)
        query = rng.integers(-50, 50, d).astype(float)
        exact = vectors[order] @ query
        low, high = (b[0] for b in rtree.bounds(query[None, :], tree.low, tree.high))
        for leaf in range(-(-n // 16)):
            own = exact[16 * leaf : 16 * leaf + 16]
            assert low[leaf] <= own.min() and own.max() <= high[leaf]
        for same in (True, False):
            for lo, hi in ((-(10**9), 10**9), (-300, 200)):
                fit = sorted((-s, i) for i, s in enumerate(exact.tolist()) if (labels[order][i] == 1) == same and i != 0 and lo <= s <= hi)[:5]
                scores, ids = next(tree.search(query, [rtree.Request(0, 1, same, lo, hi, rtree.LEAST)], 5))
                assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == fit


def test_a_task_hands_on_its_best(spark):
    """However many shards a task reads, it hands on k rows of a window, those of all shards."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), rng.normal(0, 1, 8).tolist()) for i in range(600)]
    index = hardnegatives.Index(*hardnegatives._valid(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "embedding", "label", 256), 20)
    shards = index.shards.select("tile", "sub", "kind", "ids", "labels", "vectors").toArrow().to_batches()
    assert sum(b.num_rows for b in shards) > 20
    whole = np.floor(256 * np.array([v for _, _, v in rows]))
    ids, labels = np.arange(600), np.array([y for _, y, _ in rows])
    windows = [[(rtree.LEAST, rtree.MOST)] if i % 2 else [(-50_000, 90_000), (0, 60_000), (5, 7)] for i in range(600)]
    lot = rtree.Lot(ids, labels, whole, windows, False)
    least = np.where(lot.lows <= lot.highs, -np.inf, np.inf)
    got = [r for b in hardnegatives._searched(lot, least, 4, ids)(iter(shards)) for r in b.to_pylist()]
    assert len(got) <= 4 * sum(map(len, windows))
    scores = whole @ whole.T
    for a in range(0, 600, 37):
        for w, (lo, hi) in enumerate(windows[a]):
            fit = sorted((-s, c) for c, s in enumerate(scores[a].tolist()) if labels[c] != labels[a] and c != a and lo <= s <= hi)[:4]
            assert [(-r["score"], r["c"]) for r in got if (r["a"], r["w"]) == (a, w)] == fit

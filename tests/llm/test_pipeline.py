"""The pipeline against its stages done by hand, and odd rows through every stage."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from gleaner.llm import langid, neardup, toxicity
from gleaner.session import table
from test_operators import odd_docs


def test_pipeline_rows(spark, sf):
    docs = table(spark, sf, "documents")
    profiles = langid.fit_profiles(docs.where(~langid.held_out()))
    known = [r for r in langid.predict(docs, profiles).collect() if r.lang_pred != "und" and r.score >= pipeline.LEAST_LANGUAGE_SCORE]
    ids = {r.doc_id for r in known}
    first = docs.where(docs.doc_id.isin(ids))
    machine = toxicity.fit(first, table(spark, sf, "labels").where(~toxicity.held_out()))
    mild = {r.doc_id for r in toxicity.predict(first, machine).where("predicted = 0").collect()}
    second = docs.where(docs.doc_id.isin(mild))
    kept = set(five_word_groups({r.doc_id: r.text for r in second.select("doc_id", "text").collect()}).values())
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in got)


def test_odd_rows(spark, sf):
    docs = odd_docs(spark)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("1 = 0"), sf).count() == 0
    left = [r.doc_id for r in pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(k for k in left if k) == [1, 3, 4, 5, 6, 8] and None in left


def five_word_groups(texts):
    """Of texts by id: groups connected by 5-word Jaccard similarity of 0.8 or more, every pair compared."""
    sets = {}
    for k, t in texts.items():
        words = (t or "").lower().split()
        sets[k] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    group = {k: k for k in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if a < b and small >= 0.8 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                one, other = group[a], group[b]
                group = {k: min(one, other) if g in (one, other) else g for k, g in group.items()}
    return group


def test_near_dedup_by_jaccard(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    group = five_word_groups({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    left = {r.doc_id for r in pipeline.near_dedup(spark, docs, sf).select("doc_id").collect()}
    assert left == set(group.values())
    assert 2 not in left or 56 not in left  # Jaccard 0.967 at 5 bits of SimHash


def test_near_dedup_large_group_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = {}
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(100), rng.choice((1, 2, 3))):
            words[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(words)
    want = five_word_groups(texts)
    assert 1 < len(set(want.values())) < 80
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (7, 512):
        got = defaultdict(set)
        for r in neardup.near_duplicates(df, block=block).collect():
            got[r.group].add(r.doc_id)
        assert {min(g) for g in got.values()} == set(want.values())


def test_near_dedup_repeated_and_null_ids(spark):
    a, b, c = ("one two three four five six " + w for w in ("seven", "eight nine ten eleven twelve", "alpha beta gamma delta epsilon"))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(left, key=str) == sorted([(1, a), (5, b), (None, c)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_lose_no_link(spark, seed, monkeypatch):
    """Blocks of 5 and two leaders: every link within a candidate group is found, also between parts without a leader."""
    monkeypatch.setattr(neardup, "LEADERS", 2)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = {}
    for k in range(110):
        words = list(texts[rng.randrange(k)].split() if k and rng.random() < 0.6 else base)
        for at in rng.sample(range(100), rng.choice((1, 2, 3))):
            words[at] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(words)
    want = five_word_groups(texts)
    assert 1 < len(set(want.values())) < 100
    got = defaultdict(set)
    for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=5).collect():
        got[r.group].add(r.doc_id)
    assert {min(g) for g in got.values()} == set(want.values())


def test_table_plan_keeps_candidates_even():
    """Parts grow with the logarithm of the size, tables so that recall stays."""
    for n in (10, 50_000, 10**6, 10**9):
        plan = neardup.table_plan(n)
        tables, bits = plan.shape
        assert all(len(set(t)) == bits and max(t) < 64 * neardup.WORDS - 128 for t in plan.tolist())
        share = 0.85**bits + bits * 0.15 * 0.85 ** (bits - 1)
        assert 1 - (1 - share) ** tables >= neardup.RECALL
        if n >= 50_000:
            assert tables * (bits + 1) * n / 2**bits < 1000

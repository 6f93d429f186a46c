"""Every query of the library proper against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from gleaner import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "precision", "recall", "mrr"]


def test_streams_match_their_batch_twins(spark):
    for stream, batch in (("stream_rate_limit", "rate_limit"), ("stream_cache_replay", "cache_replay")):
        a, b = (sorted(map(tuple, plans.QUERIES[n](spark, SF).collect())) for n in (stream, batch))
        assert a == b


def test_the_rest_works_without_the_training_data_operators():
    """Nothing outside names the subpackage but the entry module."""
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "gleaner"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "gleaner.llm" not in f.read_text(), f

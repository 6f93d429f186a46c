"""Hand-computed cases of operators whose meaning SQL over the test tables does not show."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import answers as J
from gleaner.operators import chunking as C
from gleaner.operators import elements as E
from gleaner.operators import graph as GR
from gleaner.operators import lexical as H
from gleaner.operators import manuals as M
from gleaner.operators import vectors as G
from gleaner.session import materialise, scratch_path
from gleaner.streaming import jobs


def value(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(c.alias("v")).first().v


def test_pack_parts():
    text = "aaaa\nbbbb\ncccc"
    assert C.pack_parts(text, 9, 0, "\n") == ["aaaa\nbbbb", "cccc"]
    assert C.pack_parts(text, 10, 0, "\n", "legacy") == ["aaaabbbb", "cccc"]
    assert C.pack_parts("x" * 10, 4, 1, "\n") == ["xxxx"] * 3
    assert C.pack_parts("abcdef", 4, 2, "") == ["abcd", "ef"]
    assert C.pack_parts("x" * 9, 4, 9, "\n")[-1] == "xxxx"  # an overlap over the size still ends


def test_chunks_rejoin_to_the_text(spark):
    text = "\n".join(f"line {i} of a text" for i in range(200))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = C.chunk_recursive(df, size=300, overlap=0).orderBy("chunk_index").collect()
    assert "\n".join(r.content for r in rows) == text


def test_merge_and_split(spark):
    rows = [(1, 0, "a b"), (1, 1, "c " * 80), (1, 2, "d " * 80)]
    merged = C.merge_undersized(spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")).orderBy("chunk_index").collect()
    assert [r.merged for r in merged] == [1, 0]
    big = spark.createDataFrame([(1, 0, "\n\n".join(["w " * 30] * 10))], "doc_id long, chunk_index int, content string")
    pieces = C.split_oversized(big, 100).collect()
    assert sum(len(p.content.split()) for p in pieces) == 300 and max(len(p.content.split()) for p in pieces) <= 100


def test_bm25_prefers_the_rarer_term(spark):
    chunks = spark.createDataFrame([(1, "red apple"), (2, "red car"), (3, "red house red"), (4, "green tree"), (5, "blue sky")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "red apple")], "query_id long, question string")
    ranked = H.bm25_topk(q, chunks, H.bm25_index(chunks), 5).orderBy("rank").collect()
    assert ranked[0].chunk_id == 1 and ranked[0].score == 1.0 and len(ranked) == 5 and ranked[-1].score == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "id long, embedding array<double>")
    assert G.l2_normalize(df.where("id = 1")).first().embedding == [0.6, 0.8]
    assert [r.reason for r in G.validate_embeddings(df, 2).orderBy("id").collect()] == [None, None, "null", "nan"]
    v = G.embed_texts(spark.createDataFrame([("a b a",), ("",)], "text string")).collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-9 and set(v[1].embedding) == {0.0}
    words = G.embed_words(spark.createDataFrame([(1, "a b a")], "k long, text string"), "k").first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(words.embedding, v[0].embedding, strict=True))


def test_answers(spark):
    t = "First line of the answer.\nshort\nFirst line of the\nvery very very good things [Source 2]\nQuestion: next"
    assert value(spark, J.clean_answers(F.lit(t))) == "First line of the answer.\nvery good things"
    assert value(spark, J.sanitize_text(F.lit("a\x00b\tc\n"))) == "ab\tc\n"
    assert value(spark, J.redact_secrets(F.lit("token = abc123 x"))) == "token = *** x"
    s = spark.createDataFrame([(1, 0, "The sky is blue. [Source 1]"), (1, 1, "Cats bark. [Source 9]"), (2, 0, "Alone.")], "query_id long, pos long, sentence string")
    src = spark.createDataFrame([(1, 1, "the sky is blue.")], "query_id long, source long, content string")
    got = {r.query_id: r for r in J.verify_answers(s, src).collect()}
    assert (got[1].supported, got[1].confidence, got[1].verified) == (1, 0.5, "The sky is blue. [Source 1]")
    assert got[2].confidence == 1.0


def test_code_elements(spark):
    assert value(spark, E.classify_code_element(F.lit("public enum EFooError { errA = 1 }"))) == "error_code"
    assert value(spark, E.classify_code_element(F.lit("int Count { get; set; }"))) == "property"
    params = value(spark, E.signature_params(F.lit("void F([in] Map<int, string> a, [out] long* b)")))
    assert [(p.direction, p.type, p.name) for p in params] == [("in", "Map<int, string>", "a"), ("out", "long*", "b")]
    assert value(spark, E.name_keywords(F.lit("GetHTMLPage"), F.lit("create it"))) == ["get", "html", "page", "create"]
    sig = E.reconstruct_signature(spark.createDataFrame([("intro\nlong F(int a,\n  int b)\nmore",)], "content string")).first()
    assert sig.signature == "long F(int a, int b)"


def test_manuals(spark):
    assert value(spark, M.heading_level(F.lit("Heading 3"))) == 3 and value(spark, M.heading_level(F.lit("Title"))) == 0
    assert value(spark, M.interface_name(F.lit("Functions"), loose=True)) == "ions" and value(spark, M.interface_name(F.lit("Functions:"))) == "Functions"
    assert tuple(value(spark, M.parse_code_value(F.lit("0x80070057")))) == (0x80070057, None)
    assert tuple(value(spark, M.property_name(F.lit("Count [long i] of items")))) == ("Count", "of items")
    rows = spark.createDataFrame([(1, 0, "", "x", ""), (1, 1, "long", "F(", "d"), (1, 2, "", "int a)", "e")], "table_id long, row_idx long, c0 string, c1 string, c2 string")
    (one,) = M.merge_continuation_rows(rows).collect()
    assert (one.c0, one.c1, one.c2) == ("long", "F(\nint a)", "d\ne")


def test_links(spark):
    ranked = spark.createDataFrame([(1, 1, 0, 0.9), (1, 1, 1, 0.5)], "query_id long, doc_id long, chunk_index long, score double")
    edges = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 1, 0), (1, 0, 6), (1, 0, 7)], "doc_id long, chunk_index long, target long")
    got = GR.expand_with_links(ranked, edges, factor=2).orderBy(F.desc("score"), "chunk_index").collect()
    assert [(r.chunk_index, r.score) for r in got] == [(0, 0.9), (5, 0.765), (6, 0.765), (1, 0.5)]


def test_rate_limit_counts_accepted_requests(spark):
    rows = [(i, 1, "view", i * 10.0) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s double").withColumn("ts", F.col("s").cast("timestamp"))
    got = [r.accepted for r in jobs.rate_limit(df, limit=2, seconds=30).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False, False]  # one exactly 30 s old still counts


def test_engines_and_embedders(spark):
    text = "\n".join(f"line {i} of a text" for i in range(90))
    docs = spark.createDataFrame([(1, text, "recursive"), (2, text, "token_window"), (3, text, "else"), (4, text, None)], "doc_id long, text string, engine_type string")
    got = {k: [r.content for r in C.chunk_by_engine(docs).where(f"doc_id = {k}").orderBy("chunk_index").collect()] for k in (1, 2, 3, 4)}
    assert got[1] == got[3] == got[4] and got[1] != got[2] and len(got[2]) > 1
    lengths = G.embed_texts(docs, embedder=lambda t: F.array(F.length(t) * 1.0, F.lit(0.0)))
    assert {tuple(r.embedding) for r in lengths.collect()} == {(1.0, 0.0)}


def test_dense_scores_skips_unsound_queries(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [2.0])], "chunk_id long, embedding array<double>")
    assert sorted((r.query_id, r.chunk_id, r.score) for r in G.flat_ip_topk(q, c, 1).collect()) == [(1, 2, 1.0), (4, 3, 2.0)]
    words = G.embed_words(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k long, text string"), "k").collect()
    assert len(words) == 3 and {tuple(set(r.embedding)) for r in words if r.k > 1} == {(0.0,)}


def test_index_keeps_other_documents(spark):
    from gleaner.session import scratch_path
    from gleaner.sources import specs

    path = scratch_path(spark, "test-index")
    specs.persist_index(spark.range(100).selectExpr("id AS chunk_id", "'a' AS term"), path)
    specs.persist_index(spark.createDataFrame([(7, "b"), (7, "c"), (200, "b")], "chunk_id long, term string"), path)
    rows = specs.load_index(spark, path).collect()
    assert len(rows) == 102 and {r.term for r in rows if r.chunk_id == 7} == {"b", "c"} and {r.chunk_id for r in rows} == {*range(100), 200}


def test_yaml_specs_and_other_rows(spark):
    pytest.importorskip("yaml")
    from gleaner.sources import specs

    text = """openapi: 3.0.0
paths:
  /a:
    get:
      operationId: one
      parameters: [{name: x}]
      responses: {200: {description: ok}}
    x-note: {}
"""
    rows = spark.createDataFrame([(1, text), (2, '{"swagger": "2.0", "paths": {"/b": {"put": {}}}}'), (3, "a: [b"), (4, "{}"), (5, None), (6, "")], "spec_id long, spec string")
    got = {r.spec_id: r for r in specs.openapi_endpoints(rows).collect()}
    assert set(got) == {1, 2}
    assert (got[1].operation_id, got[1].parameters, got[1].responses, got[1].request_body) == ("one", ['{"name":"x"}'], ["200"], None)
    assert (got[2].operation_id, got[2].parameters, got[2].responses) == ("put_/b", [], [])


def test_missing_sources(spark):
    from gleaner.sources import specs

    sets = spark.createDataFrame([(1, '{"version": "1", "questions": [{"id": "q", "document": "d", "expected_sources": ["in it", "not"]}, {"id": "r", "document": "other", "expected_sources": ["x"]}]}')], "set_id long, json string")
    docs = spark.createDataFrame([("d", "this is in it")], "document string, content string")
    assert {r.question_id: r.missing_sources for r in specs.load_eval_dataset(sets, docs).collect()} == {"q": ["not"], "r": []}


DOC = "doc_id long, text string"


def test_ingest_replaces_and_keeps_failures(spark):
    out, path = scratch_path(spark, "ingest"), scratch_path(spark, "in")
    long = "word " * 30
    for rows in ([(1, long), (2, long), (3, None), (None, long)], [(1, "other " * 30), (3, long)]):
        spark.createDataFrame(rows, DOC).write.mode("append").parquet(path)
        jobs.ingest(spark.readStream.schema(DOC).parquet(path), C.chunk_token_window, out)
    got = {r.doc_id: r for r in jobs.ingested(spark, out).collect()}
    assert jobs.ingested(spark, out).count() == 3 and got[1].content.startswith("other") and got[2].content.startswith("word")
    assert {r.status for r in got.values()} == {"completed"}  # document 3 has come again with a text
    assert [r.text for r in spark.read.parquet(f"{out}/rejected").collect()] == [long]


def test_ingest_tries_a_batch_three_times(spark):
    out, path = scratch_path(spark, "ingest"), scratch_path(spark, "in")
    spark.createDataFrame([(1, "word " * 30)], DOC).write.parquet(path)

    def chunker(docs, broken):
        return C.chunk_token_window(docs).withColumn("content", F.when(F.lit(broken), F.raise_error(F.lit("broken"))).otherwise(F.col("content")))

    jobs.ingest(spark.readStream.schema(DOC).parquet(path), lambda d: chunker(d, True), out)
    (row,) = jobs.ingested(spark, out).collect()
    assert (row.doc_id, row.status, row.content) == (1, "failed", None) and row.error


def test_tasks_live_on_over_batches(spark):
    out, path = scratch_path(spark, "tasks"), scratch_path(spark, "in")
    schema = "event_id long, user_id long, ts timestamp"
    rows = [(i, i % 3, 60.0 * i) for i in range(200)]
    parts = []
    for part in (rows[:90], rows[90:150], rows[150:]):
        df = spark.createDataFrame(part, "event_id long, user_id long, s double").select("event_id", "user_id", F.col("s").cast("timestamp").alias("ts"))
        df.write.mode("append").parquet(path)
        parts.append(df)
        jobs.expire_tasks_stream(spark.readStream.schema(schema).parquet(path), out, hours=2, per_user=30, most=70)
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        want = {r.event_id for r in jobs.expire_tasks(whole, hours=2, per_user=30, most=70).collect()}
        assert {r.event_id for r in jobs.newest_table(spark, out).collect()} == want and len(want) == 70


def test_dedup_prefers_a_vector(spark):
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 1, "a", [2.0]), (1, 2, "a", [3.0]), (1, 3, "b", None)], "doc_id long, chunk_index long, content string, embedding array<double>")
    assert {(r.content, r.chunk_index, tuple(r.embedding or ())) for r in C.dedup_chunks_exact(rows).collect()} == {("a", 0, (2.0,)), ("b", 3, ())}


def test_documents_without_vectors(spark):
    from gleaner.sources import specs

    path = scratch_path(spark, "documents")
    nodes = spark.range(3).selectExpr("id AS doc_id", "0L AS chunk_id", "'t' AS content")
    terms = nodes.selectExpr("doc_id", "chunk_id", "'t' AS term", "1L AS tf")
    specs.persist_documents(path, nodes, terms, nodes.selectExpr("doc_id", "chunk_id", "array(1D) AS embedding").where("false"))
    found, posted = specs.load_documents(spark, path)
    assert [r.embedding for r in found.collect()] == [None] * 3 and posted.count() == 3


def test_documents_are_made_once(spark):
    """no part is made again for its ids or for a sample of its keys; an empty write does no harm."""
    from gleaner.sources import specs

    path, made = scratch_path(spark, "documents"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    counting = lambda df: df.mapInArrow(counted, df.schema)
    nodes = spark.range(0, 30, 1, 3).selectExpr("id % 10 AS doc_id", "id AS chunk_id", "'t' AS content")
    terms, vectors = nodes.selectExpr("doc_id", "chunk_id", "'t' AS term", "1L AS tf"), nodes.selectExpr("doc_id", "chunk_id", "array(1D) AS embedding")
    specs.persist_documents(path, counting(nodes), counting(terms), counting(vectors))
    assert made.value == 90
    for again in ("doc_id = 3", "false"):
        specs.persist_documents(path, nodes.where(again), terms.where(again), vectors.where("false"))
    found, posted = specs.load_documents(spark, path)
    assert sorted((r.doc_id, r.embedding is None) for r in found.collect()) == sorted((i % 10, i % 10 == 3) for i in range(30)) and posted.count() == 30


def test_camel_tokens_cut_at_capitals(spark):
    """one pass cuts where the two rules one after the other do."""
    import random
    import re

    from gleaner.functions.text import blank, camel_tokens

    rng = random.Random(7)
    texts = ["", " ", "HTTPServerError2Go", "aBcD9E", "\u00c9Ab\u00e9B"] + ["".join(rng.choices("aZ9B b\n\u00c4\u00df_", k=12)) for _ in range(400)]
    two = lambda t: re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", t)).lower().split()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", camel_tokens("t").alias("w"), blank("t").alias("b")).collect()
    assert [(r.w, r.b) for r in rows] == [(two(r.t), not r.t.strip()) for r in rows]


def test_lines_are_packed_where_they_stand(spark, sf):
    """as by a plain loop, for too few and too many lines, long lines, null texts and a doc_id in several rows; no group of rows goes to Python."""
    import random

    import __spark_entry__

    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(["a", "bb", "\u00e9"], k=rng.choice([0, 1, 2, 3, 9])))
    docs = [(i, "\n".join(f" {line()}\t" for _ in range(rng.choice([1, 3, 5, 12, 20])))) for i in range(60)] + [(60, None), (61, " \n ")]

    def loop(text):
        parts = [p.strip() for p in (text or "").split("\n") if p.strip()]
        if not 4 <= len(parts) <= 15:
            return ["\n\n".join(parts)] if parts else []
        out, room = [], 0
        for p in parts:
            n = len(p.split())
            if not out or room < n:
                out.append([])
                room = 6
            out[-1].append(p)
            room -= n
        return ["\n\n".join(g) for g in out]

    want = sorted((d, i, c) for d, t in docs for i, c in enumerate(loop(t)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    packed = lambda df: sorted(map(tuple, df.collect()))
    assert packed(C.pack_lines(frame(docs), 6, 4, 15)) == packed(C.pack_paragraphs(C.lines(frame(docs)), 6, 4, 15)) == want
    twice = docs + docs[:1]
    assert packed(C.pack_lines(frame(twice), 6, 4, 15)) == packed(C.pack_paragraphs(C.lines(frame(twice)), 6, 4, 15))
    plan = __spark_entry__.queries()["pack_paragraphs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning" not in plan


def test_param_claims(spark):
    known = F.array(F.lit("Size"), F.lit("a.b"), F.lit("über"))
    claims = lambda text, k=None: value(spark, J.find_param_claims(F.lit(text), k))
    assert claims('the parameter is required; use the `foo` parameter and property value "unrelated"') == ["foo"]
    assert claims('`a` Param, parameter "b", "c" parameter; the "d" parameter. param `e` `f` parameters `g`param') == ["a", "b", "c", "d", "e"]
    assert claims('`size`, "A.B" and `Über` or "sizes"', known) == ["A.B", "size", "Über"]
    assert claims('`size` and "x"') == [] and claims("`" + "n" * 101 + "` parameter") == []
    assert claims("x" * 9_990 + " `late` parameter") == [] and claims(None) is None
    assert claims("`size`", F.lit(None).cast("array<string>")) == []


@pytest.mark.parametrize("seed", range(3))
def test_impact_blocks_give_the_exhaustive_lists(spark, seed):
    """Tiny blocks and parts; frequent words (whose weights are negative in a small corpus), ties, repeated query words."""
    import random

    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    often = sorted(vocabulary, key=lambda _: rng.random())
    text = lambda n: " ".join(rng.choices(often, weights=[1 / (i + 1) for i in range(30)], k=n))
    chunks = spark.createDataFrame([(i, text(rng.randint(1, 25)) if i % 9 else None) for i in range(120)], "chunk_id long, content string")
    queries = spark.createDataFrame([(i, text(rng.randint(1, 6)) if i % 7 else "unknown") for i in range(25)], "query_id long, question string")
    index = H.bm25_index(chunks)
    saved = H.blocks_of(H.impact_blocks(index, block=2, part=8))
    for k in (1, 3, 200):
        whole, pruned = (sorted(map(tuple, H.top_k(s, k).collect())) for s in (H.bm25_scores(queries, index), H.pruned_scores(queries, saved, k)))
        assert whole == pruned
    rows = saved.blocks.collect()
    assert max(len(r.hits) for r in rows) == 2 and max(r.part for r in rows) > 0
    opened = H.opened_blocks(queries, saved, 1).hits.count()
    every = H._asked(queries, H.camel_tokens).join(saved.blocks, "term").count()
    assert opened < every


def test_rows_are_counted_where_they_stand(spark):
    df = spark.createDataFrame([("a", "x y x"), ("b", None), ("c", ""), (None, "y")], "chunk_id string, content string")
    assert sorted(map(repr, map(tuple, H.postings(df).collect()))) == sorted(map(repr, [("a", "x", 2, 3), ("a", "y", 1, 3), (None, "y", 1, 1)]))
    vectors = {r.chunk_id: r.embedding for r in G.embed_words(df, "chunk_id", "content").collect()}
    plain = {r.chunk_id: r.embedding for r in G.embed_texts(df.fillna({"content": ""}), "content").collect()}
    assert vectors == plain and set(vectors["b"]) == {0.0}


@pytest.mark.parametrize("by", [None, "owner"])
def test_lists_are_visited_by_bound(spark, by):
    """Clustered vectors in small lists: equal to all products, and most pairs are never scored; text ids, ties, equal rows."""
    import numpy as np

    from gleaner.operators import dense

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(f"c{i:04}", (centres[i % 40] + 0.1 * rng.normal(size=8)).round(3).tolist(), "xyz"[i % 3]) for i in range(2000)]
    rows += [(f"d{i:04}", rows[0][1], "x") for i in range(300)] + [("bad", [1.0, None] + [0.0] * 6, "x"), ("none", None, "y"), ("short", [1.0], "z")]
    asked = [(i, (centres[i] + 0.1 * rng.normal(size=8)).tolist(), "xyz"[i % 3]) for i in range(30)] + [(99, rows[0][1], "x")]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, owner string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, owner string")
    lists = materialise(dense.vector_lists(chunks, by, rows=50), "lists")
    found = dense.search(queries, lists, 5, by, least=True)
    products = {q: {c: round(float(np.dot(v, e)), 6) for c, e, o in rows[:2300] if not by or o == owner} for q, v, owner in asked}
    want = {(q, c, s) for q, own in products.items() for c, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert {(r.query_id, r.chunk_id, r.score) for r in found.hits.collect()} == want
    assert {(r.query_id, r.least) for r in found.least.collect()} == {(q, min(own.values())) for q, own in products.items()}
    assert max(r.n for r in lists.collect()) <= 50
    scored = dense.search(queries, lists, 5, by).pairs.agg(F.sum("n").alias("n")).first().n
    assert scored < 0.35 * sum(map(len, products.values()))
    assert dense.search(queries.where("1 = 0"), lists, 5, by).hits.count() == 0
    nothing = materialise(dense.vector_lists(chunks.where("1 = 0"), by), "lists")
    assert dense.search(queries, nothing, 5, by).hits.count() == 0


def test_one_raising_row_fails_alone(spark):
    """One text of 1 000 makes the embedder raise: 999 documents stand, it has failed after three spaced tries."""
    import time

    out, path = scratch_path(spark, "ingest"), scratch_path(spark, "in")
    spark.createDataFrame([(i, f"text {i} " + "word " * 30) for i in range(1000)], DOC).write.parquet(path)

    def embedder(texts):
        if texts.str.startswith("text 77 ").any():
            raise ValueError("no vector")
        return texts.map(lambda t: [float(len(t))])

    vector = jobs.guarded(embedder, "array<double>")
    embed = lambda chunks: chunks.withColumn("_v", vector("content")).withColumns({"embedding": F.col("_v.value"), "error": F.col("_v.error")}).drop("_v")
    began = time.perf_counter()
    jobs.ingest(spark.readStream.schema(DOC).parquet(path), C.chunk_token_window, out, embed, wait=0.5)
    assert time.perf_counter() - began > 1.5
    rows = jobs.ingested(spark, out).collect()
    assert len({r.doc_id for r in rows if r.status == "completed" and len(r.embedding) == 1}) == 999
    assert [(r.doc_id, r.error, r.content) for r in rows if r.status == "failed"] == [(77, "ValueError: no vector", None)]
    letters = spark.read.parquet(f"{out}/dead-letters").collect()
    assert sorted((r.doc_id, r.attempt) for r in letters) == [(77, 1), (77, 2), (77, 3)]


def test_a_row_that_breaks_the_job_is_found(spark):
    out, path = scratch_path(spark, "ingest"), scratch_path(spark, "in")
    spark.createDataFrame([(i, "word " * 30) for i in range(40)], DOC).write.parquet(path)

    def chunker(docs):
        return C.chunk_token_window(docs).withColumn("content", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))

    jobs.ingest(spark.readStream.schema(DOC).parquet(path), chunker, out, attempts=1)
    assert {(r.doc_id, r.status) for r in jobs.ingested(spark, out).collect()} == {(i, "failed" if i == 7 else "completed") for i in range(40)}


def test_keyed_streams_over_batches_with_a_hot_key(spark):
    """State goes from batch to batch; a key with most rows streams through; answers are those of the batch twins."""
    path, outs = scratch_path(spark, "in"), [scratch_path(spark, n) for n in ("limits", "replays")]
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id") % 97).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 0.7).cast("timestamp").alias("ts"))
    for lo, hi in ((0, 20_000), (20_000, 20_010), (20_010, 60_000)):
        rows.where(f"event_id >= {lo} and event_id < {hi}").write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.rate_limit_stream(stream, outs[0], limit=5, seconds=60)
        jobs.cache_replay_stream(stream.withColumn("key", F.col("user_id")), outs[1], 100)
    twins = jobs.rate_limit(rows, 5, 60), jobs.cache_replay(rows.withColumn("key", F.col("user_id")), 100)
    for out, twin in zip(outs, twins, strict=True):
        assert jobs.answered(spark, out).exceptAll(twin).isEmpty() and jobs.answered(spark, out).count() == 60_000
        states = spark.read.parquet(f"{out}/states")
        assert states.select("batch").distinct().count() <= 2 and states.agg(F.max(F.size("kept")).alias("n")).first().n <= 5


def test_progress_is_merged(spark, monkeypatch):
    monkeypatch.setattr(jobs, "MERGED", 2)
    path, out = scratch_path(spark, "in"), scratch_path(spark, "progress")
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    for n in range(5):
        spark.createDataFrame([(n * 10 + u, u, f"e{n}", float(n)) for u in range(n, 6)], "event_id long, user_id long, event_type string, s double").select("event_id", "user_id", "event_type", F.col("s").cast("timestamp").alias("ts")).write.mode("append").parquet(path)
        jobs.progress(spark.readStream.schema(schema).parquet(path), out)
        assert len(jobs._batches(spark, out)) <= 3
    assert {(r.user_id, r.event_type) for r in jobs.latest(spark, out).collect()} == {(u, f"e{min(u, 4)}") for u in range(6)}


def test_index_takes_single_documents(spark):
    """A write costs what it brings; old rows give way by key; what an unfinished write left isn't read; segments are few."""
    import pathlib

    from gleaner.sources import segments, specs

    path = scratch_path(spark, "index")
    folder = pathlib.Path(path.removeprefix("file:"))
    size = lambda: {f: f.stat().st_size for f in folder.rglob("*.parquet")}
    specs.persist_index(spark.range(20_000).select(F.expr("id div 2").alias("chunk_id"), F.md5(F.col("id").cast("string")).alias("v")), path)
    first = size()
    want = {(i // 2): None for i in range(20_000)}
    for i in (5, 6, 5, 7, 8, 9):
        specs.persist_index(spark.createDataFrame([(i, f"new {i}"), (None, "x")], "chunk_id long, v string"), path)
    now = size()
    assert all(now[f] == n for f, n in first.items())  # untouched
    assert sum(n for f, n in now.items() if f not in first) < 0.05 * sum(first.values())
    assert len(segments.numbers(spark, path)) <= 4
    specs.persist_index(spark.createDataFrame([], "chunk_id long, v string"), path, replaced=spark.createDataFrame([(5,), (99,)], "chunk_id long"))
    spark.createDataFrame([(6, "never")], "chunk_id long, v string").write.parquet(f"{path}/rows/segment=77")  # lost before its keys
    rows = specs.load_index(spark, path).collect()
    assert len(rows) == 20_000 - 2 * 5 + 5 - 1 - 2 and {r.v for r in rows if r.chunk_id in (5, 6, 7, 99)} == {"new 6", "new 7"}
    segments.compact(spark, path, "chunk_id")
    assert len(segments.numbers(spark, path)) == 1 and sorted(map(tuple, specs.load_index(spark, path).collect())) == sorted(map(tuple, rows))


def test_method_tables(spark):
    def functions(*rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "table_id long, row_idx int, c0 string, c1 string, c2 string")
        return [(r.name, r.return_type, [(p.name, p.type, p.description) for p in r.params], r.description) for r in M.method_functions(df).orderBy("position").collect()]

    assert functions(("", "", ""), ("void", "FuncA()", ""), ("", "", ""), ("", "lost", "x"), ("int", "FuncB()", None)) == [("FuncA", "void", [], ""), ("FuncB", "int", [], "")]
    assert functions(("void", "DoWork(double x)", ""), ("", "x", "The X coordinate"), ("", "Extra detail", ""), ("", "x", "again")) == [("DoWork", "void", [("x", "double", "The X coordinate")], "Extra detail")]
    assert functions(("long", "Get_vb(Visual Basic compatible function of Get)", "gone"), ("", "More", "text")) == [("Get_vb", "long", [], "VB-compatible alias for Get More text")]
    assert functions(("long", "Plain\nrest", ""), ("", "", "says nothing")) == [("Plain", "long", [], "rest")]


def test_repeated_suffixes_and_concise_answers(spark):
    import random
    import time

    def slow(t):
        return max((n for n in range(30, len(t) - len(t) // 3) if t[-n:] in t[:-n]), default=0)

    rng = random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choices("ab ", k=rng.randint(1, 45)))
        t = "".join(rng.choices("abc ", k=rng.randint(0, 80))) + piece * rng.randint(1, 6) + "".join(rng.choices("ab", k=rng.randint(0, 3)))
        assert J.repeated_suffix(t) == slow(t), t
    began = time.perf_counter()
    assert J.repeated_suffix("ab" * 100_000) == 100_000
    assert time.perf_counter() - began < 3
    said = "The server answers with a token that is valid for an hour. "
    clean = lambda t, **o: value(spark, J.clean_answers("t", **o), t=t)
    answers = spark.createDataFrame([(1, "First. " + said * 4), (2, None), (3, "short text")], "k long, t string")
    cut = J.drop_repeated_suffix(answers.select("k", J.clean_answers("t").alias("t")), "t")
    got = {r.k: r.t for r in cut.collect()}
    assert got[1] == ("First. " + said).strip() and set(got) == {1, 2, 3}
    assert clean("One is this. Two is that. Three is not", length="concise") == "One is this. Two is that."
    assert clean("One is this. Two is that.", length="concise") == "One is this. Two is that." and clean("no sentence here", length="concise") == "no sentence here"
    assert clean("One is this. Two is", length="detailed") == "One is this. Two is"


def test_nested_elements(spark):
    schema = "doc_id long, element_id string, parent_id string, ord long, content string"
    rows = [(1, "r", None, 0, "doc"), (1, "b", "r", 2, "B"), (1, "a", "r", 1, "A"), (1, "a2", "a", 5, "A2"), (1, "a1", "a", 5, "A1"), (1, "x", "lost", 0, "X"), (1, "c", "d", 0, "circle"), (1, "d", "c", 0, "circle"), (2, "r", None, 0, "two")]
    got = [(r.doc_id, r.pos, r.depth, r.content) for r in C.flatten_elements(spark.createDataFrame(rows, schema)).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 0, "doc"), (1, 1, 1, "A"), (1, 2, 2, "A1"), (1, 3, 2, "A2"), (1, 4, 1, "B"), (2, 0, 0, "two")]
    assert C.flatten_elements(spark.createDataFrame([], schema)).count() == 0


def test_class_metrics_make_no_pairs(spark):
    """Chunks of the query's class are relevant: the metrics of all pairs, but no row for a pair."""
    from gleaner.operators import evaluation

    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "query_id long, label string")
    c = spark.range(600).selectExpr("id AS chunk_id", "CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS label")
    ranked = spark.createDataFrame([(i, j, r) for i in (1, 2, 3, 4) for r, j in enumerate((3, 5, 8, 9), 1)], "query_id long, chunk_id long, rank int")
    pairs = q.join(c, "label").select("query_id", "chunk_id")
    own = evaluation.class_precision_recall_mrr(ranked, q, c, "label", 3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(own) == rows(evaluation.precision_recall_mrr(ranked, pairs, q, 3))
    assert rows(own)[0] == (1, 0.333333, 0.006667, 0.333333)


def test_texts_and_vectors_read_once(spark):
    """Without an index or lists: the same k best, whatever the lots; copies and ties go to smaller ids."""
    texts = [None, "", *(" ".join(f"w{(i * j) % 13}" for j in range(1 + i % 9)) for i in range(200)), *["w1 w2 same"] * 40]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(5)
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w5 nowhere"), (3, "w0 w3 same"), (4, "none"), (5, None)], "query_id long, question string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = H.bm25_index(chunks)
    for k in (1, 7, 300):
        assert rows(H.bm25_topk(queries, chunks, H.Texts(chunks), k)) == rows(H.bm25_topk(queries, chunks, index, k))
        few = H.scanned_scores(queries, chunks, k, most=4)
        assert rows(H.top_k(few, k)) == rows(H.top_k(H.bm25_scores(queries, index), k))
    n = few.rdd.getNumPartitions()
    assert H.scanned_scores(queries, chunks, 2).groupBy("query_id").count().where(f"count > {2 * 40 * n}").count() == 0
    q, c = G.embed_words(queries, "query_id", "question"), G.embed_words(chunks, "chunk_id", "content")
    for k in (1, 7):
        assert rows(G.scanned_topk(q, c, k)) == rows(G.flat_ip_topk(q, c, k))


def test_many_questions_are_compared_by_classes(spark):
    """Rare terms by a join, common ones by classes of questions and of texts, equal vectors once: the same k best."""
    texts = [None, "", *(" ".join(f"w{(i * j) % 13}" for j in range(1 + i % 9)) + f" own{i // 2}" for i in range(120)), *["w1 w2 same"] * 40, "own3 own3 w1", "own7"]
    chunks = spark.createDataFrame([(j * 37 % 1000, t) for j, t in enumerate(texts)], "chunk_id long, content string").repartition(5)
    asked = [(i, f"own{i} w{i % 3} w{i % 2 + 1}") for i in range(40)] + [(100, "w1 w2 w2"), (101, "w5 nowhere"), (102, "none"), (103, None), (104, "w0 w3 same"), (105, "same own3 own3")]
    queries = spark.createDataFrame(asked, "query_id long, question string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = H.bm25_index(chunks).cache()
    for k, rare, most in ((1, 3, 4), (7, 64, 1 << 18), (7, 0, 1 << 18)):
        got = H.grouped_scores(queries, chunks, k, rare=rare, most=most)
        assert rows(H.top_k(got, k)) == rows(H.top_k(H.bm25_scores(queries, index), k))
    assert rows(H.bm25_topk(queries, chunks, H.Texts(chunks, many=True), 7)) == rows(H.bm25_topk(queries, chunks, index, 7))
    negative = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "a")], "chunk_id long, content string")  # all weights under zero
    ask = spark.createDataFrame([(1, "a b c"), (2, "b")], "query_id long, question string")
    assert rows(H.top_k(H.grouped_scores(ask, negative, 2), 2)) == rows(H.top_k(H.bm25_scores(ask, H.bm25_index(negative)), 2))
    q, c = G.embed_words(queries, "query_id", "question"), G.embed_words(chunks, "chunk_id", "content")
    for k in (1, 7):
        assert rows(G.scanned_topk(q, c, k, alike=True)) == rows(G.flat_ip_topk(q, c, k))


def test_single_precision_only_leaves_out():
    """Products that differ by less than single precision tells, huge ones, and all pairs above: those of doubles."""
    import numpy as np

    from gleaner.operators import scan

    rng = np.random.default_rng(5)
    for scale, spread in ((1.0, 1e-7), (1.0, 1.0), (1e-20, 1.0), (1e25, 1.0), (3e4, 1e-9)):
        q = (1 + spread * rng.normal(size=(30, 16))) * scale
        m = (1 + spread * rng.normal(size=(50, 16))) * scale
        exact = m @ q.T
        for floor in (np.median(exact, axis=0), np.full(30, -np.inf), exact.max(axis=0) * (1 - 1e-12)):
            beat = floor + 0.4e-6
            row, question, score = scan._Tile(np.arange(30), q).above(m, floor)
            sure = np.abs(exact - beat) > 1e-12 * np.abs(exact)
            got = np.zeros(exact.shape, bool)
            got[row, question] = True
            assert ((exact > beat) == got)[sure].all() and np.allclose(score, exact[row, question], rtol=1e-12, atol=0)


def test_windows_cut_a_text_once(spark):
    """Spark makes no condition of the windows that cuts the text again, once for each window; empty texts and least 0 as before."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, " \n "), (5, "x")], "doc_id long, text string")
    cut = C.chunk_token_window(docs, 3, 1, 0)
    assert sorted(map(tuple, cut.collect())) == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e"), (4, 0, ""), (5, 0, "x")]
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_ingest_deals_one_file_to_all_cores(spark, monkeypatch):
    """A batch of one file is cut by all cores, and rows without a failure aren't joined with failures."""
    out, path = scratch_path(spark, "ingest"), scratch_path(spark, "in")
    spark.range(64).selectExpr("id AS doc_id", "repeat('some words of a text ', 5) AS text").coalesce(1).write.parquet(path)
    parts, shuffled, own = {}, [], jobs.materialise

    def seen(df, name):
        parts[name] = df.rdd.getNumPartitions()
        return own(df, name)

    def persisted(rows, *rest):
        shuffled.append("Join" in rows._jdf.queryExecution().toString())
        return persist(rows, *rest)

    persist = jobs.persist_index
    monkeypatch.setattr(jobs, "materialise", seen)
    monkeypatch.setattr(jobs, "persist_index", persisted)
    jobs.ingest(spark.readStream.schema(DOC).parquet(path), C.chunk_token_window, out)
    assert jobs.ingested(spark, out).where("status = 'completed'").count() == 64
    assert min(parts["ingest-batch"], parts["ingest-tried"]) >= spark.sparkContext.defaultParallelism and shuffled == [False]


def test_few_needles_cut_no_text_into_runs(spark):
    """The texts are read once by an automaton; no run of words is exploded, joined or shuffled."""
    from gleaner.operators import evaluation

    chunks = spark.createDataFrame([(1, "a b c d e f g h"), (2, "xa b c d e f g hy"), (3, None), (4, "b c")], "chunk_id long, content string")
    needles = spark.createDataFrame([(7, "a b c d e f g h"), (8, "b c"), (9, ""), (10, None)], "query_id long, expected string")
    found = evaluation.label_relevant(chunks, needles)
    assert sorted(map(tuple, found.collect())) == [(7, 1), (7, 2), (8, 1), (8, 2), (8, 4)]
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_kept_postings_need_no_weights(spark, sf, monkeypatch):
    """load_index keeps terms and their times; weights, which take a join of all postings, aren't made for it."""
    from gleaner.plans import jobs as plans

    monkeypatch.setattr(plans.H, "bm25_index", None)
    assert plans.load_index(spark, sf).where("tf < 1 or term is null").count() == 0

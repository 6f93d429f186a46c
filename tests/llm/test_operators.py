"""Every operator against a brute-force version, an exact round trip or held-out accuracy; edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import chunkprint, hamming, hilbert, langid, maintext, packing, piecebpe, queries, simhash, tokenfiles, toxicity, warc, wordbpe
from gleaner.llm.components import components
from gleaner.session import scratch_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with results."""
    rows = [
        (1, None, "en", None, None, "x", None),
        (2, "", None, "s", 0, None, None),
        (3, "one two", "en", "s", 7, None, None),
        (None, "a row without id", None, None, None, None, None),
        (4, "word " * 30_000, "en", "s", 1, None, None),
        (5, "x" * 50_000, "de", "s", 1, None, None),
        (6, "same text twice here", "en", "s", 1, None, None),
        (6, "same text twice here", "en", "s", 1, None, None),
        (7, "same text twice here", "en", "s", 1, None, None),
        (8, "1234 !!! ☃ \U0001f600", "fr", "s", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(df):
    return df.where("1 = 0")


# -- op1 ---------------------------------------------------------------------


def pages(spark):
    big = "<p>" + "text " * 40 + "</p>"
    rows = [(5, "http://a", big, "q"), (2, "http://b\r\nx", big, "q"), (9, None, big, None), (None, "http://c", big, "q"), (1, "u", "short", "q"), (3, "u", "short", "q"), (4, "u", None, "q"), (7, "u", big * 3000, "q"), (2, "http://b", big, "q")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_warc_round_trip(spark):
    warc.register(spark)
    for level in ("1", "0"):
        path = scratch_path(spark, "test-warc")
        warc.page_records(pages(spark)).write.format("warc").option("level", level).option("roll", "1000").mode("append").save(path)
        df = spark.read.format("warc").option("split", "2000").load(path)
        got = df.select(warc.page_id("record_id").alias("id"), "record_type", warc.page_id("refers_to").alias("to"), "payload", "payload_length").collect()
        assert len(got) == 9
        big = ("<p>" + "text " * 40 + "</p>").encode()
        assert sorted((r.id or 0, r.to) for r in got if r.record_type == "revisit") == [(0, 2), (5, 2), (9, 2)]
        assert sorted(r.id for r in got if r.record_type == "response") == [1, 2, 2, 3, 4, 7]
        assert all(r.payload == big for r in got if r.record_type == "response" and r.id == 2)
        assert {r.payload_length for r in got if r.record_type == "revisit"} == {len(big)}
        plan = df.where("record_type = 'revisit' and target_uri like 'http://a%'")
        assert [r.target_uri for r in plan.collect()] == ["http://a"]


def test_warc_query(spark, sf):
    rows = queries.op1_warc(spark, sf).collect()
    src = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    assert {r.page_id for r in rows} == set(src) and len(rows) == len(src)
    first: dict = {}
    for k in sorted(src):
        first.setdefault(src[k], k)
    for r in rows:
        body = src[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = len(body) >= 100 and first[body] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if revisit else ("response", None))


def test_warc_skips_payloads():
    """A record that is filtered out is stepped over: its payload is never inflated."""
    rec = {"record_type": "response", "record_id": "<urn:page:1>", "date": "d", "target_uri": None, "refers_to": None, "payload_digest": None, "payload_length": None, "payload": b"x" * 1_000_000}
    raw = warc.member(warc.record(rec), 1)
    broken = raw[:2000] + b"\xff" * (len(raw) - 2000)  # inflating the rest would fail
    import io

    good = warc.member(warc.record({**rec, "record_type": "revisit", "payload": None, "record_id": "<urn:page:2>"}), 1)
    got = list(warc.records(warc.Source(io.BytesIO(broken + good)), [warc.EqualTo(("record_type",), "revisit")]))
    assert [r["record_id"] for r, *_ in got] == ["<urn:page:2>"]


def test_warc_foreign_archives():
    """Header names in any case; payload=false reads no more than headers; records begin before a stop."""
    import gzip
    import io

    http = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"
    plain = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:page:1>\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    for raw in (plain * 3, gzip.compress(plain) * 3):
        for payload in (True, False):
            got = list(warc.records(warc.Source(io.BytesIO(raw)), payload=payload))
            assert [(r["record_type"], n, body) for r, _, n, body in got] == [("response", 5, b"hello" if payload else None)] * 3
    assert len(list(warc.records(warc.Source(io.BytesIO(plain * 3)), stop=len(plain) + 1))) == 2


def test_warc_large_file_is_cut(spark):
    path = scratch_path(spark, "test-warc")
    warc.register(spark)
    rows = [(i, f"http://{i}", "".join(random.Random(i).choices("abcdefgh <>", k=3000)), "q") for i in range(60)]
    warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").coalesce(1)).coalesce(1).write.format("warc").mode("append").save(path)
    df = spark.read.format("warc").option("split", "9000").load(path)
    assert df.rdd.getNumPartitions() > 5
    assert sorted((r.record_id, r.payload.decode()) for r in df.collect()) == sorted((f"<urn:page:{i}>", h) for i, _, h, _ in rows)
    headers = spark.read.format("warc").option("payload", "false").load(path).collect()
    assert {(r.payload, r.payload_length) for r in headers} == {(None, 3000)}


def test_warc_empty_table(spark):
    path = scratch_path(spark, "test-warc")
    warc.register(spark)
    warc.page_records(empty(pages(spark))).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_sql_queries(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
        assert sorted(map(repr, map(plain, rel.fetchall()))) == sorted(repr(plain(r[c] for c in names)) for r in queries.queries()[name](spark, sf).collect())


# -- op2 ---------------------------------------------------------------------


def check_pieces(rows, ids_of, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, own in by_doc.items():
        lists = ids_of[doc]
        per = sorted(own, key=lambda r: r.start)
        copies = len(lists)
        at = 0
        for r in per[::copies]:
            assert r.start == at and r.doc_tokens == len(lists[0])
            assert r.ids_crc32 == zlib.crc32(np.array(lists[0][r.start : r.start + r.length], "<u4").tobytes())
            at += r.length
        assert copies > 1 or at == len(lists[0])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        if at & (at - 1):
            padding += capacity - at
    return padding


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(wordbpe.TOKENIZER))
    ids = {}
    for r in table(spark, sf, "documents").collect():
        ids.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = queries.op2_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(ids)
    assert check_pieces(rows, ids) == 0
    odd = packing.pack_documents(odd_docs(spark), public_tokenizers.path(wordbpe.TOKENIZER), window=5000).collect()
    assert sum(r.length for r in odd if r.doc_id == 1) == 1 and {None, 4, 5} < {r.doc_id for r in odd}
    assert packing.pack_documents(empty(odd_docs(spark)), public_tokenizers.path(wordbpe.TOKENIZER)).count() == 0


def test_packing_does_not_depend_on_the_order_of_rows(spark, sf):
    """What a task packs is the same in whatever order its rows come: a lost task is run again to the same pieces."""
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(5, docs[0].text), (None, "a"), (None, None), (5, docs[1].text)]
    got = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got.append(sorted(map(repr, packing.pack_documents(df, public_tokenizers.path(wordbpe.TOKENIZER), window=20_000).collect())))
    assert got[0] == got[1]


def test_fill_is_closest():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        space = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= space)
        chosen = packing.fill(counts, space)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


# -- op3, op7 ------------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.93
    assert got[got.predicted == 1].toxic.mean() > 0.9


def test_toxicity_learns_a_pair(spark):
    """Neither word alone is toxic; both together are: the linear part can't tell, the pair term can."""
    rng = random.Random(5)
    noise = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(noise, 5) + ["grumble"] * a + ["folks"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df.drop("toxic"), df)
    texts = ["grumble folks w1", "grumble w1 w2", "folks w3 w2", "w3"]
    s = machine.scores(texts)
    assert s[0] > 0.7 and max(s[1:]) < 0.7


def test_toxicity_score_by_a_double_loop(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=12)), int(rng.random() < 0.3)) for i in range(200)]
    machine = toxicity.fit(df := spark.createDataFrame(rows, "doc_id long, text string, toxic int"), df, telling=0.0)
    assert len(machine.terms) > 40
    for (_, text, _), got in zip(rows[:20], machine.scores([t for _, t, _ in rows[:20]]), strict=True):
        _, term = toxicity._terms([text])
        on = [i for i, t in enumerate(machine.terms) if t in set(term.tolist())]
        z = machine.bias + sum(machine.weights[i] for i in on)
        for i in on:
            for j in on:
                if i < j:
                    z += float(machine.factors[i] @ machine.factors[j])
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_toxicity_bounds_rows(spark, monkeypatch):
    """Ids with many texts: no more rows than max_fit are learned from; the largest of several labels counts, null labels don't."""
    seen = []
    learn = toxicity._learn
    monkeypatch.setattr(toxicity, "_learn", lambda rows, *a, **k: (seen.append(len(rows)), learn(rows, *a, **k))[1])
    docs = spark.createDataFrame([(i % 10, f"text {i} of {'bad' if i % 2 else 'good'} words") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(1, 0), (2, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, max_fit=20)
    assert seen == [20] and machine.scores(["bad words"])[0] > machine.scores(["good words"])[0]


def test_toxicity_edges(spark):
    docs, none = odd_docs(spark), spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(docs, none)
    rows = toxicity.predict(docs, machine).select("score", "predicted").collect()
    assert len(rows) == 10 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in rows)
    assert toxicity.predict(empty(docs), machine).count() == 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_langid(spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_language_is_out_of_place(spark):
    """The vectorised distances equal a plain count of out-of-place ranks."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.randint(0, 80))) for _ in range(30)]
    df = spark.createDataFrame([(t, rng.choice(["p", "q"])) for t in texts], "text string, lang string")
    profiles = langid.fit_profiles(df, size=20)

    def ranked(ts):
        grams: dict = {}
        for t in ts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                pad = f"\0{w}\0"
                for g in [*w, *(pad[i : i + 2] for i in range(len(pad) - 1)), *(pad[i : i + 3] for i in range(len(pad) - 2))]:
                    grams[g] = grams.get(g, 0) + 1
        return grams

    def code(g):
        c = [ord(x) for x in g] + [0, 0]
        key = {1: c[0], 2: c[0] | c[1] << 21 | 1 << 63, 3: c[0] | c[1] << 21 | c[2] << 42}[len(g)]
        return int(langid.mix(np.array([key], np.uint64))[0]) >> 64 - langid.BITS

    best, score = langid._Ranker(profiles, 20)(texts)
    names = [*profiles]
    assert all(profiles[n].tolist() == [code(g) for g, _ in sorted(ranked([r.text for r in df.where(df.lang == n).collect()]).items(), key=lambda x: (-x[1], code(x[0])))[:20]] for n in names)
    for t, b, s in zip(texts, best, score, strict=True):
        own = [code(g) for g, _ in sorted(ranked([t]).items(), key=lambda x: (-x[1], code(x[0])))[:20]]
        away = [sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for p in (profiles[n].tolist() for n in names)]
        if not own:
            assert (b, s) == (-1, 0)
        else:
            assert b == away.index(min(away)) and s == pytest.approx(1 - min(away) / (20 * len(own)))
    tie = langid._Ranker({"p": profiles["p"], "q": profiles["p"]}, 20)(["abc"])
    assert tie[0].tolist() == [0]  # equally near: the alphabetically first


def test_language_edges(spark):
    docs = odd_docs(spark)
    profiles = langid.fit_profiles(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, profiles).collect()}
    assert got[1] == got[2] == got[8] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de"
    assert {r.lang_pred for r in langid.predict(docs, langid.fit_profiles(empty(docs))).collect()} == {"und"}


# -- op4 ---------------------------------------------------------------------


def test_main_text(spark, sf):
    html = """<html><head><title>t</title><style>p{}</style></head><body><div class="site-header">Brand</div><ul class="menu"><li><a href="/">Home</a></li></ul>
    <div id="content"><h2>A heading</h2><p>First &amp; long paragraph of   text\nwith a <a href="#">link</a> in it.</p><p>Yes.</p><p>Another long paragraph, to be kept whole.</p>
    <div class="advert"><p>Buy now, a very long advert text that looks like content.</p></div></div><div class="comments"><p>A reader writes a long comment here.</p></div><form><p>Sign up</p></form><footer>c</footer></body></html>"""
    assert maintext.extract(html) == "A heading\n\nFirst & long paragraph of text with a link in it.\n\nYes.\n\nAnother long paragraph, to be kept whole."
    assert maintext.extract(None) == maintext.extract("") == maintext.extract("<script>var x</script>") == ""
    rows = queries.op4_maintext(spark, sf).collect()
    assert len(rows) == table(spark, sf, "pages").count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>a", 2), (1, "u", "<p>a", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted(r.text for r in maintext.extract_pages(odd).collect()) == ["", "a", "a"]
    assert maintext.extract_pages(empty(odd)).count() == 0


# -- op5 ---------------------------------------------------------------------


def chunk_by_loop(text: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(text):
        end = min(at + chunkprint.MOST, len(text))
        for i in range(at + chunkprint.LEAST, end):
            h = 0
            for b in (bytes(32) + text)[i : i + 32]:
                h = (h << 1) + int(chunkprint._GEAR[b]) & 0xFFFFFFFF
            if h >> (32 - (chunkprint.STRICT if i < at + chunkprint.NORMAL else chunkprint.LOOSE)) == 0:
                end = i
                break
        out.append(text[at:end])
        at = end
    return out


def test_chunks_match_a_loop():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcde \xc3\xa9") for _ in range(rng.randint(0, 900))) for _ in range(12)]
    joined, doc, begin, end = chunkprint.chunks(texts)
    for i, t in enumerate(texts):
        assert [joined[a:b] for d, a, b in zip(doc, begin, end, strict=True) if d == i] == chunk_by_loop(t)


def test_fingerprints(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted(queries.op5_fingerprint(spark, sf).collect())
    src = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert [r.doc_id for r in rows] == [k for k, _ in src]
    for i, r in enumerate(rows):
        text, following = src[i][1], src[(i + 1) % len(src)][1]
        edited = chunkprint.edit(text, following)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        own, other, nxt = chunkprint.prints([text.encode(), edited.encode(), following.encode()])
        assert (r.fingerprint, r.edited_fingerprint) == (chunkprint.render(own), chunkprint.render(other))
        assert r.near_edited == pytest.approx(chunkprint.containment(own, other)) and r.near_next == pytest.approx(chunkprint.containment(own, nxt))
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_fingerprint_edges(spark):
    got = chunkprint.fingerprints(odd_docs(spark)).collect()
    assert len(got) == 10 and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert chunkprint.fingerprints(empty(odd_docs(spark))).count() == 0
    (one,) = chunkprint.fingerprints(odd_docs(spark).where("doc_id = 4")).collect()
    assert one.near_next == 1.0


# -- op6 ---------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf):
    src = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: r for r in queries.op6_simhash(spark, sf).collect()}
    prints = {k: slow_fingerprint(t) for k, t in src}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {k: (f"{prints[k]:016x}", find(k)) for k in keys} == {k: (r.fingerprint, r.component_id) for k, r in got.items()}


def test_link_groups_match_all_pairs():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = [rng.integers(0, 2**63, 1500, dtype=np.uint64)]
    for c in centres:
        for _ in range(40):
            points.append(np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64))], dtype=np.uint64))
    p = np.unique(np.concatenate(points))
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 2)
    truth = np.arange(len(p))
    hamming.settle(truth, i, j)
    got = hamming.link_groups(p, 2)
    assert np.array_equal(truth, got)
    root, n = hamming.top_tree(p[::3], 4)
    at, shard = hamming.route(root, p, 2)
    labels = np.arange(len(p))
    for s in range(n):
        own = at[shard == s]
        first = hamming.link_groups(p[own], 2)
        hamming.settle(labels, own, own[first])
    assert n > 4 and np.array_equal(truth, labels)


@pytest.mark.parametrize("tail", [0, 64, 1 << 14])  # by rounds alone, by both, in one task
def test_components_of_chains(spark, monkeypatch, tail):
    monkeypatch.setattr("gleaner.llm.components.TAIL", tail)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5000, 1001), (7, 7)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.fp)
    assert sorted(map(sorted, got.values())) == [list(range(201)), [1000, 1001, 5000]]


def test_simhash_edges(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[7].component_id == 6 and by[4].component_id == 4
    assert simhash.near_duplicates(empty(odd_docs(spark))).count() == 0


# -- op8 ---------------------------------------------------------------------


def nearest(vectors, is_query, k=5):
    out = []
    for q in sorted(v for v in vectors if is_query(v)):
        a = vectors[q]
        scored = sorted((-(a @ b) / np.sqrt((a @ a) * (b @ b)), c) for c, b in vectors.items() if c != q)
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return out


def test_hilbert_curve_is_a_walk():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = grid[np.argsort(hilbert.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table(spark, sf, "embeddings").collect()}
    want = nearest(vectors, lambda k: k % 50 == 0)
    got = sorted(tuple(r) for r in queries.op8_neighbours(spark, sf).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_neighbours_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, v) for i in range(0, 40)] + [(50, [3.0, 2.0, 1.0]), (50, [3.0, 2.0, 1.0]), (100, [0.0, 0.0, 0.0]), (150, None), (None, v), (200, [1.0, float("nan"), 1.0]), (250, [1.0, None, 1.0]), (300, [1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in hilbert.search(df, F.col("id") % 50 == 0).collect())
    assert [r[:3] for r in got] == [(0, i, i) for i in range(1, 6)] + [(50, i + 1, i) for i in range(5)]
    assert hilbert.search(df.where("1 = 0"), F.col("id") % 50 == 0).count() == 0
    assert hilbert.search(df.where("vec_id = 50"), F.col("id") % 50 == 0).count() == 0


# -- op9, op10 -----------------------------------------------------------------


def test_token_files(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(wordbpe.TOKENIZER))
    at, want = 0, []
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op9_tokens(spark, sf).collect()) == want


def test_token_file_access(spark, tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(0).integers(0, 60000, 300_000).astype("<u2")
    out = tokenfiles.TokenWriter(fs.LocalFileSystem(), str(tmp_path / "t.arrow"), np.dtype("<u2"), 64)
    for part in np.split(ids, [5, 5, 70000, 199999]):
        out.add(part)
    out.close()
    f = tokenfiles.TokenFile(fs.LocalFileSystem(), str(tmp_path / "t.arrow"))
    assert np.array_equal(f.ids(0, len(ids)), ids) and np.array_equal(f.ids(123_456, 1000), ids[123_456:124_456])
    own, mask = f.sequence(1000)
    assert np.array_equal(own, ids[64_000:64_064]) and mask.all() and own.base is not None
    last, mask = f.sequence(len(ids) // 64)
    assert mask.sum() == len(ids) % 64 and np.array_equal(last[mask], ids[-(len(ids) % 64) :])


def test_token_edges(spark):
    path = public_tokenizers.path(wordbpe.TOKENIZER)
    got = sorted((tuple(r) for r in tokenfiles.round_trip(odd_docs(spark), path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8, None] and got[0][2] == 1
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert tokenfiles.round_trip(empty(odd_docs(spark)), path).count() == 0


ODD = ["", "  ", "it's O'Neil's don't", "<|endoftext|> a<|startoftext|>b", "Ärger, ßtraße. É éx", "ΑΣ ΣΑΣ, İstanbul ǅ", "a\x1cb \x85 c d​e", "１２３ x²y 12a3", "日本語 テキスト", "ﬁ ﬀ", "thed,,;--", "'S 'LL'd", "x" * 3000, "̀abc", "a_b c-d «g» ×÷ªº µm"]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(wordbpe.TOKENIZER)
    tok, enc = Tokenizer.from_file(path), wordbpe.encoder(path)
    for t in ODD + random_texts("aB éÉ'.,<|>endoftxt12́ ßÿ×µª\n", 3000, 1):
        assert enc(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_pieces_match_the_library():
    bpe = piecebpe.piece_bpe(public_tokenizers.path(piecebpe.MODEL))
    texts = [*ODD, " " * 500 + "a", "日本語" * 700, "ab" * 2000, "▁", "a ▁ b", "<s></s><unk><0x41>", "﻿x", *random_texts("aB éÉ'.,<|>end  st12́ ßÿ▁µª\nxxlloo日本語한\t\x00\r😀thequickbrown ", 5000, 2)]
    for t, mine in zip(texts, bpe.encode(texts), strict=True):
        assert mine.tolist() == bpe.model.encode(t), t


def test_pieces_of_long_words_and_empty_table(spark):
    bpe = piecebpe.piece_bpe(public_tokenizers.path(piecebpe.MODEL))
    rng = random.Random(6)
    texts = ["".join(rng.choices("etaoinshrdlcumwfgypb", k=n)) for n in (5_000, 30_000)] + random_texts("the in", 400, 3) + random_texts("etaoinshrdl", 400, 4)
    for t, mine in zip(texts, bpe.encode(texts), strict=True):
        assert mine.tolist() == bpe.model.encode(t)
    got = {r.doc_id: r for r in piecebpe.digests(odd_docs(spark), public_tokenizers.path(piecebpe.MODEL)).collect()}
    assert len(got) == 9 and got[1].n_tokens == got[2].n_tokens == 0 and got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert piecebpe.digests(empty(odd_docs(spark)), public_tokenizers.path(piecebpe.MODEL)).count() == 0


def test_pieces_query(spark, sf):
    bpe = piecebpe.piece_bpe(public_tokenizers.path(piecebpe.MODEL))
    text = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op10_pieces(spark, sf).collect():
        ids = bpe.model.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(bpe.model.decode(ids)))
    odd = piecebpe.encode_documents(odd_docs(spark), public_tokenizers.path(piecebpe.MODEL)).collect()
    assert {r.decoded for r in odd if r.doc_id in (1, 2)} == {""} and len(odd) == 10


def test_maintext_keeps_the_whole_article():
    long, mid = "A long sentence of the article goes on and on with many plain words. " * 12, "A sentence that leads into the text, of middling length, with words. " * 2
    nav = "<div class='nav'><a href=x>Home</a> <a href=y>Shop</a></div>"
    got = maintext.extract(f"<body>{nav}<div id=c><h1>Head line</h1><p>{mid}lead</p><div class=body><p>{long}</p><p>{long}</p></div><p>{mid}closing</p></div></body>")
    assert all(w in got for w in ("Head line", "lead", "long sentence", "closing")) and "Shop" not in got
    got = maintext.extract(f"<body><article><p>{long * 4}</p></article><article><p>{mid}second</p></article></body>")
    assert "second" in got
    for name in ("layout has-sidebar", "no-ads", "with-menu page", "banner"):
        assert "long sentence" in maintext.extract(f"<body>{nav}<div class='{name}'><article><p>{long}</p></article></div></body>"), name
    for name in ("comments", "menu", "sidebar", "cookie-banner"):
        assert maintext.extract(f"<body><div class='{name}'><p>{long}</p></div></body>") == "", name  # nothing else is left
    got = maintext.extract(f"<body><article><p>{long}</p><p class='cookie-notice'>{mid}biscuit<p>{mid}end</p><ul><li class=promo>{mid}buy<li>{mid}item</ul></article><div class=comments><p>{long * 9}remark</p></div></body>")
    assert "end" in got and "item" in got and not any(w in got for w in ("biscuit", "buy", "remark"))


ARTICLE = ["The harbour at dawn", "Boats came in one after another, and the market filled with voices, crates and the smell of fish.", "By noon it was quiet.", "Only the oldest of the sellers stayed on, mending nets in the shade of the customs house until evening."]


def page(*inside, around="<article>{}</article>", before="", after=""):
    """A page whose main text is ARTICLE; further elements stand before its last paragraph."""
    h, *ps, last = ARTICLE
    own = f"<h1>{h}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "".join(inside) + f"<p>{last}</p>"
    return f"<html><body><nav><a href=/>Home</a> <a href=/b>Shop</a></nav>{before}{around.format(own)}{after}<footer>All rights kept</footer></body></html>"


LONG = "A long run of words that is no part of the story at all, though it reads like plain prose. " * 20
DROPPED_PAGES = {
    "long sidebar": page(after=f"<div class=sidebar><p>{LONG}</p></div>"),
    "long sidebar in main": page(around="<main>{}</main>", after=f"<div class=sidebar><p>{LONG}</p></div>"),
    "long sidebar inside": page(f"<div class=sidebar><p>{LONG}</p></div>"),
    "cookie banner": page(before=f"<div class=cookie-banner><p>{LONG}</p></div>"),
    "cookie banner, no article": page(around="<div id=c>{}</div>", before=f"<div class=cookie-banner><p>{LONG}</p></div>"),
    "comments": page(after=f"<section id=comments><p>{LONG}</p></section>"),
    "comment articles": page(after=f"<article class=comment><p>{LONG}</p></article>" * 3),
    "related": page(after=f"<div class='related'><article><p>{LONG}</p></article></div>"),
    "share buttons": page("<div class='share-buttons'><p>Tell your friends about this page</p></div>"),
    "newsletter": page("<div class='newsletter-signup'><p>Get a letter each week</p></div>"),
    "inline advert": page("<p><span class=ad>Buy a boat today</span></p>"),
    "hidden block": page(f"<div style='color:red; display:none'><p>{LONG}</p></div>"),
    "hidden inline": page("<p><span style='visibility: hidden'>not seen</span></p>"),
    "hidden heading": page("<h2 hidden>not seen</h2>"),
    "label": page("<label for=x>Your name</label>"),
    "option": page("<p><output>12</output></p>"),
    "form": page(f"<form><p>{LONG}</p><input></form>"),
    "by-line": page(around="<article><header><p>By A. Writer</p></header>{}</article>"),
    "footer": page(around="<article>{}<footer><p>Filed under sea</p></footer></article>"),
    "wrapped": page(around="<div class='search-page'><div id='sidebar-layout'><article>{}</article></div></div>"),
    "aside": page(f"<aside><p>{LONG}</p></aside>"),
    "script": page("<script>var p = '<p>no</p>'</script><style>p{}</style><template><p>no</p></template>"),
}


@pytest.mark.parametrize("name", DROPPED_PAGES)
def test_maintext_known_pages(name):
    assert maintext.extract(DROPPED_PAGES[name]) == "\n\n".join(ARTICLE)


@pytest.mark.parametrize("share", [1, 40])
@pytest.mark.parametrize("opening", ["section class=legal-analysis", "div class='binary-search'", "div id=share-prices", "section id=related-work", "div class='has-sidebar'", "div class='no-comments'", "p class='tags-of-history'"])
def test_maintext_keeps_sections_of_any_size(opening, share):
    """A name with a marking word among others is no mark inside an article, however much text it holds."""
    text = " ".join(["Prices rose in every port of the coast that year."] * share)
    got = maintext.extract(page(f"<{opening}>{text}</{opening.split()[0]}>"))
    assert got.split("\n\n") == [*ARTICLE[:-1], text, ARTICLE[-1]]


def test_maintext_deep_nesting():
    text = "Many words of one long paragraph that stands inside. " * 5
    for page, kept in (("<div>" * 100_000 + f"<p>{text}</p>" + "</div>" * 100_000, True), ("<div class=has-ad>" * 20_000 + f"<p>{text}</p>" + "</ul>" * 20_000, True), ("<div class=ad>" * 20_000 + f"<p>{text}</p>" + "</ul>" * 20_000, False)):
        assert maintext.extract(page) == (text.strip() if kept else "")


def test_neighbours_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(hilbert.search(df, F.col("id") % 50 == 0).collect())] == [(1, 1), (2, 2)]

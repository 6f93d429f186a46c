"""Queries over conversations as answers and over page texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import lower_words, words
from gleaner.operators import answers as J
from gleaner.plans import retrieval as R
from gleaner.plans.registry import query
from gleaner.session import table

# -- pages ------------------------------------------------------------------------------


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


@query(r"SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' GROUP BY conv_id")
def page_marked_text(spark, sf):
    return J.page_marked_text(turns(spark, sf), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, turn AS page FROM conversations")
def inject_page_numbers(spark, sf):
    marked = turns(spark, sf).withColumn("content", F.concat(F.lit("[Page "), F.col("turn").cast("string"), F.lit("]\n"), "text"))
    return marked.select("conv_id", "turn", J.page_number("content").alias("page"))


@query("SELECT conv_id AS doc_id, md5(conv_id || '/' || turn) AS chunk_id, 'section' AS kind, CAST(0 AS BIGINT) AS level, text AS content FROM conversations")
def section_nodes(spark, sf):
    return turns(spark, sf).select(F.col("conv_id").alias("doc_id"), F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")).alias("chunk_id"), F.lit("section").alias("kind"), F.lit(0).cast("long").alias("level"), F.col("text").alias("content"))


@query(rf"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, list_filter(list_transform(regexp_extract_all(html, '{J.ANCHOR}'), lambda a: {{'u': regexp_extract(a, '{J.HREF.replace("'", "''")}', 1), 'a': trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))}}), lambda x: x.u <> '') AS l FROM pages), x AS (SELECT page_id, host, unnest(range(0, len(l))) AS pos, l FROM l)
SELECT page_id, pos, l[pos + 1].u AS uri, l[pos + 1].a AS anchor, CASE WHEN regexp_matches(l[pos + 1].u, '^[a-z]+://') AND regexp_extract(l[pos + 1].u, '^[a-z]+://([^/?#]*)', 1) <> host THEN 'external' ELSE 'internal' END AS type FROM x""")
def extract_links(spark, sf):
    return J.extract_links(table(spark, sf, "pages"))


# -- prompts -----------------------------------------------------------------------------

HEAD = "E'Answer from the sources only.\\nCite sources as [Source n].\\nAnswer in a few sentences.\\n\\n'"
PROMPT = rf"""{R.LISTS}, sr AS (SELECT query_id, string_agg('[Source ' || rank || ']: ' || regexp_replace(regexp_replace(text, '\[Page [0-9]+\]\s*', '', 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS s FROM l20 JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY 1),
pt AS (SELECT query_id, {HEAD} || s || E'\n\nQuestion: ' || question || E'\nAnswer:' AS prompt FROM qst JOIN sr USING (query_id))"""


@query(f"WITH {PROMPT} SELECT query_id, md5(prompt) AS prompt, CAST(length(prompt) AS BIGINT) AS n FROM pt")
def build_prompts(spark, sf):
    p = J.build_prompts(R.lexical_list(spark, sf), R.questions(spark, sf), R.chunks(spark, sf))
    return p.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.length("prompt").cast("long").alias("n"))


@query(rf"WITH {PROMPT} SELECT query_id, regexp_replace(substr(prompt, 1, instr(prompt, '[Source n') - 1), '^\s+|\s+$', '', 'g') AS system, md5(regexp_replace(regexp_replace(substr(prompt, instr(prompt, '[Source ')), '\s*Answer:\s*$', ''), '^\s+|\s+$', '', 'g')) AS user FROM pt")
def split_chat_prompt(spark, sf):
    p = J.build_prompts(R.lexical_list(spark, sf), R.questions(spark, sf), R.chunks(spark, sf))
    return J.split_chat_prompt(p).select("query_id", "system", F.md5(F.col("user").cast("binary")).alias("user"))


@query(r"SELECT doc_id, CASE WHEN length(c) > 5000 THEN left(c, 5000) || '... [truncated]' ELSE c END AS text FROM (SELECT doc_id, regexp_replace(text, '[^\P{C}\n\t]', '', 'g') AS c FROM documents)")
def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", J.sanitize_text("text").alias("text"))


@query(r"SELECT doc_id, left(regexp_replace(replace(regexp_replace(text, '(?i)((?:api_?key|key|secret|token|password|auth|credential)[a-z_]*\s*[=:]\s*)\S+', '\1***', 'g'), chr(10), '\n'), '[\x00-\x1f\x7f]', '', 'g'), 200) AS text FROM documents")
def redact_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", J.redact_secrets("text").alias("text"))


# -- answers -----------------------------------------------------------------------------

SENT = r"""ans AS (SELECT conv_id * 100 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
src AS (SELECT a.query_id, row_number() OVER (PARTITION BY a.query_id ORDER BY c.turn) AS source, c.text AS content FROM ans a JOIN conversations c ON a.conv_id = c.conv_id AND a.turn <> c.turn), ns AS (SELECT query_id, count(*) AS n_sources FROM src GROUP BY 1),
sp AS (SELECT query_id, conv_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM ans),
se AS (SELECT query_id, conv_id, unnest(range(0, len(l))) AS pos, l FROM sp), sen AS (SELECT se.query_id, pos, l[pos + 1] || ' [Source ' || ((conv_id + pos) % (coalesce(n_sources, 0) + 2)) || ']' AS sentence, coalesce(n_sources, 0) AS n FROM se LEFT JOIN ns ON ns.query_id = se.query_id)"""


def answers(spark, sf) -> DataFrame:
    return turns(spark, sf).where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")


def sources(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    a, c = answers(spark, sf).drop("text"), turns(spark, sf).select("conv_id", F.col("turn").alias("t"), F.col("text").alias("content"))
    rows = a.join(c.hint("merge"), "conv_id").where("turn <> t")
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("t")).cast("long").alias("source"), "content")


def sentences(spark, sf) -> DataFrame:
    """Sentences of the answers, each with a citation behind it, some of them out of range."""
    n = sources(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    rows = J.split_sentences(answers(spark, sf), "query_id", "text").join(n.hint("merge"), "query_id", "left").fillna(0, ["n"])
    k = (F.floor(F.col("query_id") / 100) + F.col("pos")) % (F.col("n") + 2)
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), F.concat("sentence", F.lit(" [Source "), k.cast("string"), F.lit("]")).alias("sentence"), "n")


@query()
def clean_answers(spark, sf):
    return answers(spark, sf).select("query_id", J.clean_answers("text").alias("answer"))


@query("""WITH t AS (SELECT conv_id, turn, text || right(text, 20) || left(text, 30) || right(text, 20) AS c FROM conversations), p AS (SELECT *, right(c, 20) AS l, right(left(c, length(c) - 20), 280) AS b FROM t)
SELECT conv_id, turn, CAST(CASE WHEN length(c) > 20 AND (length(b) - length(replace(b, l, ''))) // 20 >= 2 THEN instr(b, l) + greatest(length(c) - 300, 0) ELSE 0 END AS BIGINT) AS at_place FROM p""")
def detect_repetition(spark, sf):
    c = F.concat("text", F.right("text", F.lit(20)), F.left("text", F.lit(30)), F.right("text", F.lit(20)))
    return turns(spark, sf).withColumn("c", c).select("conv_id", "turn", J.detect_repetition("c").alias("at_place"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'There is not enough information in the documents to answer.' WHEN turn % 3 = 0 OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 5 THEN 'I could not produce an answer to this question.' ELSE text END AS answer FROM conversations""")
def fallback_answer(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", J.fallback_answer(F.when(F.col("turn") % 3 == 0, " a ").otherwise(F.col("text")), F.col("turn") % 5).alias("answer"))


@query(f"WITH {SENT} SELECT query_id, pos, l[pos + 1] AS sentence FROM se")
def split_sentences(spark, sf):
    return J.split_sentences(answers(spark, sf), "query_id", "text").withColumn("pos", F.col("pos").cast("long"))


CITED = r"list_filter(list_transform(regexp_extract_all(sentence, '\[Source ([0-9]+)\]', 1), lambda x: x::BIGINT), lambda k: k >= 1 AND k <= n)"


@query(f"WITH {SENT} SELECT query_id, pos, array_to_string({CITED}, ',') AS cited FROM sen")
def parse_citations(spark, sf):
    return sentences(spark, sf).select("query_id", "pos", F.array_join(J.parse_citations("sentence", F.col("n")).cast("array<string>"), ",").alias("cited"))


BARE = r"regexp_replace(regexp_replace(sentence, '\s*\[Source [0-9]+\]', '', 'g'), '^\s+|\s+$', '', 'g')"
CLAIMS = f"""{SENT}, clm AS (SELECT sen.query_id, pos, source, CASE WHEN len({R.low(BARE)}) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({R.low(BARE)}), {R.low('content')})) / len(list_distinct({R.low(BARE)})), 6) END AS score FROM sen JOIN src ON sen.query_id = src.query_id)"""


@query(f"WITH {CLAIMS} SELECT * FROM clm")
def score_claims(spark, sf):
    return J.score_claims(sentences(spark, sf), sources(spark, sf))


VERIFIED = f"""{CLAIMS}, ci AS (SELECT query_id, pos, sentence, n, {CITED} AS cited FROM sen), be AS (SELECT ci.query_id, ci.pos, ci.sentence, max(CASE WHEN list_contains(cited, source) AND score > 0 THEN score END) AS a, max(score) AS b, max(n) AS k FROM ci LEFT JOIN clm ON clm.query_id = ci.query_id AND clm.pos = ci.pos GROUP BY 1, 2, 3),
ju AS MATERIALIZED (SELECT query_id, pos, sentence, CASE WHEN k = 0 THEN 1.0 ELSE coalesce(a, b, 0.0) END AS score FROM be),
ver AS (SELECT query_id, count(*) AS n, count(CASE WHEN score > 0 THEN 1 END) AS supported, round(sum(CAST(round(score * 1000000) AS BIGINT)) / count(*)) / 1000000 AS confidence, coalesce(string_agg(CASE WHEN score > 0 THEN sentence END, ' ' ORDER BY pos), 'I could not find supporting evidence in the provided sources.') AS verified FROM ju GROUP BY 1)"""


@query(f"WITH {VERIFIED} SELECT * FROM ver")
def verify_answers(spark, sf):
    return J.verify_answers(sentences(spark, sf), sources(spark, sf)).drop("unsupported")


@query(f"WITH {VERIFIED}, fl AS (SELECT ju.query_id, string_agg(sentence, ' ' ORDER BY pos) AS verified, coalesce(string_agg(CASE WHEN score <= 0 THEN sentence END, ' ' ORDER BY pos), '') AS unsupported FROM ju GROUP BY 1) SELECT query_id, n, supported, confidence, fl.verified, fl.unsupported FROM ver JOIN fl USING (query_id)")
def verify_answers_flagged(spark, sf):
    """Unsupported sentences stay and are listed."""
    v = J.verify_answers(sentences(spark, sf), sources(spark, sf), remove=False)
    return v.withColumn("unsupported", F.array_join("unsupported", " "))


@query(f"WITH {VERIFIED} SELECT query_id, confidence AS faithfulness FROM ver")
def faithfulness(spark, sf):
    return J.verify_answers(sentences(spark, sf), sources(spark, sf)).select("query_id", F.col("confidence").alias("faithfulness"))


# gold: every second word of the answer's first twelve; cited: its first eight words; known: by parity of length
NAMES = f"""nam AS (SELECT conv_id * 100 + turn AS query_id, text, list_distinct({R.low('text')}) AS cited, list_distinct(list_transform(range(1, len({R.low('text')}) + 1, 2), lambda i: CASE WHEN length(({R.low('text')})[i]) % 3 = 0 THEN reverse(({R.low('text')})[i]) ELSE ({R.low('text')})[i] END)) AS gold FROM conversations WHERE role = 'assistant')"""


def names(spark, sf) -> DataFrame:
    """All words of an answer as what it cites; every second of them, some turned round, as what is known."""
    gold = F.array_distinct(F.transform(J.even_words("text"), lambda w: F.when(F.length(w) % 3 == 0, F.reverse(w)).otherwise(w)))
    return answers(spark, sf).select("query_id", "text", F.array_distinct(lower_words("text")).alias("cited"), gold.alias("gold"))


@query(f"WITH {NAMES} SELECT query_id, array_to_string(list_sort(list_filter(cited, lambda w: NOT (length(w) % 2 = 0 OR list_contains(gold, w)))), ',') AS unknown FROM nam")
def validate_citations(spark, sf):
    functions = F.filter("cited", lambda w: F.length(w) % 2 == 0)
    return names(spark, sf).select("query_id", F.array_join(F.array_sort(J.validate_citations(F.col("cited"), functions, F.col("gold"))), ",").alias("unknown"))


@query(f"WITH {NAMES} SELECT query_id, array_to_string(list_sort(list_filter(cited, lambda w: contains(lower(text), w) AND NOT contains(lower(replace(text, 'e', '')), w))), ',') AS missing FROM nam")
def check_question_refs(spark, sf):
    return names(spark, sf).select("query_id", F.array_join(F.array_sort(J.check_question_refs(F.col("text"), F.replace("text", F.lit("e"), F.lit("")), F.col("cited"))), ",").alias("missing"))


@query(f"WITH {NAMES} SELECT query_id, array_to_string(list_sort(list_intersect(cited, gold)), ',') AS supported, array_to_string(list_sort(list_filter(cited, lambda w: NOT list_contains(gold, w))), ',') AS unsupported, CASE WHEN len(cited) = 0 THEN 1.0 ELSE round(len(list_intersect(cited, gold)) / len(cited), 4) END AS ratio FROM nam")
def validate_param_claims(spark, sf):
    v = names(spark, sf).select("query_id", J.validate_param_claims(F.col("cited"), F.col("gold")).alias("v"))
    return v.select("query_id", F.array_join("v.supported", ",").alias("supported"), F.array_join("v.unsupported", ",").alias("unsupported"), "v.ratio")


#: Words of an answer in turn: in back quotes before the word, in double quotes after it, bare, quoted alone, quoted with a dot.
CLAIMING = """array_to_string(list_transform(w, lambda x, i: CASE (i + query_id) % 7 WHEN 0 THEN 'the `' || x || '` parameter' WHEN 1 THEN 'Param "' || x || '"' WHEN 2 THEN 'the parameter ' || x WHEN 3 THEN '"' || x || '"' WHEN 4 THEN '`' || x || '`' WHEN 5 THEN '`' || x || '` PARAMETER' ELSE x || ' parameters' END), ' ')"""
_NAME = r"[\p{L}\p{N}_]"


def _claims(q: str, t: str = "t") -> str:
    name = f"{q}({_NAME}{{1,100}}){q}"
    return rf"regexp_extract_all({t}, '(?i){name}\s+(?:parameter|param)\b', 1), regexp_extract_all({t}, '(?i)(?:parameter|param)\s+{name}', 1), regexp_extract_all({t}, '(?i)the\s+{name}\s+parameter\b', 1)"


@query(rf"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'), a AS (SELECT query_id, left({CLAIMING}, 10000) AS t, list_transform(list_filter(w, lambda x, i: i % 3 = 0), lambda x: translate(x, 'aeiou', 'AEIOU')) AS known FROM q),
k AS (SELECT query_id, known, list_concat({_claims('`')}, {_claims('"')}) AS near, list_concat(regexp_extract_all(t, '`([\p{{L}}\p{{N}}_.]+)`', 1), regexp_extract_all(t, '"([\p{{L}}\p{{N}}_.]+)"', 1)) AS quoted FROM a)
SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(near, list_filter(quoted, lambda x: list_contains(list_transform(known, lambda n: lower(n)), lower(x)))))), ',') AS claims FROM k""")
def find_param_claims(spark, sf):
    w = words("text")
    spelled = lambda x, i: (
        F.when((i + 1 + F.col("query_id")) % 7 == 0, F.concat(F.lit("the `"), x, F.lit("` parameter")))
        .when((i + 1 + F.col("query_id")) % 7 == 1, F.concat(F.lit('Param "'), x, F.lit('"')))
        .when((i + 1 + F.col("query_id")) % 7 == 2, F.concat(F.lit("the parameter "), x))
        .when((i + 1 + F.col("query_id")) % 7 == 3, F.concat(F.lit('"'), x, F.lit('"')))
        .when((i + 1 + F.col("query_id")) % 7 == 4, F.concat(F.lit("`"), x, F.lit("`")))
        .when((i + 1 + F.col("query_id")) % 7 == 5, F.concat(F.lit("`"), x, F.lit("` PARAMETER")))
        .otherwise(F.concat(x, F.lit(" parameters")))
    )
    known = F.transform(F.filter(w, lambda x, i: (i + 1) % 3 == 0), lambda x: F.translate(x, "aeiou", "AEIOU"))
    a = answers(spark, sf).select("query_id", F.array_join(F.transform(w, spelled), " ").alias("t"), known.alias("known"))
    return a.select("query_id", F.array_join(J.find_param_claims("t", F.col("known")), ",").alias("claims"))


@query(f"""WITH {NAMES}, c AS (SELECT query_id, text AS answer, 'cot' AS stage, 1 AS r, len(cited) % 3 = 0 AS ok FROM nam UNION ALL SELECT query_id, text || ' !', 'predict', 2, len(gold) % 2 = 0 FROM nam), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT ok, r) AS n FROM c)
SELECT query_id, CASE WHEN ok THEN answer ELSE 'I could not find supporting evidence in the provided sources.' END AS answer, CASE WHEN ok THEN 1.0 / r ELSE 0.0 END AS confidence, CASE WHEN ok THEN stage ELSE 'none' END AS stage FROM b WHERE n = 1""")
def select_answer(spark, sf):
    n = names(spark, sf)
    make = lambda stage, r, answer, ok: n.select("query_id", answer.alias("answer"), F.lit(stage).alias("stage"), F.lit(r).alias("stage_rank"), F.lit(1.0 / r).alias("confidence"), ok.alias("passed"))
    return J.select_answer(make("cot", 1, F.col("text"), F.size("cited") % 3 == 0).unionByName(make("predict", 2, F.concat("text", F.lit(" !")), F.size("gold") % 2 == 0)))


METRICS = f"""{NAMES}, mt AS (SELECT query_id, CASE WHEN len(gold) = 0 THEN 1.0 ELSE round(len(list_filter(gold, lambda w: contains(lower(text), w))) / len(gold), 6) END AS recall,
CASE WHEN len(gold) = 0 THEN 1.0 WHEN len(cited) = 0 THEN 0.0 ELSE round(len(list_intersect(cited, gold)) / len(cited), 6) END AS accuracy, CASE WHEN len(cited) = 0 THEN 0.0 ELSE round(len(list_filter(cited, lambda w: NOT list_contains(gold, w))) / len(cited), 6) END AS hallucination FROM nam)"""


def metrics(spark, sf) -> DataFrame:
    text = F.lower("text")
    return names(spark, sf).select("query_id", J.gold_name_recall(F.col("gold"), text).alias("recall"), J.citation_accuracy(F.col("cited"), F.col("gold")).alias("accuracy"), J.hallucination_rate(F.col("cited"), F.col("gold")).alias("hallucination"))


@query(f"WITH {METRICS} SELECT query_id, recall FROM mt")
def gold_name_recall(spark, sf):
    return metrics(spark, sf).select("query_id", "recall")


@query(f"WITH {METRICS} SELECT query_id, accuracy FROM mt")
def citation_accuracy(spark, sf):
    return metrics(spark, sf).select("query_id", "accuracy")


@query(f"WITH {METRICS} SELECT query_id, hallucination FROM mt")
def hallucination_rate(spark, sf):
    return metrics(spark, sf).select("query_id", "hallucination")


@query(f"WITH {METRICS} SELECT query_id, round(0.3 * recall + 0.4 * accuracy + 0.3 * (1 - hallucination), 6) AS score FROM mt")
def composite_score(spark, sf):
    return metrics(spark, sf).select("query_id", J.composite_score(F.col("recall"), F.col("accuracy"), F.col("hallucination")).alias("score"))


@query(r"""WITH b AS (SELECT doc_id, encode(text) AS c, CASE doc_id % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c.txt' WHEN 3 THEN 'd.md' ELSE 'e.exe' END AS name, length(text) AS size FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'extension' WHEN size > 20000 THEN 'size' WHEN doc_id % 5 < 2 THEN 'content' END AS reason FROM b""")
def validate_uploads(spark, sf):
    from gleaner.sources.files import validate_uploads as op

    ext = F.element_at(F.array(*map(F.lit, ("a.pdf", "b.docx", "c.txt", "d.md", "e.exe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = table(spark, sf, "documents").select("doc_id", ext.alias("path"), F.encode("text", "utf-8").alias("content"), F.length("text").alias("length"))
    return op(files, 20_000).select("doc_id", "reason")

"""Prompt tables, answer cleaning, and checks of answers against their sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import col, lower_words, strip, words
from gleaner.operators.fusion import coverage
from gleaner.operators.vectors import DIGITS

REFUSAL = "I could not find supporting evidence in the provided sources."
APOLOGY = "I could not produce an answer to this question."
NO_SOURCE = "There is not enough information in the documents to answer."

#: Blocks that a prompt may carry. Fixed values of this library.
GROUNDING = "Answer from the sources only."
CITING = "Cite sources as [Source n]."
LENGTHS = {"concise": "Answer in a few sentences.", "detailed": "Answer in detail."}


def page_marked_text(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Pages of a document joined by blank lines, each behind its number; blank pages leave a gap."""
    rows = pages.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    parts = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.col(text)).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s.t), "\n\n").alias("text"))


def page_number(content: Column | str, known: Column | None = None) -> Column:
    """The page that a chunk's first line names, unless one is known."""
    found = F.regexp_extract(F.split_part(col(content), F.lit("\n"), F.lit(1)), r"^\[Page ([0-9]+)\]", 1).try_cast("long")
    return found if known is None else F.coalesce(known, found)


def build_prompts(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, n: int = 5, cite: bool = True, length: str = "concise") -> DataFrame:
    """One prompt for each query: instructions, numbered sources without page marks, the question."""
    rows = ranked.where(F.col("rank") <= n).join(chunks.select("chunk_id", "content").hint("merge"), "chunk_id")
    clean = strip(F.regexp_replace("content", r"\[Page [0-9]+\]\s*", ""))
    source = F.struct("rank", F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]: "), clean).alias("t"))
    told = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(source)), lambda s: s.t), "\n\n").alias("sources"))
    head = "\n".join([GROUNDING, *([CITING] if cite else []), LENGTHS[length]])
    joined = queries.select("query_id", "question").join(told.hint("merge"), "query_id")
    return joined.select("query_id", F.concat(F.lit(head + "\n\n"), "sources", F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:")).alias("prompt"))


def split_chat_prompt(prompts: DataFrame) -> DataFrame:
    """system: what stands before the first source; user: the rest without a trailing `Answer:`."""
    at = F.instr("prompt", "[Source ")
    body = F.regexp_replace(F.when(at > 0, F.expr("substring(prompt, instr(prompt, '[Source '))")).otherwise(F.col("prompt")), r"\s*Answer:\s*$", "")
    return prompts.select("query_id", F.when(at > 0, strip(F.expr("substring(prompt, 1, instr(prompt, '[Source ') - 1)"))).otherwise("").alias("system"), strip(body).alias("user"))


def sanitize_text(text: Column | str, most: int = 5000) -> Column:
    """Without characters that don't print, but for line breaks and tabs; cut with a mark."""
    clean = F.regexp_replace(col(text), r"[^\P{C}\n\t]", "")
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most)), F.lit("... [truncated]"))).otherwise(clean)


def redact_secrets(text: Column | str, most: int = 200) -> Column:
    """Values behind key, secret, token, password, auth or credential masked; control characters dropped; cut."""
    masked = F.regexp_replace(col(text), r"(?i)((?:api_?key|key|secret|token|password|auth|credential)[a-z_]*\s*[=:]\s*)\S+", "$1***")
    return F.left(F.regexp_replace(F.regexp_replace(masked, r"\n", "\\\\n"), r"[\x00-\x1f\x7f]", ""), F.lit(most))


#: The least length of a repeated suffix, and the share of the text that stays before one at least.
SUFFIX, BEFORE = 30, 3


def repeated_suffix(text: str) -> int:
    """The length of the longest suffix that also stands wholly before itself, 0 if none has SUFFIX characters; in linear time.

    Over the reversed text, z[i] is how far it agrees with itself from i on: a suffix of min(z[i], i) characters recurs there.
    """
    r, n = text[::-1], len(text)
    most = n - n // BEFORE - 1
    z, left, right, best = [0] * n, 0, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and r[k] == r[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
        best = max(best, min(k, i, most))
    return best if best >= SUFFIX else 0


def drop_repeated_suffix(df: DataFrame, text: str) -> DataFrame:
    """df with texts that lose a long suffix that already appeared; those that repeat several times lose one repetition after the other. Between clean_answers and concise."""
    at = df.columns.index(text)

    def cut(t: str | None) -> str | None:
        while t and len(t) >= 2 * SUFFIX and (n := repeated_suffix(t)):
            t = t[:-n].rstrip()
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, text, pa.array([cut(t) for t in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


def concise(text: Column | str) -> Column:
    """A text that doesn't end in . ! ? or ) up to its last whole sentence, if it has one."""
    t = col(text)
    return F.when(t.rlike(r"(?s)[^.!?)]$") & t.rlike(r"(?s)^.+\. "), F.regexp_extract(t, r"(?s)^(.+\.) ", 1)).otherwise(t)


def clean_answers(answer: Column | str, citations: bool = False, length: str = "normal") -> Column:
    """Special tokens, role markers, ids, page references and (unless wanted) citations removed; short and repeated lines dropped.

    A line goes if it has at most 10 characters or if an earlier kept line begins with its first 60
    characters; three or more equal words in a row become one. With length concise the answer is cut by concise().
    """
    t = F.regexp_replace(col(answer), r"(?s)^.*\[/?INST\]|<\|[a-z_]+\|>|</?s>", "")
    t = F.regexp_replace(t, r"(?s)(Human|Assistant|Question|Answer|Sources):.*$", "")
    t = F.regexp_replace(t, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\[Page [0-9]+\]|\((?:page|section) [0-9.]+\)", "")
    if not citations:
        t = F.regexp_replace(t, r"\s*\[Source [0-9]+\]", "")
    t = F.regexp_replace(t, r"(?U)\b(\w+)(?:\s+\1\b){2,}", "$1")
    rows = F.filter(F.transform(F.split(t, "\n"), strip), lambda s: F.length(s) > 10)
    kept = F.aggregate(rows, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda k: F.startswith(k, F.substring(s, 1, 60))), acc).otherwise(F.concat(acc, F.array(s))))
    t = F.array_join(kept, "\n")
    return concise(t) if length == "concise" else t


def detect_repetition(text: Column | str, n: int = 20, within: int = 280) -> Column:
    """Where, from 1, the last n characters first occur if they occur at least twice in the `within` before them; else 0."""
    c = col(text)
    last = F.right(c, F.lit(n))
    before = F.right(F.left(c, F.length(c) - n), F.lit(within))
    skipped = F.greatest(F.length(c) - n - within, F.lit(0))
    times = F.floor((F.length(before) - F.length(F.replace(before, last, F.lit("")))) / n)
    return F.when((F.length(c) > n) & (times >= 2), F.position(last, before) + skipped).otherwise(F.lit(0)).cast("long")


def fallback_answer(answer: Column, n_sources: Column) -> Column:
    return F.when(n_sources == 0, NO_SOURCE).when(F.length(strip(F.coalesce(answer, F.lit("")))) < 5, APOLOGY).otherwise(answer)


def split_sentences(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, sentence: cut after . ! ? and white space."""
    cut = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])\s+"), strip), lambda s: s != "")
    return answers.select(key, F.posexplode(cut).alias("pos", "sentence"))


def parse_citations(sentence: Column | str, n_sources: Column) -> Column:
    """The source numbers that a sentence cites, those out of range dropped."""
    found = F.transform(F.regexp_extract_all(col(sentence), F.lit(r"\[Source ([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n_sources)))


def score_claims(sentences: DataFrame, sources: DataFrame, scorer=coverage) -> DataFrame:
    """query_id, pos, source, score for every sentence and source of one answer."""
    bare = strip(F.regexp_replace("sentence", r"\s*\[Source [0-9]+\]", ""))
    pairs = sentences.join(sources.hint("merge"), "query_id")
    return pairs.select("query_id", "pos", "source", F.round(scorer(bare, "content"), DIGITS).alias("score"))


def verify_answers(sentences: DataFrame, sources: DataFrame, threshold: float = 0.0, remove: bool = True) -> DataFrame:
    """query_id, n, supported, confidence, verified (the supported sentences in order, or a refusal), unsupported (the others in order).

    With remove=False the unsupported sentences stay in verified and are only listed.

    A sentence is supported by its best cited source above the threshold, else by the best of all.
    No sources give confidence 1, an answer without sentences 0.
    """
    n = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    cited = sentences.join(n.hint("merge"), "query_id", "left").withColumn("cited", parse_citations("sentence", F.coalesce("n_sources", F.lit(0))))
    scored = score_claims(sentences, sources)
    one = cited.join(scored.hint("merge"), ["query_id", "pos"], "left")
    on = F.array_contains("cited", F.col("source").cast("int")) & (F.col("score") > threshold)
    best = one.groupBy("query_id", "pos", "sentence").agg(F.max(F.when(on, F.col("score"))).alias("a"), F.max("score").alias("b"), F.max("n_sources").alias("k"))
    judged = best.select("query_id", "pos", "sentence", F.when(F.col("k").isNull(), 1.0).otherwise(F.coalesce("a", "b", F.lit(0.0))).alias("score"))
    ok = F.col("score") > threshold
    told = lambda on: F.transform(F.sort_array(F.collect_list(F.when(on, F.struct("pos", "sentence")))), lambda s: s.sentence)
    kept = F.array_join(told(ok if remove else F.lit(True)), " ")
    out = judged.groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("supported"), (F.round(F.sum(F.round(F.col("score") * 1e6).cast("long")) / F.count("*")) / 1e6).alias("confidence"), kept.alias("verified"), told(~ok).alias("unsupported"))
    return out.withColumn("verified", F.when(F.col("verified") == "", REFUSAL).otherwise(F.col("verified")))


def names_in(text: Column | str) -> Column:
    """Names between backticks, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit("`([^`]+)`"), F.lit(1)))


def validate_citations(cited: Column, functions: Column, types: Column) -> Column:
    """Cited names that are neither known functions nor known types."""
    return F.array_except(cited, F.array_union(functions, types))


def check_question_refs(question: Column, answer: Column, names: Column) -> Column:
    """Names that the question has and the answer has not, case aside."""
    asked = F.filter(names, lambda n: F.contains(F.lower(question), F.lower(n)))
    return F.filter(asked, lambda n: ~F.contains(F.lower(answer), F.lower(n)))


def validate_param_claims(claimed: Column, known: Column) -> Column:
    """struct<supported, unsupported, ratio>; no claims: ratio 1."""
    low = F.transform(claimed, F.lower)
    good = F.array_intersect(low, F.transform(known, F.lower))
    distinct = F.array_distinct(low)
    ratio = F.when(F.size(distinct) == 0, 1.0).otherwise(F.round(F.size(good) / F.size(distinct), 4))
    return F.struct(F.array_sort(good).alias("supported"), F.array_sort(F.array_except(distinct, good)).alias("unsupported"), ratio.alias("ratio"))


#: A claim is a quoted name beside one of these words; the text is read so far. Fixed values.
CLAIM_WORDS, CLAIM_CHARS = "(?:parameter|param)", 10_000


def find_param_claims(text: Column | str, known: Column | None = None) -> Column:
    """Names that a text claims as parameters, each once, sorted, as they are written; of its first 10 000 characters.

    A name of at most 100 word characters in back or double quotes counts with `parameter` or `param` right
    before or after it (with or without `the` in front). Any other quoted name counts if it is one of the known
    names, case aside. A null text gives null, null known names none.
    """
    t = F.left(col(text), F.lit(CLAIM_CHARS))
    letter, found, quoted = r"[\p{L}\p{N}_]", [], []
    for q in "`\"":
        name = f"{q}({letter}{{1,100}}){q}"
        found += [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (rf"(?i){name}\s+{CLAIM_WORDS}(?!{letter})", rf"(?i){CLAIM_WORDS}\s+{name}")]
        quoted.append(F.regexp_extract_all(t, F.lit(rf"{q}([\p{{L}}\p{{N}}_.]+){q}"), F.lit(1)))
    claims = F.flatten(F.array(*found))
    if known is not None:
        names = F.transform(F.coalesce(known, F.array().cast("array<string>")), F.lower)
        claims = F.concat(claims, F.filter(F.array_distinct(F.flatten(F.array(*quoted))), lambda x: F.array_contains(names, F.lower(x))))
    return F.array_sort(F.array_distinct(claims))


def select_answer(candidates: DataFrame) -> DataFrame:
    """The first candidate of each query, by stage, that passed its checks; else a refusal with confidence 0 and stage `none`."""
    best = F.min(F.when(F.col("passed"), F.struct("stage_rank", "stage", "answer", "confidence"))).alias("b")
    row = candidates.groupBy("query_id").agg(best)
    return row.select("query_id", F.coalesce("b.answer", F.lit(REFUSAL)).alias("answer"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.stage", F.lit("none")).alias("stage"))


# -- citation metrics --------------------------------------------------------------------


def gold_name_recall(gold: Column, text: Column) -> Column:
    """Share of gold names that the text contains; no gold: 1."""
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.round(F.size(F.filter(gold, lambda n: F.contains(text, n))) / F.size(gold), DIGITS))


def citation_accuracy(cited: Column, gold: Column) -> Column:
    """Correct among cited; no gold: 1, none cited: 0."""
    return F.when(F.size(gold) == 0, 1.0).when(F.size(cited) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(cited, gold)) / F.size(cited), DIGITS))


def hallucination_rate(cited: Column, gold: Column) -> Column:
    """Cited names without gold among cited; none cited: 0."""
    return F.when(F.size(cited) == 0, 0.0).otherwise(F.round(F.size(F.array_except(cited, gold)) / F.size(cited), DIGITS))


def composite_score(recall: Column, accuracy: Column, hallucination: Column) -> Column:
    return F.round(0.3 * recall + 0.4 * accuracy + 0.3 * (1 - hallucination), DIGITS)


def first_words(text: Column | str, n: int) -> Column:
    return F.slice(words(text), 1, n)


def even_words(text: Column | str) -> Column:
    """Every second lower-case word."""
    return F.filter(lower_words(text), lambda w, i: i % 2 == 0)


#: An anchor with its inner text, and the address in its tag, quoted or not.
ANCHOR, HREF = r"(?is)<a\s[^>]*>.*?</a\s*>", r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]*)"""


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, pos, uri, anchor, type of each link of a page in order: internal if it names no other host.

    A link is one anchor with an address; what marks up its text is dropped, white space becomes one space.
    """
    found = F.filter(
        F.transform(
            F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)),
            lambda a: F.struct(F.regexp_extract(a, HREF, 1).alias("uri"), F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", ""), r"\s+", " ")).alias("anchor")),
        ),
        lambda x: x.uri != "",
    )
    rows = pages.select(F.col(key).alias("page_id"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.posexplode(found).alias("pos", "l"))
    own = F.coalesce(F.try_parse_url(F.col("l.uri"), F.lit("HOST")) == F.col("host"), F.lit(True))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "l.uri", "l.anchor", F.when(own, "internal").otherwise("external").alias("type"))

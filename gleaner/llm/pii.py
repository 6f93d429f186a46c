"""Personal data: certain spans by fixed formats, further ones by boosted trees over candidate spans.

Base spans are the leftmost matches of four formats that pass their checks. Beside them generators of high recall
propose overlapping candidates: written-out or bracketed signs in addresses, numbers with other separators or
without a leading plus. Boosted trees judge a candidate by its format and its neighbourhood. Nobody
labels such spans, so the trees learn from the base spans of a bounded sample of documents (MAX_DOCUMENTS in the
mean, at most MAX_FIT candidates): the spans themselves and rewritten in place by other conventions are examples, their
corrupted forms, badly cut candidates and all candidates that touch no base span are counterexamples. Probabilities
are calibrated on documents that weren't learned from, and each kind's threshold is the least probability from which
on PRECISION of those candidates are right. Candidates over it that touch no base span are taken, surest first, without overlap.

Edge cases: a null or empty text has no spans; a table without base spans adds none; rows with a null id and
repeated rows pass through; very long texts and long runs of signs are read in linear time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import boosting

#: The kinds in their order and their formats (an address is found from its @).
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MAX_DOCUMENTS, MAX_FIT = 8192, 20_000
PRECISION, SLICE = 0.99, 1 << 20
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits' check sum fits."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the four formats, by kind, then start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- candidates ----------------------------------------------------------------

_DOT = r"(?:\x20?\.\x20?|\x20?[\[({<]\x20?(?:\.|[dD][oO][tT])\x20?[\])}>]\x20?|\x20[dD][oO][tT]\x20)"
_POINT = r"(?:\.|\x20?[\[({<]\x20?(?:\.|[dD][oO][tT])\x20?[\])}>]\x20?|\x20[dD][oO][tT]\x20)"
_SIGN = re.compile(r"[@＠]|(?<=[\x20\[({<])[aA][tT](?=[\x20\])}>])")
_OPEN, _CLOSE = re.compile(r"(?:\x20?[\[({<]\x20?|\x20)$"), re.compile(r"\x20?[\])}>]\x20?|\x20")
_LABELS = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:{_POINT}[A-Za-z0-9-]{{1,63}}+){{1,6}}")
_NAME = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}+(?:{_POINT}[A-Za-z0-9_%+-]{{1,64}}+){{0,3}}$")
_RUN = re.compile(r"[0-9]++")
_FOUR = re.compile(rf"[0-9]{{1,4}}+(?:(?:{_DOT}|\x20?,\x20?)[0-9]{{1,4}}+){{3}}")
_LONG = re.compile(r"[0-9](?:[\x20._/  –-]{0,2}[0-9]){11,18}+(?![0-9])")
_CALL = re.compile(r"[+(]?[0-9]{1,4}+\)?(?:[\x20./()–-]{1,2}[0-9]{2,5}+){1,5}(?![0-9A-Za-z])|[0-9]{8,15}+(?![0-9A-Za-z])")


def candidates(text: str) -> list[Span]:
    """Spans that might be personal data, overlapping ones too."""
    out: list[Span] = []
    for m in _SIGN.finditer(text):
        a, b = m.span()
        window = text[max(0, a - 4) : a]
        a -= len(left[0]) if (left := _OPEN.search(window)) else 0
        b += len(right[0]) if (right := _CLOSE.match(text, b)) else 0
        domain = _LABELS.match(text, b)
        if not domain or m[0] not in "@＠" and (not left or not right):
            continue
        window = text[max(0, a - 140) : a]
        first = next((x.start() for x in re.finditer(r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+]", window) if _NAME.match(window, x.start())), None)
        plain = re.search(r"[A-Za-z0-9._%+-]{1,64}$", window)
        for start in {first, plain and plain.start()} - {None}:
            out.append(("email", a - len(window) + start, domain.end()))
    for run in _RUN.finditer(text):
        at = run.start()
        for kind, pattern in (("ip", _FOUR), ("card", _LONG)):
            if m := pattern.match(text, at):
                out.append((kind, *m.span()))
        for begin in (at - 1, at) if at and text[at - 1] in "+(" else (at,):
            if (not begin or not text[begin - 1].isalnum()) and (m := _CALL.match(text, begin)):
                out.append(("phone", *m.span()))
    return out


#: Words beside a span that hint at its kind. Fixed values of this library.
CUES = {"email": "mail email contact write reply address", "ip": "ip host server address client", "card": "card visa credit payment account pay", "phone": "phone tel call mobile fax cell"}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
_WORD = re.compile(r"[a-z]+")
_GROUP = re.compile(r"[0-9]+")


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5 if c in "\"'`=#" else 6


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    digits = _digits(s)
    groups = [len(g) for g in _GROUP.findall(s)]
    low = s.lower()
    octets = [int(g) for g in _GROUP.findall(s) if len(g) <= 4] if kind == "ip" else []
    labels = [x for x in re.split(r"[^A-Za-z0-9-]+", s) if x and x.lower() not in ("at", "dot")]
    before, after = text[max(0, a - 40) : a], text[b : b + 20]
    signs = [c for c in s if not c.isalnum()]
    return [
        float(KINDS.index(kind)),
        len(s),
        len(digits),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        float(len(octets) == 4 and max(octets) <= 255) if kind == "ip" else -1.0,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[-1] if groups else 0,
        len(signs),
        len(set(signs)),
        float("@" in s or "＠" in s),
        len(re.findall(r"[\[({<]", s)),
        len(re.findall(r"\bat\b", low)),
        len(re.findall(r"\bdot\b", low)),
        len(labels),
        len(labels[-1]) if labels and kind == "email" else 0,
        float(labels[-1].isalpha()) if labels and kind == "email" else -1.0,
        float(s[:1] == "+"),
        float(s[:2] == "00"),
        float(s.count("(") == s.count(")")),
        _class(text[a - 1 : a]),
        _class(text[b : b + 1]),
        float(bool(_CUES[kind] & set(_WORD.findall(before.lower())))),
        sum(c.isdigit() for c in before[-8:]) + sum(c.isdigit() for c in after[:8]),
        float(bool(re.search(r"[0-9a-f]{6,}$", before)) or bool(re.match(r"[0-9a-f]{6,}", after))),
    ]


def _disguised(kind: str, s: str, rng: random.Random) -> tuple[str, str]:
    """The span by another convention, and corrupted by the same."""
    digits = _digits(s)
    if kind == "email":
        name, _, domain = s.partition("@")
        at = rng.choice([" at ", " at ", "(at)", "[at]", " (at) ", " [at] ", " @ ", "{at}", "＠"])
        dot = rng.choice([".", " dot ", "[dot]", "(dot)", " [.] "]) if at != " at " else rng.choice([" dot ", "(dot)", "[dot]"])
        if rng.random() < 0.7:  # names of other forms than the sample's
            word = lambda lo, hi: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(lo, hi)))
            name = rng.choice([word(2, 9), f"{word(2, 8)}.{word(2, 9)}", f"{word(1, 6)}{rng.randint(1, 99)}", f"{word(2, 6)}_{word(2, 6)}"])
            domain = ".".join([*(word(2, 10) for _ in range(rng.randint(1, 2))), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])])
        number = f"{rng.randint(1, 999)}.{rng.randint(0, 99)}"  # a host needs letters; a written "at" beside a plain host is prose
        return name + at + domain.replace(".", dot), f"{name} at {domain}" if at == " at " else name + at + number
    if kind == "ip":
        dot = rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]"])
        parts = s.split(".")
        bad = parts.copy()
        bad[rng.randrange(4)] = str(rng.randint(256, 999))
        return dot.join(parts), dot.join(bad)
    if kind == "card":
        gap = rng.choice([".", "/", "_", "  ", " ", "–", " - "[:2]])
        cut = lambda d: gap.join(d[i : i + 4] for i in range(0, len(d), 4))
        return cut(digits), cut(digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10))
    land, rest = rng.choice([digits[:-10] or "1", "44", "49", "33", "34"]), digits[-10:]
    gap = rng.choice([".", "-", " ", "/"])
    cut = lambda d: gap.join((d[:3], d[3:6], d[6:]))
    good = rng.choice([cut(rest), f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"00{land} {cut(rest)}", f"{land}{gap}{cut(rest)}"])
    return good, rng.choice([gap.join((rest[:3], rest[3:5])), gap.join(rest[i : i + 5] for i in range(0, 10, 5)) + gap + rest + rest[:3], f"{rest[:2]}.{rest[2:4]}"])


class Cover:
    """Whether a span touches any of some spans."""

    def __init__(self, spans: list[Span]) -> None:
        own = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends = [a for a, _ in own], list(accumulate((b for _, b in own), max))

    def touches(self, span: Span) -> bool:
        before = bisect_left(self.starts, span[2])
        return before > 0 and self.ends[before - 1] > span[1]


def examples(text: str) -> list[tuple[list[float], int]]:
    """(features, label) of the candidates of a text and of its rewritten forms."""
    base = base_spans(text)
    known, cover, out = set(base), Cover(base), []
    for c in candidates(text):
        if c in known:
            out.append((features(text, c), 1))
        elif not cover.touches(c):
            out.append((features(text, c), 0))
    rng = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    for kind, a, b in base:
        lo, hi = max(0, a - 200), b + 200  # the neighbourhood alone is read again
        for form, label in zip(_disguised(kind, text[a:b], rng), (1, 0), strict=True):
            near = text[lo:a] + form + text[b:hi]
            span = (kind, a - lo, a - lo + len(form))
            moved = len(form) - (b - a)
            others = Cover([(k, x - lo, y - lo) if y <= a else (k, x - lo + moved, y - lo + moved) for k, x, y in base if lo < y <= a or b <= x < hi])
            for c in candidates(near):
                if Cover([span]).touches(c) and not others.touches(c):
                    out.append((features(near, c), label if c == span else 0))
    return out


@dataclass
class Judge:
    """The trees and each kind's threshold; above 1 where none is precise enough."""

    model: boosting.Boosted | None
    thresholds: dict[str, float]

    def further(self, text: str, base: list[Span]) -> list[Span]:
        if self.model is None:
            return []
        cover = Cover(base)
        own = [c for c in dict.fromkeys(candidates(text)) if not cover.touches(c)]
        if not own:
            return []
        p = self.model.probability(np.array([features(text, c) for c in own]))
        taken: list[Span] = []
        cells: dict[int, list[Span]] = {}  # taken spans by stretches of 256 signs, as spans are short
        sure = [(-x, c[1] - c[2], c) for x, c in zip(p.tolist(), own, strict=True) if x >= self.thresholds[c[0]]]
        for _, _, c in sorted(sure):  # the longer first where equally sure
            around = [x for k in range(c[1] >> 8, (c[2] >> 8) + 1) for x in cells.get(k, [])]
            if not any(c[1] < b and a < c[2] for _, a, b in around):
                taken.append(c)
                for k in range(c[1] >> 8, (c[2] >> 8) + 1):
                    cells.setdefault(k, []).append(c)
        return taken


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = MAX_DOCUMENTS, most: int = MAX_FIT, precision: float = PRECISION) -> Judge:
    """Fit on a sample of documents drawn by hash, at most `most` candidates of it."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text).cast("string")), F.lit(SLICE)).alias("h")).where("text is not null")
    share = min(SLICE, -(-documents * SLICE // max(1, docs.count())))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, i, y, x) for h, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) for i, (x, y) in enumerate(examples(t))]
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["h", "i", "y", "x"])

    drawn = rows.where((F.col("h") < share) & F.col("text").rlike("[0-9@]")).mapInArrow(learn, "h long, i long, y int, x array<double>")
    seen = drawn.orderBy("h", "i", "y", "x").limit(most).toPandas()
    never = Judge(None, dict.fromkeys(KINDS, 2.0))
    if seen.empty:
        return never
    x, y = np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(np.float64)
    held = seen["h"].to_numpy() % 3 == 1
    if not all(0 < part.sum() < len(part) for part in (y[held], y[~held])):
        return never
    model = boosting.fit(x[~held], y[~held])
    boosting.calibrate(model, x[held], y[held])
    p, kind = model.probability(x[held]), x[held, 0].astype(int)
    thresholds = {}
    for k, name in enumerate(KINDS):
        order = np.argsort(-p[kind == k], kind="stable")
        own, right = p[kind == k][order], y[held][kind == k][order]
        good = np.cumsum(right) >= precision * np.arange(1, len(own) + 1)
        last = np.append(own[1:] != own[:-1], True)[: len(own)]  # all candidates of one probability go together
        on = np.flatnonzero(good & last)
        thresholds[name] = max(0.5, float(own[on[-1]])) if len(on) else 2.0
    return Judge(model, thresholds)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, judge: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the base spans' counts by kind and digest, all spans joined, how many of them the trees added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(t or "")
                added = judge.further(t or "", base)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def redact(text: pd.Series, judge: Judge) -> pd.Series:
    """Texts with each span replaced by its kind in brackets."""

    def one(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        out, at = [], 0
        for kind, a, b in sorted(base + judge.further(t, base), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    return text.map(one)

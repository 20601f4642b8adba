"""Operator 4: personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns give the base spans, which always stay. The field looks at islands:
runs of digit groups with their separators, and addresses written with a bracketed "at".
An island is cut into tokens; a segment of at most MAX_TOKENS tokens can be an entity of a
kind, any single token can be outside. A segment is scored as a whole (digit count, shape of
its groups, separators, checksum, what stands before and behind), and dynamic programming
chooses boundaries and kinds of all segments together, with the base spans as segments that are
given. What it chooses beside them is added to the spans.

The field is trained by gradient steps on the conditional likelihood (forward and backward
sums over all segmentations) of a bounded sample of islands: those of SAMPLE_DOCS documents,
at most SAMPLE_ISLANDS, the first PER_DOC of a document, none above ISLAND_CHARS characters.
Their labels are the base spans; each labelled phone and address is
added once more in a form the patterns don't know (no plus sign; bracketed "at"), each card
once more with a wrong check digit, as no entity. Prediction reads every whole text, and what it costs is linear in the text.

Defined results: a null text is empty and has no spans; an empty table gives no rows;
repeated rows stay; without any island to learn from nothing is added; other columns are
ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, returning, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
#: The bounds of the training sample, and of an entity.
SAMPLE_DOCS, SAMPLE_ISLANDS, PER_DOC, ISLAND_CHARS, MAX_TOKENS, MAX_DIGITS = 600, 1200, 20, 200, 15, 19

# The base patterns. The digit runs are possessive and start at a run's begin, which changes
# no match but keeps long runs of digits linear.
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+").match
_local = re.compile(r"[A-Za-z0-9._%+-]*$")
_ip = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_local_chars = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# The islands.
_any = re.compile(r"[0-9@]").search
_digit = re.compile(r"[0-9]").search
_numbers = re.compile(r"(?<![0-9A-Za-z_])\+?\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)*").finditer
_at = re.compile(r"[\[({]\x20?(?:at|AT|@)\x20?[\])}]").finditer
_host = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}])\x20?[A-Za-z0-9-]++)+").match
_tokens = re.compile(r"[0-9]+|[^0-9]").findall


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ascii_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind and start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        end, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _local_chars:
                start -= 1
            m = _domain(text, at) if start < at else None
            if m:
                found.append(("email", start, m.end()))
                end = m.end()
            at = text.find("@", max(at + 1, end))
    if not _digit(text):
        return found
    for m in _ip(text):
        # a part's leading zeros go first: Python reads no number of thousands of digits
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _card(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _ascii_digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(_ascii_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def islands(text: str) -> list[tuple[int, list[str], bool]]:
    """Start, tokens, and whether it is a written address, of each stretch that the field looks at."""
    out = []
    if _digit(text):
        for m in _numbers(text):
            if m.end() - m.start() >= 7 and len(_ascii_digits(m[0])) >= 7:
                out.append((m.start(), _tokens(m[0]), False))
    for m in _at(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = end
        while start and text[start - 1] in _local_chars:
            start -= 1
        if start < end and (host := _host(text, m.end())):
            out.append((start, [text[start : host.end()]], True))
    return out


def features(text: str, start: int, tokens: list[str], i: int, j: int, at: int, end: int, written: bool) -> list[str]:
    """What a segment (tokens ``i`` to ``j``, characters ``at`` to ``end``) is as a whole."""
    before, after = text[at - 1 : at], text[end : end + 1]
    out = ["bias", "written" if written else "number", "edge:" + _side(before) + _side(after)]
    if written:
        return out
    groups = [t for t in tokens[i:j] if t[0].isdigit()]
    seps = "".join(sorted({t for t in tokens[i:j] if not t[0].isdigit()}))
    n = sum(map(len, groups))
    out += [f"digits:{n}", f"groups:{len(groups)}", f"seps:{seps}", f"first:{tokens[i] if not tokens[i].isdigit() else 'd'}"]
    out += ["shape:" + "-".join(str(len(g)) for g in groups[:6]), f"whole:{i == 0 and j == len(tokens)}"]
    if n >= 13:
        out.append(f"luhn:{luhn(''.join(groups))}:{'.' in seps}")
    if len(groups) == 4 and seps == ".":
        out.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


def _side(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"


def segments(text: str, start: int, tokens: list[str], written: bool) -> list[tuple[int, int, int, int, list[str]]]:
    """The candidate entities of an island: token and character bounds, and features."""
    ends, out = [start], []
    for t in tokens:
        ends.append(ends[-1] + len(t))
    for i, first in enumerate(tokens):
        if not (first.isdigit() or first in "+(" or written) or i and first.isdigit() and tokens[i - 1] in "+(":
            continue
        digits = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if tokens[j][0].isdigit():
                digits += len(tokens[j])
                if digits > MAX_DIGITS:
                    break
                if digits >= 7:
                    out.append((i, j + 1, ends[i], ends[j + 1], features(text, start, tokens, i, j + 1, ends[i], ends[j + 1], False)))
            elif written:
                out.append((i, j + 1, ends[i], ends[j + 1], features(text, start, tokens, i, j + 1, ends[i], ends[j + 1], True)))
    return out


class Field:
    """Weights by (kind, feature); an outside token scores 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w: dict[tuple[str, str], float] = defaultdict(lambda: 0.0, weights or {})

    def score(self, kind: str, feats: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), 0.0) for f in feats) - 3.0

    def best(self, n: int, cands: list[tuple]) -> list[tuple[str, int, int]]:
        """Kinds and characters of the entities of the best segmentation of ``n`` tokens."""
        ending = defaultdict(list)
        for i, j, at, end, feats in cands:
            for kind in KINDS:
                s = self.score(kind, feats)
                if s > 0:
                    ending[j].append((s, i, kind, at, end))
        if not ending:
            return []
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for s, i, kind, at, end in ending[j]:
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind, at, end)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                j, kind, at, end = back[j]
                out.append((kind, at, end))
        return out[::-1]

    def step(self, n: int, cands: list[tuple], gold: dict[tuple[int, int], str], rate: float) -> None:
        """One gradient step: features of the labelled segments less their expectation over all segmentations."""
        scored = [(i, j, kind, feats, self.score(kind, feats), gold.get((at, end))) for i, j, at, end, feats in cands for kind in KINDS]
        ending, starting = defaultdict(list), defaultdict(list)
        for x in scored:
            ending[x[1]].append(x)
            starting[x[0]].append(x)
        fore, aft = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fore[j] = _log_sum([fore[j - 1], *(fore[x[0]] + x[4] for x in ending[j])])
        for i in range(n - 1, -1, -1):
            aft[i] = _log_sum([aft[i + 1], *(aft[x[1]] + x[4] for x in starting[i])])
        for i, j, kind, feats, s, label in scored:
            g = (label == kind) - math.exp(fore[i] + s + aft[j] - fore[n])
            if abs(g) > 1e-4:
                for f in feats:
                    self.w[kind, f] += rate * g


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def rewritten(t: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Forms of a text that the base patterns don't know, with their labels."""
    forms = []
    for kind, a, b in base_spans(t):
        if kind == "phone":
            forms.append((t[:a] + t[a + 1 :], [(kind, a, b - 1)]))
        if kind == "card":
            forms.append((t[: b - 1] + str((int(t[b - 1]) + 1) % 10) + t[b:], []))
        if kind == "email":
            name, _, host = t[a:b].partition("@")
            new = f"{name} [at] {host.replace('.', ' [dot] ')}" if len(t) % 2 else f"{name} (at) {host}"
            forms.append((t[:a] + new + t[b:], [(kind, a, a + len(new))]))
    return forms


def train(texts: list[str], rounds: int = 6, rate: float = 0.3) -> dict[tuple[str, str], float]:
    """Weights from stretches of text around islands; labels are their base spans."""
    cases = []
    for t in sorted(set(texts)):
        for text, labels in [(t, base_spans(t)), *rewritten(t)]:
            gold = {(a, b): kind for kind, a, b in labels}
            for start, toks, written in islands(text):
                cands = segments(text, start, toks, written)
                if cands:
                    cases.append((len(toks), cands, gold))
    field = Field()
    for k in range(rounds):
        for n, cands, gold in cases:
            field.step(n, cands, gold, rate / (1 + k))
    return {k: v for k, v in field.w.items() if abs(v) > 1e-6}


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The field's entities that overlap no base span."""
    out = []
    for start, toks, written in islands(text):
        end = start + sum(map(len, toks))
        here = [(a, b) for _, a, b in base if a < end and b > start]
        if any(a <= start and b >= end for a, b in here):
            continue  # nothing is left outside the base span
        # base spans stay, so the segments around them are chosen together given those
        free = [c for c in segments(text, start, toks, written) if all(c[3] <= x or c[2] >= y for x, y in here)]
        out += field.best(len(toks), free)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[tuple[str, str], float]:
    """Train on the islands of a bounded sample of documents that have digits or an at sign."""
    rows = texts_of(docs, id_col, text_col).where(F.col("text").rlike("[0-9]{3}|@"))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()

    def stretches(found: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in found:
            spans = [(s, s + sum(map(len, t))) for s, t, _ in islands(text)] + [(a, b) for k, a, b in base_spans(text) if k == "email"]
            for a, b in spans[:PER_DOC]:
                if b - a <= ISLAND_CHARS:
                    yield doc_id, text[max(0, a - 20) : b + 20]

    sample = map_rows(rows.join(F.broadcast(ids), "doc_id"), "doc_id long, part string", stretches)
    return train([r.part for r in sample.orderBy(F.xxhash64("doc_id", "part"), "part").limit(SAMPLE_ISLANDS).collect()])


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, weights: dict[tuple[str, str], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        field = Field(weights)
        for doc_id, text in rows:
            base = base_spans(text) if _any(text) else []
            spans = base + added_spans(text, base, field)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(texts_of(docs, id_col, text_col), schema, each)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans, the first names the whole."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict[tuple[str, str], float], text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of its texts replaced; null texts stay null, other columns stay as they are."""
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = Field(weights)

        def one(text: str | None) -> str | None:
            if text is None or not (_any(text) or _at(text)):
                return text
            base = base_spans(text)
            return redacted(text, base + added_spans(text, base, field))

        for texts in batches:
            yield texts.map(one)

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from returning(each(batches))

    return small_batches(docs).withColumn(text_col, replace(F.col(f"`{text_col}`")))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))

"""Operator 2: document fingerprints as Merkle trees.

A text is sections of paragraphs, a paragraph is a run of leaves (sentences, cut at
LEAF characters). A section ends behind a blank line or a paragraph whose hash says so, so
that sections re-align behind an insertion. The root hashes the section hashes, these hash
the paragraphs', these the leaves'; leaves cover every character, so roots are equal only
for equal texts. The fingerprint is the whole tree: the root, then section by section (``|``)
the section's hash and paragraph by paragraph (``/``) the paragraph's hash and a code of each
leaf: eight hexadecimal digits and a letter for its length. Comparing trees from the top,
branches of equal hash are skipped and differing ones opened: ``likeness`` weighs what is
shared, ``edits`` aligns branches and locates what was replaced, inserted and deleted.

Defined results: a null text is empty; empty texts are equal to each other (likeness 1) and
have likeness 0 to others; null identifiers come first and stay null; repeated identifiers
are ordered by text; the last document's next is the first, a lone document's is itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of

#: The longest leaf, and one in how many paragraphs ends a section.
LEAF, SECTION = 200, 4
_paragraphs = re.compile(r"[^\n]+\n*|\n+").findall
_leaves = re.compile(r"[^.!?]{1,%d}[.!?]*|[.!?]+" % LEAF).findall


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: Characters of a branch's hash with its separator, and of a leaf's code.
BRANCH, CODE = 13, 9


def _branch(hashes: list[bytes]) -> bytes:
    return _hash(b"".join(hashes))


def fingerprint(text: str) -> str:
    """The tree of a text, as one string."""
    sections: list[list[str]] = []
    above: list[list[bytes]] = []
    ended = True
    for p in _paragraphs(text):
        if ended:
            sections.append([])
            above.append([])
        leaves = _leaves(p)
        own = [_hash(x.encode()) for x in leaves]
        above[-1].append(_branch(own))
        codes = "".join(h[:4].hex() + chr(97 + min(25, len(x) // 8)) for h, x in zip(own, leaves))
        sections[-1].append(above[-1][-1][:6].hex() + "-" + codes)
        ended = p.endswith("\n\n") or above[-1][-1][0] % SECTION == 0
    tops = [_branch(s) for s in above]
    return _branch(tops).hex() + ":" + "|".join(t[:6].hex() + "=" + "/".join(s) for t, s in zip(tops, sections))


def _leaves_of(branches: Counter) -> Counter:
    out: Counter = Counter()
    for b, n in branches.items():
        for i in range(BRANCH, len(b), CODE):
            out[b[i : i + CODE]] += n
    return out


def _weight(leaves: Counter) -> int:
    return sum(n * (2 * (ord(x[-1]) - 97) + 1) for x, n in leaves.items())


def likeness(one: str, other: str) -> float:
    """Shared leaves over all leaves (both sides, by length), 0 to 1; found from the top, so that equal branches are not opened."""
    if one[:32] == other[:32]:
        return 1.0
    a, b = (Counter(x[33:].split("|")) if x[33:] else Counter() for x in (one, other))
    shared = _weight(_leaves_of(_paragraphs_of(a & b)))
    a, b = _paragraphs_of(a - b), _paragraphs_of(b - a)
    shared += _weight(_leaves_of(a & b))
    a, b = _leaves_of(a - b), _leaves_of(b - a)
    rest = _weight(a) + _weight(b)
    shared += _weight(a & b)
    rest -= 2 * _weight(a & b)
    total = 2 * shared + rest
    return 2 * shared / total if total else 0.0


def _paragraphs_of(sections: Counter) -> Counter:
    out: Counter = Counter()
    for s, n in sections.items():
        for p in s[BRANCH:].split("/"):
            out[p] += n
    return out


Node = tuple[str, int, int, str]  # key, first leaf, behind the last leaf, what is below


def _children(nodes: list[Node], level: int) -> list[Node]:
    out = []
    for _, at, _, below in nodes:
        for x in (below.split("/") if level == 1 else [below[i : i + CODE] for i in range(0, len(below), CODE)]):
            n = (len(x) - BRANCH) // CODE if level == 1 else 1
            out.append((x[: BRANCH - 1], at, at + n, x[BRANCH:]) if level == 1 else (x, at, at + 1, ""))
            at += n
    return out


def _sections(mark: str) -> list[Node]:
    out, at = [], 0
    for s in mark[33:].split("|") if mark[33:] else []:
        paragraphs = s[BRANCH:].split("/")
        n = sum((len(p) - BRANCH) // CODE for p in paragraphs)
        out.append((s[: BRANCH - 1], at, at + n, s[BRANCH:]))
        at += n
    return out


def _unaligned(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Runs of ``a`` and ``b`` that are left between equal ones: equal ends, then what occurs once on either side, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
        if i == m and j == n:
            continue
        count, once = Counter(a[i:m]), Counter(b[j:n])
        where = {a[x]: x for x in range(i, m) if count[a[x]] == 1}
        common = [(where[b[y]], y) for y in range(j, n) if once[b[y]] == 1 and b[y] in where]
        anchors = _rising(common)
        if not anchors:
            out.append((i, m, j, n))
        for x, y in anchors:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        if anchors:
            todo.append((i, m, j, n))
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the second) whose first rises."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (x, _) in enumerate(pairs):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [x], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def edits(one: str, other: str) -> list[tuple[int, int, int, int]]:
    """Runs of leaves (first, behind the last) of ``one`` and what they are in ``other``.

    An empty run of ``one`` is an insertion, one of ``other`` a deletion; outside the runs both
    have the same leaves in the same order. Branches of equal hash are not opened.
    """

    def walk(a: list[Node], b: list[Node], begin: tuple[int, int], level: int) -> list[tuple[int, int, int, int]]:
        found = []
        for i, m, j, n in _unaligned([x[0] for x in a], [x[0] for x in b]):
            at = a[i][1] if i < len(a) else a[-1][2] if a else begin[0]
            to = b[j][1] if j < len(b) else b[-1][2] if b else begin[1]
            run = at, a[m - 1][2] if m > i else at, to, b[n - 1][2] if n > j else to
            below = walk(_children(a[i:m], level + 1), _children(b[j:n], level + 1), (at, to), level + 1) if level < 2 and m > i and n > j else []
            found += below or [run]  # differing branches whose leaves' codes are all equal differ as a whole
        return found

    return [] if one[:32] == other[:32] else walk(_sections(one), _sections(other), (0, 0), 0)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the begin of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each bucket's documents in order, followed by the first document of the next bucket (``carry``).

    Buckets are ranges of ``doc_id`` between approximate quantiles, four a shuffle partition;
    what crosses their borders is one document a bucket, so no task holds more than its range.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(low)))
    inner = sorted(set(keyed.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)))
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket") if inner else None

    def bucketed(df: DataFrame) -> DataFrame:
        if cut is None:
            return df.withColumn("bucket", F.lit(0))
        return cut.transform(df.withColumn("as_double", F.col("key").cast("double"))).withColumn("bucket", F.col("bucket").cast("int"))

    firsts = sorted(tuple(r) for r in bucketed(keyed.select("key")).groupBy("bucket").agg(F.min("key").alias("key")).collect())
    to = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    carry = keyed.join(F.broadcast(spark.createDataFrame(to, "key long, bucket int")), "key").withColumn("carry", F.lit(True))
    own = bucketed(keyed).withColumn("carry", F.lit(False))
    cols = ["bucket", "carry", "key", "doc_id", "text"]
    return own.select(cols).unionByName(carry.select(cols)).repartition("bucket").sortWithinPartitions("bucket", "carry", "key", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tree, its edited text's, how alike the trees of the two and of the next document are, and where the edits are.

    ``edits`` has ``from:to>from:to``, comma-joined: leaves of the text and what they are in the edited one.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        bucket = held = None  # the document that waits for its next one, with its fingerprint

        def out(text: str) -> tuple:
            doc_id, own, mark = held
            new, after = edited(own, text), fingerprint(text)
            new_mark = fingerprint(new)
            places = ",".join(f"{a}:{b}>{c}:{d}" for a, b, c, d in edits(mark, new_mark))
            row = doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, after), places
            return row, after

        for b, carry, _, doc_id, text in rows:
            mark = None
            if b == bucket and held:
                row, mark = out(text)
                yield row
                held = None
            if not carry:
                bucket, held = b, (doc_id, text, mark or fingerprint(text))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"
    return map_rows(with_next(docs, id_col, text_col), schema, each)


def op2_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and those of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language identification and fingerprints."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import zstandard
from conftest import EDGES, SF

from hearthlore.llm import language_id, merkle


def test_op1(spark, docs):
    got = language_id.op1_language_id(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in got.collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == want[i] for i in held) >= 0.95 * len(held)
    kept = [i for i in got if not got[i].rejected]
    assert len(kept) >= 0.95 * len(got)


def test_op1_edges(spark, edges, empty, docs):
    model = language_id.fit(docs)
    assert sorted(x for x, _ in model) == ["de", "en", "es", "fr"] and all(len(c) <= language_id.DICT_BYTES for _, c in model)
    got = language_id.identify(edges, model).collect()
    assert len(got) == len(EDGES)
    for r, (i, t) in zip(got, EDGES):
        none = not any(c.isalpha() for c in t or "")
        assert r.doc_id == i and (r.lang_pred == "und") == none and (not none or r.rejected and r.score == 0)
    assert language_id.fit(empty) == []
    assert {r.lang_pred for r in language_id.identify(edges, []).collect()} == {"und"}
    assert language_id.identify(empty, model).collect() == []


def want_fingerprints(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    rows = sorted(rows, key=key)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t) // 4
        new = t[: len(t) - n] + after[:n]
        yield i, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(new)


def test_op2(spark, rows, edges, empty):
    key = lambda r: (r[0] is not None, *map(str, r))
    got = merkle.op2_merkle(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want_fingerprints(rows), key=key)
    text = dict(rows)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.5
    assert sum(r.near_next for r in long) / len(long) < 0.2
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by = {}
    for r in got:
        assert by.setdefault(r.fingerprint, text[r.doc_id]) == text[r.doc_id]
    assert len(by) == len(set(text.values()))
    got = merkle.fingerprints(edges).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want_fingerprints(EDGES), key=key)
    assert merkle.fingerprints(empty).collect() == []
    lone = merkle.fingerprints(edges.where("doc_id = 7")).collect()
    assert [r.near_next for r in lone] == [1.0]


def test_tree():
    text = "One. Two! Three?\nFour five.\n\nSix\n" + "x" * 900
    mark = merkle.fingerprint(text)
    assert merkle.likeness(mark, merkle.fingerprint(text)) == 1 and merkle.edits(mark, mark) == []
    changed = merkle.fingerprint(text.replace("Six", "Six."))
    assert 0.7 < merkle.likeness(mark, changed) < 1
    assert merkle.edits(mark, changed) == [(6, 7, 6, 8)]
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.fingerprint("a") != merkle.fingerprint("a ")


def leaves(text):
    return [x for p in merkle._paragraphs(text) for x in merkle._leaves(p)]


def test_edits_and_likeness_by_brute_force(rows):
    """What lies outside the runs is the same on both sides; likeness is the share of leaves, by length."""
    rng = random.Random(8)
    texts = [t for _, t in rows if t and len(t) < 6000][:60] + ["", "x. y.\n\nz.", "a.\n" * 50, "a. b.\n\n" * 30]
    for _ in range(600):
        one = rng.choice(texts)
        other = one
        for _ in range(rng.randrange(4)):
            at, to = sorted(rng.randrange(len(other) + 1) for _ in range(2))
            other = other[:at] + rng.choice(["", "", "New one. And two.\n\n", "\n", "q"]) + other[min(to, at + rng.choice([0, 3, 60, 900])) :]
        other = rng.choice(texts) if rng.random() < 0.1 else other
        a, b, marks = leaves(one), leaves(other), (merkle.fingerprint(one), merkle.fingerprint(other))
        assert "".join(a) == one and "".join(b) == other
        found, x, y = merkle.edits(*marks), 0, 0
        assert bool(found) == (one != other)
        for i, m, j, n in found:
            assert i <= m and j <= n and (i, m) != (j, n) or m > i or n > j
            assert a[x:i] == b[y:j]
            x, y = m, n
        assert a[x:] == b[y:]
        weigh = lambda c: sum(k * (2 * min(25, len(t) // 8) + 1) for t, k in c.items())
        p, q = Counter(a), Counter(b)
        total = weigh(p) + weigh(q)
        want = 1.0 if one == other else 2 * weigh(p & q) / total if total else 0.0
        assert abs(merkle.likeness(*marks) - want) < 1e-12


def test_edits_are_located():
    mark = merkle.fingerprint
    text = "Alpha one. Beta two.\n\nGamma three."
    assert merkle.edits(mark(text), mark("Alpha one. Beta two.\n\n")) == [(3, 4, 3, 3)]
    assert merkle.edits(mark(text), mark("")) == [(0, len(leaves(text)), 0, 0)]
    assert merkle.edits(mark(""), mark(text)) == [(0, 0, 0, len(leaves(text)))]
    ten = "".join(f"Section {k} has words.\n\n" for k in range(9))
    (run,) = merkle.edits(mark(ten), mark("A new begin.\n\n" + ten))
    assert run == (0, 0, 0, len(leaves("A new begin.\n\n")))


def test_op1_by_brute_force(spark, rows, docs):
    """Every prediction is the smallest sum of compressed pieces, numerals are no letters, ties go to the first."""
    model = language_id.fit(docs)
    extra = [(-1, "\u00bd \u00b2 12 \u2167"), (-2, None), (-3, "ab1cd"), (-4, "the house " * 3000), (-5, "\u65e5\u672c\u8a9e")]
    frame = spark.createDataFrame(rows[:60] + extra, "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    for i, t in rows[:60] + extra:
        own, part = [], ""
        for c in (t or "").lower() + " ":
            letter = unicodedata.category(c)[0] == "L"
            if not letter and part:
                own.append(part)
            part = part + c if letter else ""
        own = " ".join(own).encode()
        if not own:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        sizes = []
        for lang, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=language_id.LEVEL)
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(own[k : k + language_id.CHUNK])) for k in range(0, len(own), language_id.CHUNK)))
        best = sizes.index(min(sizes))
        second = min(sizes[:best] + sizes[best + 1 :])
        assert got[i].lang_pred == model[best][0] and abs(got[i].score - (1 - sizes[best] / second)) < 1e-12
        assert got[i].rejected == (got[i].score < language_id.MIN_MARGIN)
    tied = [("b", b"same words here"), ("a", b"same words here")]
    tie = language_id.identify(spark.createDataFrame([(1, "same words here")], "doc_id long, text string"), tied).collect()[0]
    assert (tie.lang_pred, tie.score, tie.rejected) == ("b", 0.0, True)
    unlabelled = spark.createDataFrame([(1, "text", None), (2, "other text", "x")], "doc_id long, text string, lang string")
    assert [x for x, _ in language_id.fit(unlabelled)] == ["x"]

"""The language model against a dictionary version of it."""

import math
import zlib
from collections import Counter

import pytest
from conftest import EDGES, SF
from pyspark.sql import functions as F

from hearthlore.llm import katz


def HELD():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


class Model:
    """Counts of each order as dictionaries of contexts."""

    def __init__(self, rows, order=2):
        self.order, self.after = order, [{} for _ in range(order)]
        for i, t in rows:
            if not held(i):
                w = tokens(t)
                for k in range(order):
                    for at, x in enumerate(w):
                        self.after[k].setdefault(self.context(w, at, k), Counter())[x] += 1
        self.c = self.after[0].get((), Counter())
        self.n = sum(self.c.values())
        count_of = lambda k: [sum(v == r for c in self.after[k].values() for v in c.values()) for r in range(1, 7)]
        self.d = [self.discounts(count_of(k)) for k in range(order)]
        self.levels = {}

    def context(self, w, at, k):
        return tuple(["start"] * (k - at) + w[max(0, at - k) : at])

    def discounts(self, n):
        common = 6 * n[5] / n[0] if n[0] else 1
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if common < 1 and n[r - 1] else 0
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return out

    def level(self, h):
        if h not in self.levels:
            counts, d = self.after[len(h)].get(h, Counter()), self.d[len(h)]
            total = sum(counts.values())
            used = sum(d.get(v, 1) * v for v in counts.values())
            if not any(v in d for v in counts.values()):
                total += 1
            seen = {w: d.get(v, 1) * v / total for w, v in counts.items()}
            rest = 1 - used / total
            self.levels[h] = seen, rest / (1 - sum(self.p(h[1:], w) for w in seen)) if h else rest
        return self.levels[h]

    def p(self, h, w):
        if h and h not in self.after[len(h)]:
            return self.p(h[1:], w)
        seen, alpha = self.level(h)
        return seen[w] if w in seen else alpha * (self.p(h[1:], w) if h else 1)

    def score(self, w):
        return sum(math.log10(self.p(self.context(w, at, self.order - 1), x)) for at, x in enumerate(w))


def check(got, rows, order=2):
    m = Model(rows, order)
    want = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((m.c[x] + 1) / (m.n + len(m.c) + 1)) for x in w)
        want.append((i, held(i), len(w), sum(m.c[x] > 0 for x in w), m.n, base, m.score(w)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:])), (a, b)
    for k in range(1, order):
        for h in [("start",) * k, ("end",) * k, *list(m.after[k])[:5]]:  # exactly normalised, the unknown token included
            assert math.isclose(sum(m.p(h, w) for w in m.c) + m.p(h, "never seen"), 1)


@pytest.mark.parametrize(("order", "split"), [(1, 1 << 19), (2, 1 << 19), (2, 5), (3, 1 << 19), (3, 3), (4, 2)])
def test_orders_and_split_contexts(spark, monkeypatch, order, split):
    monkeypatch.setattr(katz, "SPLIT", split)
    text = "a b a c a b b d a . the cat the dog the cat sat a b a b a b x y".split()
    rows = [(i, " ".join(text[i % 7 : i % 19 + 3])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(katz.score(frame, HELD(), order, buckets=4).collect(), rows, order)


def test_edges(spark, edges, empty, monkeypatch):
    check(katz.score(edges, HELD(), buckets=3).collect(), EDGES)
    assert katz.score(empty, HELD()).collect() == []
    none = katz.score(edges, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in none)


def test_op8(spark, rows):
    got = katz.op8_katz(spark, SF).collect()
    short = sorted(r[0] for r in rows if len(r[1]) < 3000)[:12]
    assert len(got) == len(rows)
    m, text = Model(rows), dict(rows)
    for r in got:
        w = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(m.c[x] > 0 for x in w), m.n)
        assert math.isclose(r.base_score, sum(math.log10((m.c[x] + 1) / (m.n + len(m.c) + 1)) for x in w), rel_tol=1e-9)
    for r in got:
        if r.doc_id in short:
            assert math.isclose(r.score, m.score(tokens(text[r.doc_id])), rel_tol=1e-9)

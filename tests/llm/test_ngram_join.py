"""The n-gram join against brute force."""

import random

import numpy as np
import pyarrow as pa
from conftest import EDGES, SF

from hearthlore.llm import ngram_join, words
from hearthlore.llm.components import components


def plain_set(text):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y, i, j = sets[a], sets[b], rows[a][0], rows[b][0]
            same = i == j and x and y
            if i is not None and j is not None and x and y and (same or 0.8 * len(x) <= len(y) <= 1.25 * len(x)):
                k = len(x & y)
                if same or 100 * k >= 80 * (len(x) + len(y) - k):
                    u, v = sorted((root(i), root(j)))
                    parent[v] = u
    return [(i, len(s), None if i is None else root(i) if s else i) for (i, _), s in zip(rows, sets)]


KEY = lambda r: tuple((x is not None, x or 0) for x in r)


def test_word_hashes():
    texts = ["The  the\tTHE", "", "thé the", " a\nb\x0bc\x0c\rd ", "é"]
    got = []
    for first, last, offsets, data in words.blocks(pa.array(["skip", *texts]).slice(1)):
        h, at = words.word_hashes(offsets, data)
        got += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [len(x) for x in got] == [3, 0, 2, 4, 1]
    assert len(set(got[0])) == 1 and got[2][1] == got[0][0] and got[2][0] != got[0][0] and len(set(got[3])) == 4


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for trial in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 26, 31, 32, 33, 39, 60, 127, 128, 150, 400]))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        drop, new = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 64, new, dtype=np.uint64)]))
        k = len(np.intersect1d(x, y))
        if 100 * k < 80 * (len(x) + len(y) - k):
            continue
        share, top = rng.choice([0, 0.1, 0.5, 0.9, 1]), rng.integers(1, ngram_join.TOP + 1)
        level = ((rng.random(1 << 16) < share) * rng.integers(1, top + 1, 1 << 16)).astype(np.uint8)
        level = np.tile(level, ngram_join.SKETCH >> 16)
        need = -(-4 * (len(x) + len(y)) // 9)
        early = []
        for own in (x, y):
            *long, short = ngram_join.signatures(own, level)
            assert all(len(k) == len(u) for k, u in long)
            early.append([k[u <= len(own) - need + 1] for k, u in long] + [short])
        assert any(len(np.intersect1d(p, q)) for p, q in zip(*early)), (len(x), len(y), k)


def test_lists_of_any_length(spark, monkeypatch):
    """Equal short lists are one, long ones come in chunks, and nobody is lost."""
    rng, rows = random.Random(3), []
    for key, size in enumerate([1, 2, 3, 7, 8, 9, 16, 17, 60, 2, 3]):
        rows += [(key - 5, f"{k:016d}".encode(), key + 1) for k in range(size) for _ in range(rng.choice([1, 1, 3]))]
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    got = ngram_join._lists(spark.createDataFrame(rows, "key long, cls binary, unit int").coalesce(1)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {}
    for r in got:
        lists.setdefault(bytes(r.list), set()).add((bytes(r.cls), r.unit, r.weight))
    found = sorted((len(x), max(u for _, u, _ in x), max(w for _, _, w in x)) for x in lists.values())
    assert found == [(2, 2, 2), (3, 3, 2), (7, 4, 1), (8, 5, 1), (9, 6, 1), (16, 7, 1), (17, 8, 1), (60, 9, 1)]


def test_parts_of_long_lists(spark, monkeypatch):
    """Members of a long list are dealt evenly, and what belongs to the list reaches every part."""
    monkeypatch.setattr(ngram_join, "CHUNK", 50)
    for routes in (0, 1000):
        monkeypatch.setattr(ngram_join, "ROUTES", routes)
        lists = spark.createDataFrame([(b"a", i) for i in range(500)] + [(b"b", i) for i in range(3)], "list binary, id long")
        parts = ngram_join.Parts(lists)
        joined = parts.one(lists).join(parts.all(lists.groupBy("list").count()), ["list", "salt"]).collect()
        assert sorted((bytes(r.list), r.id, r["count"]) for r in joined) == [(b"a", i, 500) for i in range(500)] + [(b"b", i, 3) for i in range(3)]
        shares = [sum(r.list == b"a" and r.salt == k for r in joined) for k in range(10)]
        assert sum(shares) == 500 and max(shares) < 80


def test_sets_below_the_threshold_hardly_meet(spark):
    """A group that shares 80 to 89 % of its shingles isn't linked, and its pairs don't meet."""
    rng, rows = random.Random(6), []
    shared = [f"s{k}" for k in range(90)]
    for i in range(300):
        rows.append((i, " ".join(shared + [f"o{i}x{k}" for k in range(rng.randint(11, 22))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [words.shingle_sets(o, d) for _, _, o, d in words.blocks(pa.array([t for _, t in rows]))]
    sets = [x for part in sets for x in part]
    counts = np.bincount(np.concatenate(sets).astype(np.int64) & (ngram_join.SKETCH - 1), minlength=ngram_join.SKETCH)
    level = (2 * (counts > 8)).astype(np.uint8)
    lists = []
    for (i, _), own in zip(rows, sets):
        for keys, units in ngram_join.signatures(own, level)[:2]:
            lists += [(str(k).encode(), i, len(own), u) for k, u in zip(keys.tolist(), units.tolist())]
    signed = spark.createDataFrame(lists, "list binary, id long, n int, unit int")
    met = ngram_join.meetings(signed, spark.createDataFrame([], "id long, component long"))
    members = signed.selectExpr("*", "0 AS salt", "id AS component", "max(id) OVER (PARTITION BY list) AS largest")
    compared = sum(x.select("list", "salt", "band").join(y.select("list", "salt", "band"), ["list", "salt", "band"]).count() for x, y in ngram_join.sides(members, ngram_join.Parts(signed)))
    every = signed.groupBy("list").count().selectExpr("sum(count * count)").collect()[0][0]
    assert compared < every / 4, (compared, every)
    want = brute(rows)
    assert sorted(map(tuple, ngram_join.join(frame).collect())) == want
    linked = sum(a < b and 80 * (len(sets[a]) + len(sets[b])) <= 180 * len(np.intersect1d(sets[a], sets[b])) for a in range(300) for b in range(300))
    pairs = met.count()
    assert linked <= pairs <= 2 * linked + 300 and pairs < 300 * 299 // 8, (linked, pairs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        u, v = sorted((root(a), root(b)))
        parent[v] = u
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_op6(spark, rows):
    assert sorted(map(tuple, ngram_join.op6_ngram_join(spark, SF).collect())) == brute(rows)


def test_op6_near_copies(spark, monkeypatch, empty, edges):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 8, 12, 40, 90]))] for _ in range(25)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    rows += [(900 + i, t) for i, t in enumerate(["", None, "a", "A", "a b c d", " a  b\tc d", "a b c d e", "a b c d e f"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute(rows), key=KEY)
    assert sorted(map(tuple, ngram_join.join(frame).collect()), key=KEY) == want
    # every shingle frequent: combinations alone
    monkeypatch.setattr(ngram_join, "_levels", lambda profile: np.tile(np.array([1, 2, 1, 3], np.uint8), ngram_join.SKETCH // 4))
    monkeypatch.setattr(ngram_join, "ROUTES", 0)
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    assert sorted(map(tuple, ngram_join.join(frame).collect()), key=KEY) == want


def test_op6_edges(spark, empty, edges):
    assert sorted(map(tuple, ngram_join.join(edges).collect()), key=KEY) == sorted(brute(EDGES), key=KEY)
    assert ngram_join.join(empty).collect() == []

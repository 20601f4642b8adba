"""Best-fit packing: whole documents, capacity, and bounds against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import EDGES, SF

public = pytest.importorskip("public_tokenizers")

from test_tokens import JSON, crc, library_ids  # noqa: E402

from hearthlore.llm import best_fit  # noqa: E402


def check(pieces, texts, capacity, end=2):
    """Every identifier in one piece, pieces as they have to be cut, sequences gapless and not too long."""
    docs = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert p.ids_crc32 == crc(p.ids) and len(p.ids) == p.length
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    want = defaultdict(list)
    for (i, _), ids in zip(texts, library_ids(t for _, t in texts)):
        ids = [*ids, end]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want[i] += [(k, a, b - a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert {i: sorted((p.piece, p.start, p.length, tuple(p.ids)) for p in own) for i, own in docs.items()} == {i: sorted(x) for i, x in want.items()}
    return len(sequences)


def test_op11(spark, docs, rows, edges, empty):
    packed = best_fit.pack_documents(docs, JSON, with_ids=True)
    made = check(packed.collect(), rows, 1024)
    assert best_fit.certificate(packed, 1024)[0] == made <= best_fit.certificate(packed, 1024)[1] + 1
    check(best_fit.pack_documents(edges, JSON, 16, with_ids=True).collect(), EDGES, 16)
    check(best_fit.pack_documents(edges, JSON, 1, with_ids=True).collect(), EDGES, 1)
    assert best_fit.pack_documents(empty, JSON).collect() == []
    query = best_fit.op11_best_fit(spark, SF)
    assert query.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert query.select("sequence_id").distinct().count() == made


def fewest(lengths, capacity):
    """The least number of sequences, by trying."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                i = rooms.index(room)
                place(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_functions_are_dual_feasible():
    """No packing of one sequence exceeds the function's value of a whole one: an unbounded knapsack."""
    for capacity in (1, 2, 3, 7, 10, 12, 30, 61):
        for f, most in best_fit.dual_feasible(np.arange(capacity + 1), capacity):
            top = [0] * (capacity + 1)
            for c in range(1, capacity + 1):
                top[c] = max([top[c - 1], *(f[x] + top[c - x] for x in range(1, c + 1))])
            assert f[0] == 0 and top[capacity] <= most


def test_bounds_by_brute_force():
    rng, tight = random.Random(2), 0
    for _ in range(300):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 9))]
        least, bound = fewest(lengths, capacity), best_fit.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = best_fit.best_fit_decreasing(sorted(lengths, reverse=True), capacity)
        assert bound <= least <= len(set(bins))
        tight += bound == least
    assert tight >= 290


def test_the_exchange_lowers_the_number(spark, monkeypatch):
    """Many partitions leave a sequence unfilled each; what they give up is packed together."""
    rng = random.Random(4)
    items = [(i, rng.choice([rng.randint(1, 1024), rng.randint(1, 90), rng.randint(340, 520)])) for i in range(6000)]
    frame = spark.createDataFrame(items, "uid long, length long")
    monkeypatch.setattr(best_fit, "ITEMS", 150)
    monkeypatch.setattr(best_fit, "ROUNDS", 1)
    once, bound = best_fit.certificate(best_fit.best_fit(frame, 1024), 1024)
    monkeypatch.setattr(best_fit, "ROUNDS", 6)
    packed = best_fit.best_fit(frame, 1024)
    made, _ = best_fit.certificate(packed, 1024)
    assert bound <= made < once and made - bound <= (once - bound) / 2
    got = packed.collect()
    assert sorted((r.uid, r.length) for r in got) == items
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) == made


def test_argument_checks(spark):
    for lengths, capacity in (([5], 4), ([0], 4), ([1], 0)):
        with pytest.raises(ValueError):
            best_fit.best_fit(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long"), capacity)

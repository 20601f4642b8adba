"""Top-k by no-random-access aggregation against all scores."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from hearthlore.llm import topk


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({i: v for i, v in sorted(ok, reverse=True)}.items()):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return out


def test_op9(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op9_top_k(spark, SF).collect())) == sorted(brute(rows))


@pytest.mark.parametrize("kind", ["ties", "wide"])
def test_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 2)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "RESOLVE", (1000, 3))
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (500, 4)) / 8 if kind == "ties" else rng.normal(size=(500, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())) == sorted(brute(rows))


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, []), (300, [float("inf")])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, ids int")
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())) == sorted(brute(rows))
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_reading_stops_early():
    """Lists with a few outstanding vectors are not read to their ends, whoever asks."""
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (1000, 8))
    x[:12] += 400
    lists = topk.Lists(np.arange(1000), x)
    q = np.abs(rng.integers(1, 50, (5, 8)))
    got = lists.search(q, np.full(5, -1), 10, np.full(5, -np.inf))
    for own, found in zip(q, got):
        assert found == sorted(zip((-(x @ own)).tolist(), range(1000)))[:10]
    assert 0 < lists.read <= x.size // 2
    nothing = topk.Lists(np.arange(1000), x)
    assert nothing.search(q, np.full(5, -1), 10, np.full(5, 1e9)) == [[]] * 5 and nothing.read == 0


def test_beyond_64_bits(spark):
    big = [(k, [1e300 if k == 1 else 1.0]) for k in range(3)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    fits = [(0, [2.0**40, 1.0]), (1, [2.0, 0.0]), (2, [1.0, 2.0**40]), (3, [-4.0, 3.0])]
    frame = spark.createDataFrame(fits, "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(frame, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])
    scaled = [[int(1024 * x) for x in v] for _, v in fits]
    want = sorted((-sum(a * b for a, b in zip(scaled[0], scaled[i])), i) for i in (1, 2, 3))
    assert [(-r.score, r.vec_id) for r in got] == want

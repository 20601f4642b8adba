"""Forms for groups of any size: the same as their windows, and over several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from hearthlore.operators import sampling, scan, sessions

LINES = "session_id long, ts long, turn_id long, player string, start_state string"


def logs(rng, sizes):
    words = ["/state", "/state", "/STATE ", "a", " b ", "", None, "/show", "quit", "/exit"]
    for s, n in enumerate(sizes):
        start = rng.choice([None, f"S{s}"])
        quits = rng.random() < 0.5
        for k in range(n):
            yield s if s else None, rng.randrange(n), k, rng.choice(words if quits and rng.random() < 5 / n else words[:8]), start


def test_replay_of_random_logs(spark):
    rng = random.Random(5)
    rows = list(logs(rng, [rng.randrange(1, 40) for _ in range(60)] + [1500, 700, 1, 2]))
    frame = spark.createDataFrame(rows, LINES).repartition(6)
    cols = ["session_id", "turn_id", "kind", "state"]
    want = sorted(map(tuple, sessions.session_replay(frame).select(cols).collect()), key=str)
    assert sorted(map(tuple, sessions.replay_any(frame).select(cols).collect()), key=str) == want
    assert sessions.replay_any(frame).columns == [*frame.columns, "state", "kind"]
    assert sessions.replay_any(frame.limit(0)).collect() == []


def test_one_session_over_several_tasks(spark):
    """A session of a million lines: its chunks lie in all partitions, and its modes pass their borders."""
    n = 1_000_000
    player = F.expr("CASE WHEN id % 1000 < 3 THEN '/state' WHEN id = 900007 THEN '/quit' ELSE 'line ' || id END")
    frame = spark.range(n).select(F.lit(7).cast("long").alias("session_id"), F.col("id").alias("ts"), F.col("id").alias("turn_id"), player.alias("player"), F.lit(None).cast("string").alias("start_state"))
    rows = scan.ranged(frame, "session_id", ["ts"])
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < n / 2
    got = sessions.replay_any(frame).select("turn_id", "kind", "state")
    counts = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    assert counts["quit"] == 1 and counts["ignored"] == n - 900_008
    window = sessions.session_replay(frame).select("turn_id", "kind", "state")
    assert got.exceptAll(window).count() == 0 and window.exceptAll(got).count() == 0


def test_pieces_make_the_transcript(spark):
    rng = random.Random(2)
    rows = [(s if s else None, rng.randrange(50), k, rng.choice(["hi", " what? ", None, "é" * rng.randrange(30)]), rng.choice(["Aye.", "", "x" * rng.randrange(90)]), None if s == 3 else f"state {s}") for s in range(9) for k in range(rng.choice([1, 5, 300]))]
    log = spark.createDataFrame(rows, "session_id long, ts long, turn_id long, player string, text string, state string").repartition(5)
    want = {r.session_id: r.transcript for r in sessions.transcript_render(log).collect() if r.transcript is not None}
    for size in (1, 7, 1000, 1 << 20):
        found = {}
        for r in sorted(sessions.transcript_pieces(log, size).collect(), key=lambda r: r.piece):
            assert 0 < len(r.text) <= size and r.piece == len(found.setdefault(r.session_id, []))
            found[r.session_id].append(r.text)
        assert all(len(p) == size for ps in found.values() for p in ps[:-1])
        assert {s: "".join(p) for s, p in found.items()} == want
    with pytest.raises(ValueError):
        sessions.transcript_pieces(log, 0)


def scores(spark):
    rng = random.Random(4)
    rows = [(r, i, rng.choice([rng.gauss(0, 3), 1.0, 1.0])) for r, n in enumerate([1, 2, 3, 50, 4000, 17]) for i in range(n)]
    return spark.createDataFrame([(r if r else None, i, x) for r, i, x in rows], "row_id long, item_id long, logit double").repartition(5)


def test_sampling_of_long_rows(spark):
    df = scores(spark).where("row_id IS NOT NULL")
    near = lambda rows, k: sorted((*r[:k], *(round(x, 9) for x in r[k:])) for r in rows)
    cols = ["row_id", "item_id", "p"]
    assert near(sampling.softmax_any(df, 0.7).select(cols).collect(), 2) == near(sampling.temperature_softmax(df, 0.7).select(cols).collect(), 2)
    cols = ["row_id", "item_id", "rank", "p"]
    for top_p in (0.05, 0.5, 0.9, 1.0):
        assert near(sampling.nucleus_any(df, top_p).select(cols).collect(), 3) == near(sampling.nucleus_filter(df, top_p).select(cols).collect(), 3)
    for seed in range(4):
        assert sorted(map(tuple, sampling.draw_any(df, seed).collect())) == sorted(map(tuple, sampling.categorical_draw(df, seed).collect()))
    assert sampling.nucleus_any(scores(spark)).where("row_id IS NULL").count() == 1
    for bad in (lambda: sampling.softmax_any(df, 0), lambda: sampling.nucleus_any(df, 0)):
        with pytest.raises(ValueError):
            bad()


def test_one_row_of_many_candidates(spark):
    """Two million candidates of one row: the sorted ranges lie in all partitions, none holds the half."""
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("row_id"), F.col("id").alias("item_id"), (F.hash("id") % 1000 / 100.0).alias("logit"))
    rows = scan.ranged(df, "row_id", [F.desc("logit"), F.asc("item_id")])
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < n / 2
    kept = sampling.nucleus_any(df, 0.9)
    row = kept.agg(F.count("*").alias("n"), F.max("rank").alias("rank"), F.sum("p").alias("p"), F.max("cum").alias("cum")).collect()[0]
    assert row.n == row.rank and abs(row.p - 1) < 1e-6 and abs(row.cum - 1) < 1e-6
    least = kept.agg(F.min("logit")).collect()[0][0]
    mass = sampling.softmax_any(df).where(F.col("logit") > least).agg(F.sum("p")).collect()[0][0]
    assert mass <= 0.9 + 1e-6

"""Streams over several batches, what leaves their state, and how often a model is asked."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthlore.functions import answers
from hearthlore.operators import sessions
from hearthlore.session import scratch
from hearthlore.streaming import replay, turns

T0 = datetime(2024, 5, 1)
LINES = "session_id long, ts timestamp, turn_id long, player string, start_state string"


def batches(spark, path, frames, schema):
    """A stream that gives one frame a batch."""
    import time

    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, path, log):
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = out.sparkSession.read.schema(out.schema).parquet(path).collect()
    return rows, [op for p in query.recentProgress for op in p["stateOperators"]]


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def line(session, minutes, turn, text, start="S0"):
    return session, T0 + timedelta(minutes=minutes), turn, text, start


def test_sessions_leave_the_store(spark, folder):
    frames = [
        [line(1, 0, 1, "/state"), line(2, 0, 2, "hi"), line(3, 1, 3, "/quit"), line(4, 1, 4, "first", None)],
        [line(1, 10, 5, "new state"), line(3, 11, 6, "ignored"), line(4, 12, 7, "x", None)],
        [line(9, 200, 8, "later")],  # the watermark passes all but the newest, at the end of this batch
        [line(1, 201, 9, "x"), line(3, 201, 10, "again"), line(4, 202, 11, "anew", None), line(1, 1, 12, "late")],
        [line(9, 300, 13, "end")],
    ]
    stream = batches(spark, folder("in"), frames, LINES)
    with replay.rocksdb(spark):
        out = replay.session_stream(stream, delay="5 minutes", idle=timedelta(minutes=60), closed=timedelta(minutes=30))
        rows, ops = run(out, folder("out"), folder("log"))
    got = {r.turn_id: (r.session_id, r.kind, r.state) for r in rows}
    assert got == {
        1: (1, "state_command", "S0"), 2: (2, "turn", "S0"), 3: (3, "quit", "S0"), 4: (4, "state", None), 5: (1, "state", "S0"), 6: (3, "ignored", "S0"), 7: (4, "turn", "first"),
        8: (9, "turn", "S0"), 9: (1, "turn", "S0"), 10: (3, "turn", "S0"), 11: (4, "state", None), 13: (9, "turn", "S0"),
    }
    assert sum(op["numRowsDroppedByWatermark"] for op in ops) == 1
    kept = spark.read.format("statestore").option("stateVarName", "session").load(folder("log")).select("key.session_id").collect()
    assert {r.session_id for r in kept} == {9}
    assert spark.conf.get(replay.PROVIDER, "").find("RocksDB") < 0


def test_replay_in_batches_equals_the_window_form(spark, folder):
    rng, lines = random.Random(3), []
    for k in range(240):
        lines.append(line(rng.randrange(6), k / 10, k, rng.choice(["/state", "/state", "a", "b", " ", "/show", "/quit" if k % 3 == 0 else "c"]), None))
    stream = batches(spark, folder("in"), [lines[i : i + 60] for i in range(0, 240, 60)], LINES)
    with replay.rocksdb(spark):
        rows, _ = run(replay.session_stream(stream), folder("out"), folder("log"))
    want = sessions.session_replay(spark.createDataFrame(lines, LINES)).select("session_id", "turn_id", "kind", "state").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


STATES = [(1, "Your name is Mira. You are a baker from Yew."), (2, None)]


def counting(log):
    def model():
        def say(state, question):
            with open(log, "a") as f:
                f.write(f"{state}|{question}\n")
            return f"I am a cook and say {question}"

        return say

    return model


def asked(log):
    try:
        with open(log) as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def test_the_hook_asks_each_question_once(spark, folder):
    states = spark.createDataFrame(STATES, "npc_id long, state string")
    questions = ["Hello there!", "What do you sell?", "What do you sell?", "Mumble", None, "", "Mumble", "What is your name?"]
    rows = [(10 * n + i, n, q) for i, q in enumerate(questions) for n in (1, 2, 3)]
    table = spark.createDataFrame(rows, "turn_id long, npc_id long, player string").repartition(3)
    joined = answers.turns_with_states(table, states)
    log, at = folder("calls"), scratch(spark, "answers")
    first = turns.fallback_hook(joined, counting(log), answers_at=at)
    got = {r.turn_id: (r.text, r.rule) for r in first.collect()}
    calls = asked(log)
    assert sorted(calls) == sorted(set(calls)) and len(calls) == 7  # four questions of Mira and, of the two without a state, the same as well as a name
    assert first.count() == len(rows) and asked(log) == calls
    assert got[10] == ("Hail, friend. What brings thee here?", "social") and got[11] == got[12] == ("I am Mira, a baker from Yew.", "model_first")
    assert got[23] == got[33] == ("I am a cook and say Mumble", "fallback")
    again = turns.fallback_hook(joined.union(joined.limit(3)), counting(log), answers_at=at)
    assert again.count() == len(rows) + 3 and asked(log) == calls
    more = spark.createDataFrame([(99, 1, "Mutter"), (98, 1, "Mumble")], "turn_id long, npc_id long, player string")
    turns.fallback_hook(answers.turns_with_states(more, states), counting(log), answers_at=at).collect()
    assert len(asked(log)) == len(calls) + 1
    turns.fallback_hook(answers.turns_with_states(more, states), counting(log), answers_at=at, model_name="other").collect()
    assert len(asked(log)) == len(calls) + 3


TURN = "turn_id long, ts timestamp, npc_id long, player string"
TEXT = "turn_id long, generated_at timestamp, raw_text string"


def test_text_that_comes_late(spark, folder):
    """Records before their turn, within the bound, behind it, twice and not at all; the stream says what the tables say."""
    at = lambda m: T0 + timedelta(minutes=m)
    asks = [(1, at(0), 1, "Hello!"), (2, at(0), 1, "Mumble"), (3, at(1), 1, "What do you sell?"), (4, at(1), 1, "Mumble"), (5, at(2), 1, "Mumble"), (6, at(2), 9, "Mumble")]
    texts = [(1, at(1), "x"), (2, at(3), "I am Bob."), (4, at(30), "too late"), (5, at(1), "too early"), (6, at(9), "I am Bob.")]
    pushes = [(7, at(300), 1, "Hello!")], [(7, at(300), "y")]
    states = spark.createDataFrame(STATES, "npc_id long, state string")
    of = lambda df: {r.turn_id: (r.text, r.raw_text, r.rule, r.grounded_applied) for r in df}
    table = turns.respond_with_late_text(spark.createDataFrame(asks + pushes[0], TURN), spark.createDataFrame([*texts, (2, at(4), "a second"), *pushes[1]], TEXT), states)
    want = of(table.collect())
    assert want == {
        1: ("Hail, friend. What brings thee here?", "x", "social", True), 2: ("I am Mira, a baker from Yew.", "I am Bob.", "fallback", True),
        3: ("I know not.", None, "model_first", True), 4: ("I know not.", None, "fallback", True), 5: ("I know not.", None, "fallback", True),
        6: ("I am Bob.", "I am Bob.", "fallback", False), 7: ("Hail, friend. What brings thee here?", "y", "social", True),
    }
    late = (8, at(0), 1, "What do you sell?")  # behind the watermark when it comes
    asked_stream = batches(spark, folder("asks"), [asks[:3], asks[3:], pushes[0], [late]], TURN)
    text_stream = batches(spark, folder("texts"), [texts[:1], texts[1:], pushes[1]], TEXT)
    rows, _ = run(turns.respond_with_late_text(asked_stream, text_stream, states), folder("out"), folder("log"))
    assert len(rows) == 8 and of(rows) == want | {8: ("I know not.", None, "model_first", True)}


def test_late_text_query_is_complete(spark):
    got = turns.late_text_query(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert got.where(F.col("raw_text").isNull()).count() == 0

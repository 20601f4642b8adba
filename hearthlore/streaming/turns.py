"""Turns as they arrive, and a model for the turns that no rule answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, persona, rules, text
from ..session import scratch, table, written
from ..sources import fixtures
from .replay import rocksdb, session_stream


def drained(out: DataFrame, what: str) -> DataFrame:
    """What a stream has for now, written to files and read back."""
    spark = out.sparkSession
    path = scratch(spark, what)
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, what + "-log")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the events file as a stream."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    n = table(spark, sf_dir, "supplier").count()
    return fixtures.over(spark, fixtures.TURN.replace("(SELECT count(*) FROM supplier)", str(n)), {"events": stream})


def respond_stream(turns: DataFrame, states: DataFrame, seed: int | None = None) -> DataFrame:
    """Answers to a stream of turns: a join with the static states and stateless rules, so there is no watermark."""
    return answers.grounded(answers.turns_with_states(turns, states), seed).select("turn_id", "text", "rule")


def _key(*parts: Column) -> Column:
    """A hash of texts that no other texts share: each goes with its length."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p))), 256)


ANSWER_SCHEMA = "key string, answer string"


def fallback_hook(joined: DataFrame, model: Callable[[], Callable[[str, str], str]], seed: int | None = None, answers_at: str | None = None, model_name: str = "") -> DataFrame:
    """``turn_id, text, rule`` where only turns without an answer of their own reach the model, and no question does twice.

    ``model`` is called once a Python worker and returns a function of state and question.
    Its answers go to a table in ``answers_at`` (a new one in the shared folder, if none is
    named), keyed by a hash of ``model_name``, state and question: the distinct open questions
    that the table lacks are asked and appended, then all turns take their answers from it. A
    further run over the same turns asks nothing. Turns are worked out once and written before
    the model is asked; a task that is run again may ask again, but only one answer is kept.
    For answered turns there is no model text, so a comparison with it says grounded. A null
    state or question counts as empty.
    """
    spark = joined.sparkSession

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        say = model()
        for states, questions in batches:
            yield pd.Series([say(s, q) for s, q in zip(states, questions)], dtype="object")

    ruled = answers.grounded(joined.withColumn("raw_text", F.lit("")), seed).withColumn("open", F.col("rule").isin("model_first", "fallback"))
    state, question = (F.coalesce(c, F.lit("")) for c in ("state", "player"))
    # turns that ask nothing have keys of their own, so that they don't meet in one task
    key = F.when(F.col("open"), _key(F.lit(model_name), state, question)).otherwise(F.concat(F.lit("turn "), F.col("turn_id").cast("string")))
    asks = {"asked_state": F.when(F.col("open"), state), "asked": F.when(F.col("open"), question)}
    rows = written(ruled.select("turn_id", "rule", F.col("text").alias("ruled"), "persona", "open", key.alias("key"), *(c.alias(n) for n, c in asks.items())), "ruled")

    at = answers_at or scratch(spark, "answers")
    spark.createDataFrame([], ANSWER_SCHEMA).write.mode("ignore").parquet(at)
    known = spark.read.schema(ANSWER_SCHEMA).parquet(at)
    open_ones = rows.where("open").groupBy("key").agg(F.first("asked_state").alias("state"), F.first("asked").alias("player"))  # equal for equal keys
    open_ones.join(known, "key", "left_anti").select("key", ask("state", "player").alias("answer")).write.mode("append").parquet(at)

    said = spark.read.schema(ANSWER_SCHEMA).parquet(at).groupBy("key").agg(F.min("answer").alias("raw_text"))  # runs side by side may both have asked
    answered = rows.join(said, "key", "left")
    text = F.when(F.col("open"), persona.repaired()).otherwise(F.col("ruled"))
    return persona.with_claims(answered.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))).select("turn_id", text.alias("text"), "rule")


def respond_with_late_text(turns: DataFrame, generation: DataFrame, states: DataFrame, within: str = "10 minutes", delay: str = "10 minutes", seed: int | None = None) -> DataFrame:
    """Answers where the model's text comes later than its turn: ``turn_id, ts, text, raw_text, rule, grounded_applied``, of streams or tables.

    ``turns`` has ``turn_id, ts, npc_id, player``; ``generation`` has ``turn_id, generated_at``
    and ``raw_text``. A record counts from its turn's time up to ``within`` later, the first of
    several; times that lie more than ``delay`` behind the newest are too late. A turn without
    a record is given out when none can come any more, with what the rules say where there is
    no model; its ``raw_text`` is null and ``grounded_applied`` true. On streams a turn whose
    record comes twice is given out twice, since the first one isn't kept; append mode.
    """
    ruled = answers.grounded(answers.turns_with_states(turns.withColumn("raw_text", F.lit("")), states), seed)
    names = [c for c in ruled.columns if c.startswith("answer_")]
    alone = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit(rules.UNKNOWN))
    ruled = ruled.select("turn_id", "ts", "rule", "persona", F.col("text").alias("ruled"), alone.alias("alone")).withWatermark("ts", delay)
    late = generation.select(F.col("turn_id").alias("of"), "generated_at", F.coalesce("raw_text", F.lit("")).alias("model_text")).withWatermark("generated_at", delay)
    if not generation.isStreaming:
        late = late.groupBy("of", "generated_at").agg(F.min("model_text").alias("model_text"))
    in_time = (F.col("turn_id") == F.col("of")) & (F.col("generated_at") >= F.col("ts")) & (F.col("generated_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    met = ruled.join(late, in_time, "left")
    if not generation.isStreaming:
        met = met.groupBy(*ruled.columns).agg(F.min_by("model_text", "generated_at").alias("model_text"))
    open_ = F.col("rule").isin("model_first", "fallback")
    text = F.when(F.col("raw_text").isNull(), F.col("alone")).when(open_, persona.repaired()).otherwise(F.col("ruled"))
    out = persona.with_claims(met.withColumnRenamed("model_text", "raw_text")).withColumn("text", text)
    return out.select("turn_id", "ts", "text", "raw_text", "rule", F.coalesce(F.col("text") != F.col("raw_text"), F.lit(True)).alias("grounded_applied"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.npc_profile(spark, sf_dir)
    return p.select("npc_id", text.state_render(*(F.col(c) for c in ("name", "role", "home", "facts"))).alias("state"))


def respond_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return drained(respond_stream(turn_stream(spark, sf_dir), states), "respond-stream")


def session_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay as a stream, whose state is that of sessions which are neither closed nor idle."""
    start = _states(spark, sf_dir).select("npc_id", F.col("state").alias("start"))
    log = turn_stream(spark, sf_dir).join(start, "npc_id", "left").withColumn("start_state", F.when(F.col("session_id") % 3 != 0, F.col("start")))
    with rocksdb(spark):
        return drained(session_stream(log.select("session_id", "ts", "turn_id", "player", "start_state")), "session-stream")


def late_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and the model's texts as two streams, joined in time: a text comes up to five minutes behind its turn."""
    turns = turn_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    wait = F.make_dt_interval(secs=(F.col("turn_id") % 301).cast("decimal(18,6)"))
    generation = turn_stream(spark, sf_dir).select("turn_id", (F.col("ts").cast("timestamp") + wait).alias("generated_at"), "raw_text")
    out = respond_with_late_text(turns.drop("raw_text"), generation, _states(spark, sf_dir))
    return drained(out.select("turn_id", "text", "raw_text", "rule", "grounded_applied"), "late-text")


def echo_model() -> Callable[[str, str], str]:
    """A stand-in for a model: it repeats the first word of the question and claims a wrong trade for short ones."""
    return lambda state, question: f"I work as a cook, {question.split(' ')[0]}" if len(question) < 15 else f"Aye, {question.split(' ')[0]}  it is."


def fallback_hook_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fixtures.turns(spark, sf_dir)
    return fallback_hook(answers.turns_with_states(turns, _states(spark, sf_dir)), echo_model)

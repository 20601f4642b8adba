"""The fact that fits a question best, by an inverted index from words to facts.

``functions.facts.relevant_fact`` scores all facts of a character for each turn. Here a question's
words find the facts that have them, and only those are counted. Facts that share no word can
still win by what kind they are (of a place, a time, a price); of each kind only the character's
first one can, so there are at most eight of those. Each distinct question of a character is
looked up once, however many turns ask it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import contains_any
from ..session import written

#: What a question may ask for, the kind of fact that suits it, and what that is worth.
BOOSTS = [
    (rules.WHERE_PHRASES, rules.PLACE_TERMS, 3),
    (rules.WHEN_PHRASES, rules.TIME_TERMS, 3),
    (rules.PRICE_PHRASES, ["copper"], 4),
]


def _flags(text: Column, lists: list[list[str]]) -> Column:
    """A bit for each list of which the text contains a phrase."""
    return sum((F.when(contains_any(text, x), 1 << i).otherwise(0) for i, x in enumerate(lists)), F.lit(0)).cast("int")


def _worth(asked: Column, kind: Column) -> Column:
    both = asked.bitwiseAND(kind)
    return sum((F.when(both.bitwiseAND(1 << i) != 0, n).otherwise(0) for i, (_, _, n) in enumerate(BOOSTS)), F.lit(0))


def fact_index(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``npc_id, word, idx, kind`` and, of each character and kind, the first fact, from ``npc_id, idx, norm``."""
    kinds = written(facts.select("npc_id", "idx", "norm", _flags(F.col("norm"), [terms for _, terms, _ in BOOSTS]).alias("kind")), "kinds")
    words = kinds.select("npc_id", F.explode(F.array_distinct(F.split("norm", " "))).alias("word"), "idx", "kind").where("word <> ''")
    firsts = kinds.groupBy("npc_id", "kind").agg(F.min("idx").alias("idx"))
    return words, firsts.groupBy("npc_id").agg(F.collect_list(F.struct("kind", "idx")).alias("firsts"), F.min("idx").alias("first"))


def retrieve(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """``turns`` (with ``npc_id`` and ``q``) with ``fact``: as ``relevant_fact`` has it, null for a character without facts, and for a turn without a question.

    ``facts`` has ``npc_id, idx, fact, norm``, a row a fact; ``idx`` is the facts' order.
    """
    words, firsts = fact_index(facts)
    asked = turns.select("npc_id", "q").distinct().where("npc_id IS NOT NULL AND q IS NOT NULL")
    asked = written(asked.withColumns({"ask": F.monotonically_increasing_id(), "flags": _flags(F.col("q"), [phrases for phrases, _, _ in BOOSTS])}), "asked")
    stop = F.array(*map(F.lit, rules.STOP_WORDS))
    terms = asked.select("ask", "npc_id", "flags", F.explode(F.array_except(F.split("q", " "), stop)).alias("word")).where("word <> ''")
    shared = terms.join(words, ["npc_id", "word"]).groupBy("ask", "flags", "idx", "kind").agg(F.count("*").alias("n"))
    best = shared.groupBy("ask").agg(F.max(F.struct((F.col("n") + _worth(F.col("flags"), F.col("kind"))).alias("score"), (-F.col("idx")).alias("at"))).alias("best"))
    found = asked.join(firsts, "npc_id").join(best, "ask", "left")
    by_kind = F.array_max(F.transform("firsts", lambda x: F.struct(_worth(F.col("flags"), x["kind"]).cast("long").alias("score"), (-x["idx"]).alias("at"))))
    top = F.greatest(F.col("best"), by_kind)
    picked = found.withColumn("top", top).select("npc_id", "q", F.when(F.col("top.score") > 0, -F.col("top.at")).otherwise(F.col("first")).alias("idx"))
    answers = picked.join(facts.select("npc_id", "idx", "fact"), ["npc_id", "idx"]).select(F.col("npc_id").alias("of"), F.col("q").alias("to"), "fact")
    return turns.join(answers, (F.col("npc_id") == F.col("of")) & (F.col("q") == F.col("to")), "left").drop("of", "to")

"""Answer rules as a table: any number of them, without a larger plan.

A rule table has one row an alternative of a rule: ``family``, ``rank`` (the first that holds
answers), ``answer`` and ``tests``, all of which must hold. A test is ``side``, ``op`` and
``phrase``, side ``q`` (the question) or ``s`` (the state), both normalized; the phrase is a
part of the text (``:``), the whole text (``=``), or its first words (``^``).

Rules are proposed by an index: each phrase is filed under the one of its character trigrams that
the fewest phrases have (a shorter phrase under itself). The distinct texts' trigrams, joined
with it, propose phrases, which are then compared with the text. A rule's tests that hold are
counted by text, so questions and states meet only in rules that test both. What travels grows
with the distinct texts and the rules that hold, not with turns times rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import written

GRAM = 3
RULE_SCHEMA = "family string, rank int, answer string, tests array<struct<side:string,op:string,phrase:string>>"
Tests = list[tuple[str, str, str]]


def _alternatives(tests: tuple[str, ...]) -> list[Tests]:
    """Tests as they stand in the fixed rules; a pattern of first words is an alternative for each word."""
    out: list[Tests] = [[]]
    for t in tests:
        side, op, what = t[0], t[1], t[2:]
        if op == "~":
            words = re.fullmatch(r"\^\((.*)\)\\b", what)
            if not words:
                raise ValueError(f"a pattern that isn't a choice of first words: {what}")
            out = [[*a, (side, "^", w)] for a in out for w in words[1].split("|")]
        else:
            out = [[*a, (side, op, what)] for a in out]
    return out


def rows_of(family: str, table: list[tuple[list[tuple[str, ...]], str]]) -> list[tuple]:
    """The rows of a fixed rule list."""
    return [(family, rank, answer, tests) for rank, (condition, answer) in enumerate(table) for alternative in condition for tests in _alternatives(alternative)]


def fixed_rules(spark: SparkSession) -> DataFrame:
    """The library's own rules and gates; a gate's answer is ``yes``."""
    any_of = lambda phrases: [(f"q:{p}",) for p in phrases]
    home = [(f"q:{a}", f"q:{b}") for a in rules.HOME_ASKS for b in rules.HOME_WORDS]
    model = any_of(rules.HOME_PHRASES) + home + any_of(rules.WARES_PHRASES) + any_of(rules.WARES_WORDS)
    baker = [(*a, *b) for a in rules.CAKE for b in rules.CAKE_BAKER]
    tables = {
        "social": rules.SOCIAL, "practical": rules.PRACTICAL, "antidote": [(rules.ANTIDOTE, "yes")], "capability": [(baker, rules.CAKE_AYE), (rules.CAKE, rules.CAKE_NAY)],
        "world": rules.WORLD, "uncertainty": rules.UNCERTAINTY, "model_first": [(model, "yes")], "fact_trigger": [(any_of(rules.FACT_TRIGGERS), "yes")],
        "numeric_gate": [(any_of(rules.NUMERIC_GATE), "yes")],
    }
    return spark.createDataFrame([r for family, table in tables.items() for r in rows_of(family, table)], RULE_SCHEMA)


#: The families of ``fixed_rules`` that answer, and those that only open a gate.
ANSWERING = ["social", "practical", "capability", "world", "uncertainty"]
GATES = ["antidote", "model_first", "fact_trigger", "numeric_gate"]


def _grams(text: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size)))))


def _holds(text: str, op: str, phrase: str) -> Column:
    t, p = F.col(text), F.col(phrase)
    begins = t.startswith(p) & ~F.substring(t, F.length(p) + 1, F.lit(1)).rlike("[a-z0-9]")
    return F.when(F.col(op) == ":", t.contains(p)).when(F.col(op) == "=", t == p).otherwise(begins)


class Rulebook:
    """A rule table, its tests and the index of their phrases, written once for any number of uses."""

    def __init__(self, table: DataFrame):
        named = written(table.select("family", "rank", "answer", F.array_distinct("tests").alias("tests")).withColumn("rule", F.monotonically_increasing_id()), "rules")
        each = named.select("rule", F.inline("tests"))
        need = each.groupBy("rule").agg(*(F.count_if(F.col("side") == s).alias(f"need_{s}") for s in "qs"))
        self.rules = written(named.drop("tests").join(need, "rule"), "needs")
        self.tests = written(each, "tests")
        phrases = each.select("side", "op", "phrase").distinct()
        own = F.explode(F.when(F.length("phrase") < GRAM, F.array("phrase")).otherwise(_grams(F.col("phrase"), GRAM)))
        grams = phrases.select("*", own.alias("gram"))
        often = grams.groupBy("gram").agg(F.count("*").alias("n"))
        anchor = grams.join(often, "gram").groupBy("side", "op", "phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        self.index = written(anchor, "index")
        self.sizes = [r[0] for r in self.index.select(F.length("gram")).distinct().collect()]  # at most GRAM

    def matches(self, texts: DataFrame, text: str, side: str) -> DataFrame:
        """``text, fired``: for each distinct text, the rules whose tests of this side all hold, with what the other side still has to show."""
        distinct = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
        own = F.explode(F.array_distinct(F.concat(*[F.coalesce(_grams(F.col("text"), n), F.array().cast("array<string>")) for n in self.sizes]))) if self.sizes else F.explode(F.array().cast("array<string>"))
        index = self.index.where(F.col("side") == side).drop("side")
        proposed = distinct.select("text", own.alias("gram")).join(index, "gram").where(_holds("text", "op", "phrase")).select("text", "op", "phrase")
        met = proposed.join(self.tests.where(F.col("side") == side), ["op", "phrase"]).groupBy("text", "rule").agg(F.count("*").alias("n"))
        other = "s" if side == "q" else "q"
        whole = met.join(self.rules, "rule").where(F.col("n") == F.col(f"need_{side}"))
        fired = F.collect_list(F.struct("rule", "family", "rank", "answer", (F.col(f"need_{other}") > 0).alias("both")))
        return whole.groupBy("text").agg(fired.alias("fired"))


def rule_answers(turns: DataFrame, book: Rulebook, families: list[str]) -> DataFrame:
    """``turns`` (with ``q`` and ``s``) with a column for each family: the answer of its first rule that holds, or null."""
    none = F.array().cast("array<struct<rule:bigint,family:string,rank:int,answer:string,both:boolean>>")
    out = turns
    for side in "qs":
        found = book.matches(turns, side, side).select(F.col("text").alias(f"text_{side}"), F.col("fired").alias(f"fired_{side}"))
        out = out.join(found, F.col(side) == F.col(f"text_{side}"), "left").withColumn(f"fired_{side}", F.coalesce(f"fired_{side}", none)).drop(f"text_{side}")
    alone = lambda c: F.filter(c, lambda x: ~x["both"])
    shared = F.filter("fired_q", lambda x: x["both"] & F.array_contains(F.col("fired_s.rule"), x["rule"]))
    out = out.withColumn("fired", F.concat(alone("fired_q"), alone("fired_s"), shared)).drop("fired_q", "fired_s")

    def first(family: str) -> Column:
        own = F.transform(F.filter("fired", lambda x: x["family"] == family), lambda x: F.struct(x["rank"].alias("rank"), x["answer"].alias("answer")))
        return F.array_min(own)["answer"]

    return out.withColumns({f: first(f) for f in families}).drop("fired")

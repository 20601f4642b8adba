"""The rule table against the compiled rules and brute force; the fact index against scoring all facts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hearthlore.functions import answers, facts, rules
from hearthlore.operators import retrieval, rulebook


def spoken(rng, table):
    """A text for each alternative of each rule, in which its tests hold, among other words."""
    for condition, _ in table:
        for tests in condition:
            sides = {"q": [], "s": []}
            for t in tests:
                what = t[2:] if t[1] != "~" else rng.choice(re.fullmatch(r"\^\((.*)\)\\b", t[2:])[1].split("|"))
                sides[t[0]] += [what] if t[1] == "=" else [what, rng.choice(["", "x", "and rain", "the end"])] if t[1] == "~" else [rng.choice(["", "well", "so"]), what + rng.choice(["", "s", " now"])]
            yield [" ".join(filter(None, sides[s])) for s in "qs"]


def test_every_fixed_rule_fires_alike(spark):
    rng, gates = random.Random(1), [[(f"q:{p}",)] for x in (rules.HOME_PHRASES, rules.WARES_PHRASES, rules.WARES_WORDS, rules.FACT_TRIGGERS, rules.NUMERIC_GATE) for p in x]
    tables = [rules.SOCIAL, rules.PRACTICAL, rules.WORLD, rules.UNCERTAINTY, [(rules.ANTIDOTE, "")], [([(*a, *b) for a in rules.CAKE for b in rules.CAKE_BAKER], "")], [(rules.CAKE, "")], [(c, "") for c in gates]]
    texts = [pair for t in tables for pair in spoken(rng, t)]
    qs, ss = [q for q, _ in texts], [s for _, s in texts]
    texts += [(rng.choice(qs), rng.choice(ss)) for _ in range(600)] + [("hailstorm", "x"), ("hail's", "x"), ("", ""), (None, "dough"), ("thank", None), ("good day", ""), ("a good day", "")]
    df = spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(texts)], "turn_id long, q string, s string").repartition(4)
    q, s = F.col("q"), F.col("s")
    want = df.select(
        "turn_id", answers.social_answer(q).alias("social"), answers.first_rule(rules.PRACTICAL, {"q": q, "s": s}).alias("practical"), answers.capability_answer(q, s).alias("capability"),
        answers.world_answer(s).alias("world"), answers.uncertainty_answer(s).alias("uncertainty"),
        *(F.coalesce(c, F.lit(False)).alias(n) for n, c in (("antidote", answers.holds(rules.ANTIDOTE, {"q": q, "s": s})), ("model_first", answers.model_first(q)), ("fact_trigger", answers.fact_trigger(q)), ("numeric_gate", answers.numeric_gate(q)))),
    )
    book = rulebook.Rulebook(rulebook.fixed_rules(spark))
    got = rulebook.rule_answers(df, book, rulebook.ANSWERING + rulebook.GATES)
    got = got.select("turn_id", *rulebook.ANSWERING, *(F.col(g).isNotNull().alias(g) for g in rulebook.GATES))
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))
    said = {v for r in rows for v in r[1:6]}
    every = {a for t in (rules.SOCIAL, rules.PRACTICAL, rules.WORLD, rules.UNCERTAINTY) for _, a in t} | {rules.CAKE_AYE, rules.CAKE_NAY}
    assert every <= said and all(any(r[g] for r in rows) for g in rulebook.GATES)


def plain_answer(table, family, q, s):
    best = None
    for f, rank, answer, tests in table:
        text = {"q": q, "s": s}
        holds = lambda side, op, p: text[side] is not None and (p in text[side] if op == ":" else p == text[side] if op == "=" else re.match(re.escape(p) + r"(?![a-z0-9])", text[side]) is not None)  # noqa: E731, B023
        if f == family and all(holds(*t) for t in tests) and (best is None or (rank, answer) < best):
            best = rank, answer
    return best and best[1]


def made_up(rng, n):
    words = ["a", "ab", "abc", "bcd", "cd e", "xyz", "yz", "q", "gate", "gates", "the gate"]
    for k in range(n):
        tests = [(rng.choice("qs"), rng.choice("::=^"), " ".join(rng.choices(words, k=rng.randint(1, 2)))) for _ in range(rng.randint(1, 3))]
        yield rng.choice("fg"), k % 50, f"answer {k}", tests


def test_random_rules_by_brute_force(spark):
    rng = random.Random(2)
    table = list(made_up(rng, 300))
    texts = [tuple(None if rng.random() < 0.03 else " ".join(rng.choices(["abc", "bcd", "cd", "e", "xyz", "q", "gate", "gates", "a", "the"], k=rng.randint(0, 4))) for _ in "qs") for _ in range(400)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "turn_id long, q string, s string").repartition(3)
    got = rulebook.rule_answers(df, rulebook.Rulebook(spark.createDataFrame(table, rulebook.RULE_SCHEMA)), ["f", "g"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.f, r.g) == tuple(plain_answer(table, f, r.q, r.s) for f in "fg"), r
    none = rulebook.Rulebook(spark.createDataFrame([], rulebook.RULE_SCHEMA))
    assert {r.f for r in rulebook.rule_answers(df, none, ["f"]).collect()} == {None}
    with pytest.raises(ValueError):
        rulebook.rows_of("f", [([("q~a.*b",)], "x")])


def test_ten_thousand_rules_have_no_larger_plan(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrase = lambda: "".join(rng.choices(letters, k=rng.randint(4, 9)))
    table = [("f", k, f"answer {k}", [("q", ":", phrase()), *([("s", ":", phrase())] if k % 3 == 0 else [])]) for k in range(10_000)]
    picked = rng.sample(table, 150)
    df = spark.createDataFrame([(i, f"so {t[3][0][2]} it is", t[3][-1][2] if len(t[3]) > 1 and i % 2 else "none") for i, t in enumerate(picked)], "turn_id long, q string, s string")
    size = {}
    for n in (100, 10_000):
        found = rulebook.rule_answers(df, rulebook.Rulebook(spark.createDataFrame(table[:n], rulebook.RULE_SCHEMA)), ["f"])
        size[n] = len(re.sub(r"[#/].*?(?=[,\s\]\)])", "", found._jdf.queryExecution().optimizedPlan().toString()))
    assert size[10_000] < 1.1 * size[100]
    assert {r.turn_id: r.f for r in found.collect()} == {r.turn_id: plain_answer(table, "f", r.q, r.s) for r in df.collect()}


def index_rows(rng, characters):
    words = "road gate dawn bell copper bread the of pie market noon east cost loaf".split()
    return [(c, i, f"Fact {i}", " ".join(rng.choices(words + ["x"] * 5, k=rng.randint(0, 6)))) for c, n in characters for i in range(n)]


def asked_of(rng, characters, n):
    starts = ["where", "when", "how much", "what time", "which road", "who", "price of", ""]
    return [(k, rng.choice([c for c, _ in characters] + [None, 99]), None if rng.random() < 0.02 else f"{rng.choice(starts)} {' '.join(rng.choices('gate bread pie x loaf the is bell'.split(), k=rng.randint(0, 3)))}".strip()) for k in range(n)]


def test_index_finds_the_relevant_fact(spark):
    rng = random.Random(4)
    characters = [(1, 0), (2, 1), (3, 2), (4, 12), (5, 60)]
    table = spark.createDataFrame(index_rows(rng, characters), "npc_id long, idx int, fact string, norm string")
    turns = spark.createDataFrame(asked_of(rng, characters, 1500), "turn_id long, npc_id long, q string").repartition(4)
    got = {r.turn_id: r.fact for r in retrieval.retrieve(turns, table).collect()}
    whole = table.groupBy(F.col("npc_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("idx", "fact", "norm"))).alias("f"))
    joined = turns.join(whole, F.col("npc_id") == F.col("c"), "left")
    want = {r.turn_id: r.v for r in joined.select("turn_id", facts.relevant_fact(F.col("f.fact"), F.col("f.norm"), F.col("q")).alias("v")).collect()}
    unasked = {r.turn_id for r in turns.where("q IS NULL").collect()}
    assert len(got) == 1500 and all(got[t] is None for t in unasked)
    assert {t: v for t, v in got.items() if t not in unasked} == {t: v for t, v in want.items() if t not in unasked}


def test_ten_thousand_facts_a_character(spark):
    rng = random.Random(5)
    rows = [(1, i, f"Fact {i}", f"word{i} word{i % 500} filler") for i in range(10_000)] + [(1, 10_000, "The road", "road filler")]
    turns = [(k, 1, f"what is word{rng.randrange(10_000)}") for k in range(3000)] + [(3000, 1, "where do i go"), (3001, 1, "nothing known")]
    table, asked = spark.createDataFrame(rows, "npc_id long, idx int, fact string, norm string"), spark.createDataFrame(turns, "turn_id long, npc_id long, q string")
    got = {r.turn_id: r.fact for r in retrieval.retrieve(asked, table).collect()}
    for k, _, q in turns[:3000]:
        n = int(q.split("word")[1])
        assert got[k] == f"Fact {n}"
    assert got[3000] == "The road" and got[3001] == "Fact 0"

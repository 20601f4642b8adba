"""Answer rules over questions (``q``) and states, and the cascade of all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .facts import numeric_answer, price_lines, price_pairs, relevant_fact
from .persona import persona, persona_fallback, persona_norms, repaired, with_claims
from .text import article, capitalize, contains_any, fact_sentences, first_rule, holds, lead_in_strip, norm, sentences

# The patterns of questions that suppose a trade.
ASKED_TRADE = [
    r"^(?:and\s+)?(?:are you|art thou|be you)\s+(?:a|an|the)?\s*(.+?)\s*[?!.]?$",
    r"^(?:and\s+)?(?:you are|you're|you)\s+(?:a|an|the)?\s*(.+?)(?:\s+right)?\s*[?!.]?$",
]


def social_answer(q: Column) -> Column:
    return first_rule(rules.SOCIAL, {"q": q})


#: The first practical rule that looks at the question; those before it depend on the state alone.
ASKING = next(i for i, (condition, _) in enumerate(rules.PRACTICAL) if any(t[0] == "q" for tests in condition for t in tests))


def practical_state(s: Column) -> Column:
    """The practical answer that the state alone decides."""
    return first_rule(rules.PRACTICAL[:ASKING], {"s": s})


def practical_answer(known: Column, q: Column, s: Column, fact: Column) -> Column:
    """``known`` is ``practical_state``."""
    sides = {"q": q, "s": s}
    return F.coalesce(known, first_rule(rules.PRACTICAL[ASKING:], sides), F.when(holds(rules.ANTIDOTE, sides), fact))


def capability_answer(q: Column, s: Column) -> Column:
    sides = {"q": q, "s": s}
    return F.when(holds(rules.CAKE, sides), F.when(holds(rules.CAKE_BAKER, sides), rules.CAKE_AYE).otherwise(rules.CAKE_NAY))


def world_answer(s: Column) -> Column:
    return first_rule(rules.WORLD, {"s": s})


def uncertainty_answer(s: Column) -> Column:
    return first_rule(rules.UNCERTAINTY, {"s": s})


def model_first(q: Column) -> Column:
    """Questions about home and wares, which are left to the model."""
    home = contains_any(q, rules.HOME_PHRASES) | (contains_any(q, rules.HOME_ASKS) & contains_any(q, rules.HOME_WORDS))
    return home | contains_any(q, rules.WARES_PHRASES) | contains_any(q, rules.WARES_WORDS)


def fact_trigger(q: Column) -> Column:
    return contains_any(q, rules.FACT_TRIGGERS)


def numeric_gate(q: Column) -> Column:
    return contains_any(q, rules.NUMERIC_GATE)


def phrasings(templates: list[str], who: str) -> Column:
    """All phrasings of an answer; ``who`` is the persona's column."""
    name, trade, home = (F.col(f"{who}.{x}") for x in ("name", "profession", "home"))
    fill = {
        "{name}": name, "{trade}": trade, "{Trade}": capitalize(trade), "{art}": article(trade),
        "{from_home}": F.coalesce(F.concat(F.lit(" from "), home), F.lit("")), "{in_home}": F.coalesce(F.concat(F.lit(" in "), home), F.lit("")),
    }

    def phrase(t: str) -> Column:
        parts: list[Column] = []
        while t:
            at, key = min((t.find(k), k) for k in fill if k in t) if any(k in t for k in fill) else (len(t), "")
            parts += [F.lit(t[:at])] if at else []
            parts += [fill[key]] if key else []
            t = t[at + len(key) :]
        return F.concat(*parts)

    return F.array(*map(phrase, templates))


def variant(templates: list[str], phrases: Column, pick: Column) -> Column:
    """One of the ``phrasings`` of ``templates`` by number."""
    return F.element_at(phrases, (pick % len(templates) + 1).cast("int"))


def pick_number(turn_id: Column, seed: int | None) -> Column:
    """The number that chooses phrasings: 0 without a seed, else from a hash of seed and turn."""
    if seed is None:
        return F.lit(0).cast("long")
    digest = F.md5(F.concat(F.lit(str(seed)), turn_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def asked_trade(q: Column) -> Column:
    """The trade that a question supposes, or null."""
    asked = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit("")) for p in ASKED_TRADE])
    return F.when(~asked.isin("you", "there"), asked)


def profession_check(q: Column, say: str, pick: Column) -> Column:
    """``say`` is the column of phrasings and the trade, see ``state_features``; the same holds for the next three."""
    asked, actual, yes, no = asked_trade(q), *(F.col(f"{say}.{x}") for x in ("trade", "aye", "nay"))
    same = actual.contains(asked) | asked.contains(actual)
    return F.when(asked.isNotNull(), F.when(same, variant(rules.AYE_TRADE, yes, pick)).otherwise(variant(rules.NAY_TRADE, no, pick)))


def trade_answer(q: Column, say: str, pick: Column) -> Column:
    trade, wares = F.col(f"{say}.trade"), contains_any(q, rules.TRADE_WARES)
    plain = lambda templates: variant(templates, F.array(*map(F.lit, templates)), pick)
    answer = (
        F.when(wares & trade.contains("brewer"), plain(rules.BREWER_WARES))
        .when(wares & trade.contains("baker"), plain(rules.BAKER_WARES))
        .otherwise(variant(rules.TRADE_ANSWERS, F.col(f"{say}.work"), pick))
    )
    return F.when(contains_any(q, rules.TRADE_PHRASES), answer)


def name_answer(q: Column, say: str, pick: Column) -> Column:
    return F.when(q.isin(rules.NAME_FOLLOW_UPS) | contains_any(q, rules.NAME_PHRASES), variant(rules.NAME_ANSWERS, F.col(f"{say}.name"), pick))


def identity_answer(q: Column, who: str, say: str, pick: Column) -> Column:
    return F.when(F.col(who).isNotNull(), F.coalesce(profession_check(q, say, pick), trade_answer(q, say, pick), name_answer(q, say, pick)))


#: The answers whose phrasings speak of the persona.
PHRASED = {"aye": rules.AYE_TRADE, "nay": rules.NAY_TRADE, "work": rules.TRADE_ANSWERS, "name": rules.NAME_ANSWERS}


def state_features(states: DataFrame, state: str = "state") -> DataFrame:
    """What depends on the state alone, worked out once a character and before any join."""
    c = F.col(state)
    return (
        states.withColumn("s", norm(c))
        .withColumn("facts", fact_sentences(sentences(c)))
        .withColumn("fact_norms", F.transform("facts", norm))
        .withColumn("nf", norm(F.array_join("facts", " ")))
        .withColumn("pairs", price_pairs(F.col("nf")))
        .withColumn("price_lines", price_lines(F.col("pairs"), F.col("nf")))
        .withColumn("persona", persona(c))
        .withColumn("persona_norms", persona_norms(F.col("persona")))
        .withColumn("who", F.coalesce("persona", persona_fallback(c)))
        .withColumn("say", F.struct(norm(F.col("who.profession")).alias("trade"), *(phrasings(x, "who").alias(n) for n, x in PHRASED.items())))
        .withColumn("practical", practical_state(F.col("s")))
        .withColumn("world", world_answer(F.col("s")))
        .withColumn("uncertain", uncertainty_answer(F.col("s")))
    )


def grounded(joined: DataFrame, seed: int | None = None, fallback: bool = True) -> DataFrame:
    """``text`` and ``rule`` for turns joined with state features.

    ``raw_text`` is the model's answer; with ``fallback`` false there is none, questions for
    the model go through the rules too, and the last resort is a fixed phrase.
    """
    q, s = F.col("q"), F.col("s")
    df = joined.withColumn("pick", pick_number(F.col("turn_id"), seed)).withColumn("fact", relevant_fact(F.col("facts"), F.col("fact_norms"), q))
    df = with_claims(df.withColumn("said", F.coalesce("raw_text", F.lit("")) if fallback else F.lit(rules.UNKNOWN)), "said")
    pick, fact = F.col("pick"), F.col("fact")
    answers = {
        "social": social_answer(q), "practical": practical_answer(F.col("practical"), q, s, fact), "capability": capability_answer(q, s), "world": F.col("world"),
        "uncertainty": F.col("uncertain"), "numeric": numeric_answer(F.col("price_lines"), q, fact), "identity": identity_answer(q, "who", "say", pick),
        "fact": F.when(fact_trigger(q), lead_in_strip(fact)),
    }
    # each rule's answer is a column of its own, so that the cascade names it without repeating it
    df = df.withColumns({"repaired": repaired()} | {f"answer_{n}": c for n, c in answers.items()})
    given = [F.when(F.col(f"answer_{n}") != "", F.lit(n)) for n in answers]
    if fallback:
        given.insert(0, F.when(model_first(q), F.lit("model_first")))
    df = df.withColumn("rule", F.coalesce(*given, F.lit("fallback")))
    text = F.col("repaired")
    for n in answers:
        text = F.when(F.col("rule") == n, F.col(f"answer_{n}")).otherwise(text)
    return df.withColumn("text", text)


def turns_with_states(turns: DataFrame, states: DataFrame) -> DataFrame:
    """Turns with their question normalized and their character's features; characters may be missing."""
    return turns.withColumn("q", norm(F.col("player"))).join(state_features(states), "npc_id", "left")



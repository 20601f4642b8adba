"""Facts and prices of STATE texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import capitalize, contains_any, norm, number_value, singularize


def relevant_fact(facts: Column, fact_norms: Column, q: Column) -> Column:
    """The fact that best fits a question; ties to the earlier, no overlap gives the first, no facts null."""
    asked = F.array_remove(F.array_except(F.split(q, " "), F.array(*map(F.lit, rules.STOP_WORDS))), "")
    where, when, price = (contains_any(q, p) for p in (rules.WHERE_PHRASES, rules.WHEN_PHRASES, rules.PRICE_PHRASES))

    def score(f: Column) -> Column:
        return (
            F.size(F.array_intersect(asked, F.split(f, " ")))
            + F.when(where & contains_any(f, rules.PLACE_TERMS), 3).otherwise(0)
            + F.when(when & contains_any(f, rules.TIME_TERMS), 3).otherwise(0)
            + F.when(price & f.contains("copper"), 4).otherwise(0)
        )

    best = F.array_max(F.transform(fact_norms, lambda f, i: F.struct(score(f).alias("score"), (-i).alias("at"))))
    at = F.when(best["score"] > 0, 1 - best["at"]).otherwise(F.lit(1))
    return F.when(F.size(facts) > 0, F.element_at(facts, at.cast("int")))


def price_pairs(facts_norm: Column) -> Column:
    """``array<struct(label, value, quantity)>`` of the prices in all facts' normalized text."""
    number_words = F.array(*map(F.lit, rules.NUMBER_WORDS))
    costs, has = r"([a-z][a-z ]*?) costs? (\w+) coppers", r"([a-z][a-z ]*?) is (\w+) coppers"

    def found(pattern: str) -> Column:
        sides = [F.regexp_extract_all(facts_norm, F.lit(pattern), F.lit(i)) for i in (1, 2)]
        return F.arrays_zip(sides[0].alias("label"), sides[1].alias("value"))

    def cost(x: Column) -> Column:
        label = F.trim(x["label"])
        first = F.substring_index(label, " ", 1)
        quantity = F.array_position(number_words, first) - 1
        counted = quantity >= 0
        rest = F.trim(label.substr(F.length(first) + 1, F.length(label)))
        return F.struct(
            F.when(counted, rest).otherwise(label).alias("label"),
            number_value(x["value"]).alias("value"),
            F.when(counted, quantity).cast("bigint").alias("quantity"),
        )

    def plain(x: Column) -> Column:
        return F.struct(F.trim(x["label"]).alias("label"), number_value(x["value"]).alias("value"), F.lit(None).cast("bigint").alias("quantity"))

    return F.concat(F.transform(found(costs), cost), F.transform(found(has), plain))


def _coppers(label: Column, verb: str, value: Column) -> Column:
    return F.concat(label, F.lit(verb), value.cast("string"), F.lit(" coppers."))


def _cheapest(pairs: Column) -> Column:
    valid = F.filter(pairs, lambda p: p["value"].isNotNull())
    least = F.array_min(F.transform(valid, lambda p, i: F.struct(p["value"].alias("value"), i.alias("i"), p["label"].alias("label"))))
    return _coppers(capitalize(least["label"]), " is cheaper; it costs ", least["value"])


def cheapest_item(pairs: Column, q: Column) -> Column:
    """The cheapest priced item, where the question asks for it."""
    return F.when(q.contains("which is cheaper"), _cheapest(pairs))


def first_value(pairs: Column) -> Column:
    """The first pair with a known value."""
    return F.try_element_at(F.filter(pairs, lambda p: p["value"].isNotNull()), F.lit(1))


def _budget(pairs: Column, facts_norm: Column) -> Column:
    price = first_value(pairs)["value"]
    have = number_value(F.nullif(F.regexp_extract(facts_norm, r"have (\w+)", 1), F.lit("")))
    line = lambda head, tail: F.concat(F.lit(head), have.cast("string"), F.lit(f" coppers is {tail} for the "), price.cast("string"), F.lit("-copper price."))
    return F.when(price.isNotNull() & have.isNotNull(), F.when(have >= price, line("Aye. ", "enough")).otherwise(line("Nay. ", "not enough")))


def affordability(pairs: Column, facts_norm: Column, q: Column) -> Column:
    """Whether what one has is enough for the first price."""
    return F.when(q.contains("afford") | q.contains("pay"), _budget(pairs, facts_norm))


def _single(pairs: Column) -> Column:
    many = F.try_element_at(F.filter(pairs, lambda p: (p["quantity"] > 1) & p["value"].isNotNull()), F.lit(1))
    each = F.floor(many["value"] / many["quantity"]).cast("bigint")
    return F.concat(F.lit("One "), _coppers(singularize(many["label"]), " costs ", each))


def unit_price(pairs: Column, q: Column) -> Column:
    """The price of one of the first item sold in a number."""
    return F.when(q.contains("one") | q.contains("single"), _single(pairs))


def first_price(pairs: Column) -> Column:
    """The first known price."""
    first = first_value(pairs)
    return _coppers(capitalize(first["label"]), " costs ", first["value"])


def price_lines(pairs: Column, facts_norm: Column) -> Column:
    """What answers about numbers take from the facts alone: ``struct(pies, more, cheapest, budget, single, first)``."""
    more = facts_norm.contains(rules.BREAD_FIVE) & facts_norm.contains(rules.CHEESE_TWELVE)
    lines = {
        "pies": F.when(facts_norm.contains(rules.TWO_PIES), F.lit(rules.ONE_PIE_ANSWER)), "more": F.when(more, F.lit(rules.MORE_ANSWER)),
        "cheapest": _cheapest(pairs), "budget": _budget(pairs, facts_norm), "single": _single(pairs), "first": first_price(pairs),
    }
    return F.struct(*(c.alias(n) for n, c in lines.items()))


def numeric_answer(lines: Column, q: Column, fact: Column) -> Column:
    """The answer to a question about numbers from ``price_lines``; ``fact`` is the fact to fall back to."""
    asks = {
        "pies": q.contains(rules.ONE_PIE), "more": q.contains(rules.MORE), "cheapest": q.contains("which is cheaper"),
        "budget": q.contains("afford") | q.contains("pay"), "single": q.contains("one") | q.contains("single"),
    }
    answers = [*(F.when(asked, lines[n]) for n, asked in asks.items()), lines["first"], fact]
    return F.when(contains_any(q, rules.NUMERIC_GATE), F.coalesce(*answers))

"""Text scalars as Catalyst expressions; no Python worker is involved."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: Unicode white space; the JVM's ``\s`` alone is ASCII.
WS = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
#: Characters whose case fold contains ASCII letters that ``lower`` doesn't give; marks that would follow become spaces.
FOLDS = {
    "ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ",
}


def clean(c: Column) -> Column:
    """Trimmed, with runs of white space collapsed to one space."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{WS}|{WS}$", "")


def norm(c: Column) -> Column:
    """Case-folded words of ``[a-z0-9']``, separated by single spaces."""
    folded = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLDS.items(), c)
    lowered = F.lower(F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9']+", " "))


def sentences(c: Column) -> Column:
    """Cleaned sentences: cut behind ``. ! ?`` with white space, empties dropped."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])" + WS), clean), lambda x: x != "")


def fact_sentences(parts: Column) -> Column:
    """Sentences behind the first that don't speak of the persona."""
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(rest, lambda x: ~(norm(x).startswith("you are ") | norm(x).startswith("you keep ")))


def number_value(n: Column) -> Column:
    """The first whole number of normalized text, else the first number word in the order of the words' values."""
    digits = F.regexp_extract(n, r"\b(\d+)\b", 1)
    words = F.coalesce(*[F.when(n.rlike(rf"\b{w}\b"), F.lit(v).cast("bigint")) for v, w in enumerate(rules.NUMBER_WORDS)])
    return F.when(digits != "", digits.try_cast("bigint")).otherwise(words)


def article(trade: Column) -> Column:
    """``an`` before a vowel or nothing, else ``a``."""
    first = F.lower(F.substring(trade, 1, 1))
    return F.when(first.isin("a", "e", "i", "o", "u", ""), "an").otherwise("a")


def role_with_article(role: Column) -> Column:
    """The role as it stands if it has an article, else with one."""
    vowel = F.lower(F.substring(role, 1, 1)).isin("a", "e", "i", "o", "u")
    return F.when(F.lower(role).rlike("^(a|an|the) "), role).otherwise(F.concat(F.when(vowel, "an ").otherwise("a "), role))


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def singularize(c: Column) -> Column:
    """``ies`` becomes ``y``, another final ``s`` goes."""
    cut = lambda n: c.substr(F.lit(1), F.length(c) - n)
    return F.when(c.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(c.endswith("s"), cut(1)).otherwise(c)


def lead_in_strip(c: Column) -> Column:
    """Without a leading ``you know`` or ``the state says``."""
    return F.regexp_replace(c, "(?i)^(you know |the state says )", "")


def state_render(name: Column, role: Column, home: Column, facts: Column) -> Column:
    """STATE text of a profile; absent parts are left out."""
    name, role, home = (F.coalesce(strip(c), F.lit("")) for c in (name, role, home))
    facts = F.coalesce(clean(facts), F.lit(""))
    who = F.when(name != "", F.concat(F.lit("Your name is "), name, F.lit(".")))
    what = (
        F.when((role != "") & (home != ""), F.concat(F.lit("You are "), role_with_article(role), F.lit(" from "), home, F.lit(".")))
        .when(role != "", F.concat(F.lit("You are "), role_with_article(role), F.lit(".")))
        .when(home != "", F.concat(F.lit("You are from "), home, F.lit(".")))
    )
    rest = F.when(facts != "", F.when(facts.rlike("[.!?]$"), facts).otherwise(F.concat(facts, F.lit("."))))
    return F.concat_ws(" ", who, what, rest)


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether any phrase is a part of the text; one pattern, so that plans stay small."""
    return c.rlike("|".join(map(re.escape, phrases)))


def holds(condition: list[tuple[str, ...]], sides: dict[str, Column]) -> Column:
    """A rule's condition over the sides' normalized texts."""

    def test(t: str) -> Column:
        c, how, what = sides[t[0]], t[1], t[2:]
        return c.contains(what) if how == ":" else c == what if how == "=" else c.rlike(what)

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(test, alternative)) for alternative in condition])


def first_rule(table: list[tuple], sides: dict[str, Column]) -> Column:
    """The answer of the first rule that holds, else null."""
    return F.coalesce(*[F.when(holds(cond, sides), F.lit(answer)) for cond, answer in table])

"""Personas in STATE texts, and claims in answers that contradict them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .text import article, clean, norm

# The patterns of personas and claims.
KEPT = r"(?i)Your name is ([^.]+)\.\s*You are (?:a |an )?(.+?)(?:\s+(?:from|in|near)\s+([^.;]+))?\."
KEEPER = r"(?i)Your name is ([^.]+)\.\s*You keep (?:a |an )?(.+?)(?:\s+in\s+([^.;]+))?\."
OPEN_ENDED = r"(?i)Your name is ([^.]+)\. You are (?:a |an )?([^.]+)"
CLAIM_NAME = r"(?i)\b(?:my name is|call me|i am called|i'm called)\s+([^,.!?;]+)"
CLAIM_SELF = r"\bI(?: am|'m)\s+([^,.!?;]+)"
CLAIM_TRADE = r"(?i)\b(?:i(?: am|'m)|my trade is|i work as|i serve as)\s+(?:a |an |the )?([^,.!?;]+)"
CLAIM_HOME = r"(?i)\b(?:from|live in|dwell in|hail from|come from|home is|i am in|i'm in)\s+([A-Za-z][A-Za-z' -]*)"


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def persona(state: Column) -> Column:
    """``struct(name, profession, home)`` of a STATE text by its two full patterns; null without a match."""

    def by(pattern: str) -> Column:
        parts = [clean(_group(state, pattern, i)) for i in (1, 2, 3)]
        return F.when(state.rlike(pattern), F.struct(*(p.alias(n) for p, n in zip(parts, ("name", "profession", "home")))))

    return F.coalesce(by(KEPT), by(KEEPER))


def persona_fallback(state: Column) -> Column:
    """The same struct from a text without a final stop; role and place are split once."""
    role = F.trim(_group(state, OPEN_ENDED, 2))
    parts = F.split(role, r"(?i)\s+(?:from|in|near)\s+", 2)
    home = F.when(F.size(parts) > 1, F.nullif(clean(parts[1]), F.lit("")))
    return F.when(
        state.rlike(OPEN_ENDED),
        F.struct(clean(_group(state, OPEN_ENDED, 1)).alias("name"), clean(parts[0]).alias("profession"), home.alias("home")),
    )


def _words(n: Column) -> Column:
    return F.array_remove(F.split(n, " "), "")


def _has_trade(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, rules.OCCUPATIONS)))


def persona_norms(p: Column) -> Column:
    """The normalized name, trade and home of a persona; an absent home is empty."""
    return F.struct(norm(p["name"]).alias("name"), norm(p["profession"]).alias("trade"), norm(F.coalesce(p["home"], F.lit(""))).alias("home"))


def with_claims(df: DataFrame, raw: str = "raw_text", who: str = "persona") -> DataFrame:
    """``raw`` (cleaned) and the verdicts ``wrong_name``, ``wrong_profession``, ``wrong_home``; all false without a persona.

    ``persona_norms`` is taken from the column of that name, if there is one.
    """
    df = df.withColumn("raw", clean(F.col(raw)))
    if "persona_norms" not in df.columns:
        df = df.withColumn("persona_norms", persona_norms(F.col(who)))
    # the pattern differs from row to row, which only the SQL form of the function takes
    title = F.expr(f"regexp_extract(raw, concat('(?i)\\\\b\\\\Q', {who}.name, '\\\\E\\\\s+the\\\\s+([a-z][a-z -]+)'), 1)")
    # plain columns, as the optimizer would repeat a struct's fields wherever they are named
    found = {n: norm(_group(F.col("raw"), p, 1)) for n, p in (("raw_named", CLAIM_NAME), ("raw_said", CLAIM_SELF), ("raw_worked", CLAIM_TRADE))}
    df = df.withColumns(found | {"raw_titled": norm(F.nullif(title, F.lit("")))})
    own, trade, home = (F.col(f"persona_norms.{x}") for x in ("name", "trade", "home"))
    named, said, worked, titled = (F.col(f"raw_{x}") for x in ("named", "said", "worked", "titled"))
    false = F.lit(False)

    claim_name = F.when(named.isNotNull(), F.coalesce(F.element_at(F.split(named, " "), 1), F.lit("")) != own).otherwise(false)

    first = F.element_at(F.split(said, " "), 1)
    other = ~first.isin(rules.SAFE_FIRST_WORDS) & (first != own) & ~_has_trade(_words(said))
    claim_self = F.when(said.isNotNull(), first.isin(rules.NOBODY) | other).otherwise(false)

    claim_trade = F.coalesce(_has_trade(_words(worked)) & ~worked.contains(trade), false)
    claim_title = F.when(_has_trade(_words(titled)), ~titled.contains(trade))

    places = F.expr("regexp_extract_all(raw, '" + CLAIM_HOME.replace("\\", "\\\\").replace("'", "\\'") + "', 1)")

    def elsewhere(x: Column) -> Column:
        known = F.exists(F.array(*map(F.lit, rules.KNOWN_PLACES)), lambda p: norm(x).contains(p))
        return (known | x.rlike("[A-Z]")) & ~norm(x).contains(home)

    claim_home = (home != "") & F.exists(places, elsewhere)
    there = F.col(who).isNotNull()
    verdicts = {
        "claim_name": there & F.coalesce(claim_name, false), "claim_self": there & F.coalesce(claim_self, false), "claim_trade": there & claim_trade,
        "claim_title": F.when(there, claim_title), "wrong_home": there & F.coalesce(claim_home, false),
    }
    return (
        df.withColumns(verdicts)
        .withColumn("wrong_name", F.col("claim_name") | F.col("claim_self"))
        .withColumn("wrong_profession", F.coalesce("claim_title", "claim_trade"))
    )


def repaired(who: str = "persona") -> Column:
    """The canonical introduction where a verdict of ``with_claims`` is true, else the cleaned text."""
    name, trade, home = (F.col(f"{who}.{x}") for x in ("name", "profession", "home"))
    place = F.coalesce(F.concat(F.lit(" from "), home), F.lit(""))
    intro = F.concat(F.lit("I am "), name, F.lit(", "), article(trade), F.lit(" "), trade, place, F.lit("."))
    return F.when(F.col("wrong_name") | F.col("wrong_profession") | F.col("wrong_home"), intro).otherwise(F.col("raw"))

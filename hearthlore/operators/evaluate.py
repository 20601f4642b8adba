"""Keyword suites and run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm

LISTS = ("required_any", "required_all", "forbidden")


def score_cases(outputs: DataFrame, cases: DataFrame, on: str = "name") -> DataFrame:
    """``outputs`` with ``passed`` and ``reasons``: keywords are parts of the normalized text; a missing list is empty."""
    df = outputs.join(cases.select(on, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in LISTS]), on)
    text = norm(F.col("text"))
    inside = lambda x: text.contains(norm(x))
    any_of, all_of, none_of = map(F.col, LISTS)
    missing, hits = F.filter(all_of, lambda x: ~inside(x)), F.filter(none_of, inside)
    no_any = (F.size(any_of) > 0) & ~F.exists(any_of, inside)

    def said(condition: Column, label: str, words: Column) -> Column:
        return F.when(condition, F.concat(F.lit(label), F.array_join(words, ", ")))

    reasons = F.concat_ws("; ", said(no_any, "missing any of: ", any_of), said(F.size(missing) > 0, "missing: ", missing), said(F.size(hits) > 0, "forbidden: ", hits))
    return df.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def throughput(generation: DataFrame) -> DataFrame:
    """Adds tokens a second (0 without time) and latency in milliseconds."""
    s = F.col("seconds")
    return generation.withColumn("tokens_per_second", F.when(s > 0, F.col("tokens") / s).otherwise(F.lit(0.0))).withColumn("latency_ms", s * 1000)


def suite_summary(scored: DataFrame) -> DataFrame:
    """One row: passed, total, rate in percent, tokens, tokens a second over all, exit code."""
    agg = scored.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    rate = F.when(F.col("total") > 0, 100.0 * F.col("passed") / F.col("total")).otherwise(F.lit(0.0))
    speed = F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).otherwise(F.lit(0.0))
    return agg.select("passed", "total", rate.alias("rate"), "tokens", speed.alias("tokens_per_second"), F.when(F.expr("passed = total"), 0).otherwise(2).alias("exit_code"))


def trim_warning(generation: DataFrame) -> DataFrame:
    """Rows whose prompt was cut."""
    return generation.where(F.col("state_trimmed") | F.col("player_trimmed"))

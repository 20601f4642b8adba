"""Choices from candidate scores (``row_id, item_id, logit``).

The plain forms are windows by ``row_id``, which share one partitioning and hold a row's candidates
in one task; the ``_any`` forms give the same for rows of any number of candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .scan import ranged, running


def greedy_pick(scores: DataFrame) -> DataFrame:
    """The best item of each row, the lowest of equals."""
    return scores.groupBy("row_id").agg(F.max_by("item_id", F.struct("logit", -F.col("item_id"))).alias("item_id"))


def temperature_softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds ``p``, the softmax of ``logit / temperature`` in its row."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0; greedy_pick is for 0")
    w = Window.partitionBy("row_id")
    e = F.exp((F.col("logit") - F.max("logit").over(w)) / temperature)
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def nucleus_filter(scores: DataFrame, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """The items up to a cumulative probability of ``top_p`` (the one that crosses it goes too), renormalized; the best always stays.

    Cumulative probabilities are compared at 9 decimal digits, so that the order of adding doesn't decide.
    """
    if not 0 < top_p <= 1:
        raise ValueError("top_p must be above 0 and at most 1")
    order = Window.partitionBy("row_id").orderBy(F.desc("p"), "item_id")
    ranked = temperature_softmax(scores, temperature).withColumn("cum", F.round(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), 9)).withColumn("rank", F.row_number().over(order))
    kept = ranked.where((F.col("cum") <= top_p) | (F.col("rank") == 1))
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("row_id"))).drop("cum")


def categorical_draw(scores: DataFrame, seed: int, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """One item a row, by a number in [0, 1) that hashes seed and row; no random state. Cumulative probabilities have 9 decimal digits."""
    order = Window.partitionBy("row_id").orderBy("rank")
    kept = nucleus_filter(scores, top_p, temperature).withColumn("cum", F.round(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), 9))
    return _drawn(kept, seed)


def _drawn(kept: DataFrame, seed: int) -> DataFrame:
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))), 1, 8)
    u = F.conv(digest, 16, 10).cast("double") / 4294967296.0
    hit = kept.withColumn("u", u)
    return hit.groupBy("row_id").agg(F.coalesce(F.min_by("item_id", F.when(F.col("cum") >= F.col("u"), F.col("rank"))), F.max_by("item_id", "rank")).alias("item_id"))


def softmax_any(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``temperature_softmax`` by two aggregations, whose partial sums leave little of a row to meet."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0; greedy_pick is for 0")
    power = F.exp((F.col("logit") - F.col("top")) / temperature)
    top = scores.groupBy(F.col("row_id").alias("r")).agg(F.max("logit").alias("top"))
    of = F.col("row_id").eqNullSafe(F.col("r"))
    sums = written(scores.join(top, of).groupBy("r", "top").agg(F.sum(power).alias("total")), "softmax")
    return scores.join(sums, of).withColumn("p", power / F.col("total")).drop("r", "top", "total")


def nucleus_any(scores: DataFrame, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """``nucleus_filter`` by running totals over ranges of the sorted candidates; ``cum`` is that of the renormalized ``p``."""
    if not 0 < top_p <= 1:
        raise ValueError("top_p must be above 0 and at most 1")
    order = [F.desc("p"), F.asc("item_id")]
    rows = running(ranged(softmax_any(scores, temperature), "row_id", order), "row_id", order, mass=F.col("p"), above=F.lit(1))
    cum = F.col("mass") + F.col("p")
    kept = rows.where((F.round(cum, 9) <= top_p) | (F.col("above") == 0))
    kept = written(kept.select(*scores.columns, "p", (F.col("above") + 1).cast("int").alias("rank"), cum.alias("cum")), "nucleus")
    sums = kept.groupBy(F.col("row_id").alias("r")).agg(F.sum("p").alias("total"))
    share = lambda c: (F.col(c) / F.col("total")).alias(c)
    return kept.join(sums, F.col("row_id").eqNullSafe(F.col("r"))).select(*scores.columns, share("p"), "rank", share("cum"))


def draw_any(scores: DataFrame, seed: int, top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """``categorical_draw`` for rows of any number of candidates."""
    return _drawn(nucleus_any(scores, top_p, temperature).withColumn("cum", F.round("cum", 9)), seed)

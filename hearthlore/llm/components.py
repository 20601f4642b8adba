"""Connected components of an edge table, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest identifier reachable) of all ends of ``edges`` (``a``, ``b``).

    Alternating large-star and small-star steps: each identifier's larger, then smaller,
    neighbours are hung on its smallest one, until nothing changes. The edges of each round
    are written to the shared folder, and those of the round before deleted. A hub's neighbours are summarised by a partial minimum
    before any shuffle; the joins that follow can be split by Spark where a hub is hot.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        old, now = now, written(small.select("e.*").where("a < b").distinct(), "edges")
        drop(old)
        row = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).collect()[0]
        if (row.n, row.s) == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select("a", F.col("a").alias("component")).distinct().withColumnRenamed("a", "id"))
        before = row.n, row.s

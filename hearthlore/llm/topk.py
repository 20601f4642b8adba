"""Operator 9: exact top-k inner products by no-random-access aggregation.

Vectors travel as chunks, each once for a group of queries (one group up to GROUP query
chunks), dealt over tasks by a salt; a task holds its group's queries and streams the vectors
past them in blocks of about BLOCK. A block's lists (for each dimension the vectors by value)
are built once for all queries and read from both ends, twice as deep each time, to the same
depth for all queries: a query takes the high end where its component is positive and the low
end where it is negative. What has been read gives every vector a lower bound (unread
components at the list's worst value) and an upper bound (unread ones at the list's frontier).
Vectors whose upper bound is below the k-th best lower bound, or below the k-th best score of
the blocks before, are dropped, those that were never met among them; when few are left,
reading stops and their scores are resolved. A block whose best possible score doesn't qualify
is not read at all. A task's k best of each query are merged at the end. Nothing is broadcast
or collected.

Defined results: null vectors and vectors with null or non-finite components take no part,
nor do null identifiers; a query meets only vectors of its own length, and no row with its
identifier; repeated vectors are candidates each, ties go to the smaller identifier; a
repeated query identifier is one query (its smallest vector); with fewer than k candidates
all are returned; an empty vector has score 0 with others; a scaled component or a reported
score beyond 64 bits raises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, written

#: Vectors of a block, queries of a chunk, chunks of a query group, survivors of a block (its share and the least) that are resolved without further reading.
BLOCK, QUERY_CHUNK, GROUP, RESOLVE = 4096, 256, 256, (16, 64)


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """``dim, n, ids, data``: chunks of at most ``rows`` vectors of one length, in scaled integers of the narrowest type."""

    def each(found: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> tuple:
            own = held.pop(dim)
            m = np.floor(1024.0 * np.array([v for _, v in own], np.float64).reshape(len(own), dim))
            if not (np.abs(m) < 2.0**63).all():
                raise OverflowError("a scaled component is beyond 64 bits")
            top = float(np.abs(m).max(initial=0))
            m = m.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")
            return dim, len(own), np.array([i for i, _ in own], "<i8").tobytes(), m.tobytes()

        for vec_id, v in found:
            if any(x is None or not math.isfinite(x) for x in v):
                continue
            held.setdefault(len(v), []).append((vec_id, v))
            if len(held[len(v)]) >= rows:
                yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return map_rows(vectors, "dim int, n int, ids binary, data binary", each)


def _unpacked(dim: int, n: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = len(data) // (n * dim) if dim else 2
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, f"<i{width}").reshape(n, dim).astype(np.int64)


class Lists:
    """A block with its sorted lists; ``read`` counts the entries that have been read of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.read = ids, x, 0
        order = np.argsort(x, 0, kind="stable")
        self.sorted = np.take_along_axis(x, order, 0).astype(np.float64)
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.int32)[:, None], 0)
        self.real, self.top = x.astype(np.float64), float(np.abs(x).max(initial=0))
        self.ends: dict[int, tuple] = {}

    def upto(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the lists hold down to a depth from their high and low ends: the values, and where they are."""
        if depth not in self.ends:
            high, low = (self.rank >= len(self.ids) - depth).astype(np.float64), (self.rank < depth).astype(np.float64)
            self.ends[depth] = self.real * high, self.real * low, high, low
            self.read = max(self.read, 2 * depth * self.x.shape[1])
        return self.ends[depth]

    def search(self, q: np.ndarray, own_ids: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query, ``(-score, id)`` of vectors that may be among its k best, given its k-th best score elsewhere.

        The lists are read to the same depth for all queries, so an entry is read once for all of them.
        """
        (n, dim), ids = self.x.shape, self.ids
        w = q.astype(np.float64)
        ups, downs = np.maximum(w, 0), np.minimum(w, 0)
        worst, best = ((ups * self.sorted[a] + downs * self.sorted[b]) for a, b in ((0, -1), (-1, 0)))
        scale = dim * self.top * float(np.abs(w).max(initial=0))
        slack = 0.0 if scale < 1 << 53 else scale * 2.0**-48
        hopeful = np.flatnonzero(best.sum(1) >= floors - slack)
        live = {j: ids != own_ids[j] for j in hopeful.tolist()}
        depth, enough = max(1, n // 8), max(k, RESOLVE[1], n // RESOLVE[0])
        while depth < n and (asked := [j for j, x in live.items() if x.sum() > enough]):
            values_high, values_low, high, low = self.upto(depth)
            u, v = ups[asked], downs[asked]
            known = values_high @ u.T + values_low @ v.T
            frontier_u, frontier_v = u * self.sorted[n - depth], v * self.sorted[depth - 1]
            lower = known + worst[asked].sum(1) - high @ (u * self.sorted[0]).T - low @ (v * self.sorted[-1]).T
            upper = known + (frontier_u + frontier_v).sum(1) - high @ frontier_u.T - low @ frontier_v.T
            lower[ids[:, None] == own_ids[None, asked]] = -np.inf
            bars = np.maximum(floors[asked], np.partition(lower, n - k, 0)[n - k]) - slack
            for at, j in enumerate(asked):
                live[j] &= upper[:, at] >= bars[at]
            depth *= 2
        out: list[list[tuple[int, int]]] = [[] for _ in q]
        for j, x in live.items():
            left = np.flatnonzero(x)
            out[j] = sorted(zip((-self._scores(left, q[j], scale)).tolist(), ids[left].tolist()))[:k]
        return out

    def _scores(self, left: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
        if scale < 1 << 53:
            return (self.real[left] @ q).astype(np.int64)
        return self.x[left] @ q if scale < 1 << 62 else (self.x[left].astype(object) * q.astype(object)).sum(1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull())
    as_rows = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    valid = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = as_rows(rows.where(is_query)).where(valid).groupBy("i").agg(F.min("v").alias("v"))
    queries = written(_packed(asked, QUERY_CHUNK), "query-chunks")
    groups = 1 + queries.count() // GROUP
    # a task sees several blocks, so that what it has found already cuts later ones short
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (4 * BLOCK)))
    number = lambda by: F.explode(F.sequence(F.lit(0), F.lit(by - 1)))
    mine = queries.withColumns({"grp": F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"), "side": F.lit(0)}).withColumn("salt", number(parts))
    theirs = _packed(as_rows(rows), BLOCK).withColumns({"salt": F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"), "side": F.lit(1)}).withColumn("grp", number(groups))
    cols = ["grp", "salt", "side", "dim", "n", "ids", "data"]
    dealt = mine.select(cols).unionByName(theirs.select(cols)).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side", "dim")

    def each(found: Iterator[tuple]) -> Iterator[tuple]:
        at = None
        asked: dict[int, list[list]] = {}  # by length: chunks of identifiers, queries, and their best so far
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def meet() -> None:
            if held:
                lists = Lists(*(np.concatenate(x) for x in zip(*held)))
                held.clear()
                for chunk in asked.get(lists.x.shape[1], []):
                    own, q, best = chunk
                    floors = np.array([-float(t[-1][0]) if len(t) == k else -np.inf for t in best])
                    chunk[2] = [sorted(old + new)[:k] for old, new in zip(best, lists.search(q, own, k, floors))]

        def out() -> Iterator[tuple]:
            meet()
            for owners, _, tops in (x for xs in asked.values() for x in xs):
                for own, best in zip(owners.tolist(), tops):
                    for score, vec_id in best:
                        if abs(score) >= 1 << 63:
                            raise OverflowError("a score is beyond 64 bits")
                        yield own, vec_id, -score

        for grp, salt, side, dim, n, ids, data in found:
            if at != (grp, salt):
                yield from out()
                at = grp, salt
                asked.clear()
            own, x = _unpacked(dim, n, ids, data)
            if side == 0:
                asked.setdefault(dim, []).append([own, x, [[] for _ in own]])
            elif dim in asked:
                if held and held[0][1].shape[1] != dim:
                    meet()
                held.append((own, x))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    meet()
        yield from out()

    found = map_rows(dealt, "query_id long, vec_id long, score long", each)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 best rows of all embeddings for every hundredth one."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

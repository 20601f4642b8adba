"""Operator 11: best-fit packing of documents, its number of sequences certified or improved.

A document longer than a sequence is cut into full pieces and one shorter first piece; no other
is cut. What doesn't fill a sequence alone is dealt to partitions by a hash, and each partition
packs its pieces by best-fit decreasing: the longest first, each into the fullest sequence that
has room. Dual-feasible functions bound from below how many sequences any packing of these
pieces needs: such a function maps lengths so that no packing of one sequence exceeds the
function's value of a whole one, so the sum over all pieces, divided by that value and rounded
up, is a bound. A partition that needs no more is certified, and its sequences stay, but for the
emptiest one. Partitions with a gap give up all sequences that aren't full. What was given up is
dealt anew (the exchange) and packed again, as long as the number of sequences falls and is
above the bound of all pieces; a round that doesn't lower it is not taken.

There are as many lengths as tokens in a sequence, so bounds are worked out on a histogram. A
partition holds ITEMS pieces or so, whatever the input's size, without their identifiers. A
sequence has the number of its first piece, so no task has to know of another's.

Defined results: a null text is empty and has the end identifier alone; a null identifier stays
null; repeated rows are packed as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import BATCH_ROWS, arrow_schema, drop, map_rows, small_batches, texts_of, written

#: Pieces that a partition packs, and exchanges at most.
ITEMS, ROUNDS = 1 << 17, 6
#: Thresholds of the bounding functions.
THRESHOLDS = 512
PIECE_SCHEMA = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and end of a document's pieces: all are full but the first."""
    at = 0
    while at < n:
        to = at + ((n - at) % capacity or capacity)
        yield at, to
        at = to


def dual_feasible(x: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """What dual-feasible functions make of the lengths ``x``, each with what it makes of a whole sequence.

    The lengths themselves; thresholds, which count a piece above ``capacity - t`` as a whole
    sequence and one below ``t`` as nothing; ``k + 1`` equal steps of which a length between two
    counts as the lower, in ``k`` parts; and counts of pieces of length ``t`` that fit beside a
    long one. There are some THRESHOLDS values of ``t``, all of them for sequences up to twice as long.
    """
    yield x, capacity
    for t in range(1, capacity // 2 + 1, -(-capacity // (2 * THRESHOLDS))):
        yield np.where(x > capacity - t, capacity, np.where(x < t, 0, x)), capacity
        fit = capacity // t
        yield np.where(2 * x > capacity, 2 * (fit - (capacity - x) // t), np.where(2 * x == capacity, fit, 2 * (x // t))), 2 * fit
    for k in range(1, min(capacity, 100) + 1):
        exact = (k + 1) * x % capacity == 0
        yield np.where(exact, k * x, capacity * ((k + 1) * x // capacity)), k * capacity


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; ``histogram`` has the number of pieces of each length from 0 to ``capacity``."""
    x = np.flatnonzero(histogram)
    n = histogram[x].astype(np.int64)
    return max((-(-int(f @ n) // whole) for f, whole in dual_feasible(x, capacity)), default=0)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The sequence and the offset of each of the falling ``lengths``."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # a bit for each room that a sequence has
    bins, offsets = [], []
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own, made = capacity, made, made + 1
        bins.append(own)
        offsets.append(capacity - room)
        if room := room - n:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins, offsets


def _packed(table: pa.Table, capacity: int) -> pa.Table:
    """A partition's pieces with their places, and whether they stay there (``closed``)."""
    uid, length = table["uid"].to_numpy(), table["length"].to_numpy()
    order = np.lexsort((uid, -length))
    uid, length = uid[order], length[order]
    bins, offsets = (np.array(x, np.int64) for x in best_fit_decreasing(length.tolist(), capacity))
    n = int(bins.max()) + 1
    fill = np.bincount(bins, length, n).astype(np.int64)
    certified = n == lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
    given_up = fill < capacity
    if certified:
        given_up &= np.arange(n) == fill.argmin()
    first = np.full(n, -1, np.int64)
    first[bins[::-1]] = uid[::-1]
    table = table.take(pa.array(order))
    more = {"sequence_id": first[bins], "offset": offsets, "certified": np.full(len(bins), certified), "closed": ~given_up[bins]}
    for name, values in more.items():
        table = table.append_column(name, pa.array(values))
    return table


def _repack(pieces: DataFrame, kinds: str, capacity: int, n: int, salt: int) -> DataFrame:
    """One round, written: ``n`` pieces dealt to partitions and packed."""
    schema = f"{kinds}, sequence_id long, offset long, certified boolean, closed boolean"
    arrow = arrow_schema(pieces.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _packed(pa.Table.from_batches(held), capacity).cast(arrow).to_batches(BATCH_ROWS)

    dealt = pieces.repartition(max(1, -(-n // ITEMS)), F.xxhash64("uid", F.lit(salt)))
    return written(small_batches(dealt).mapInArrow(run, schema), "packed")


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a unique ``uid`` and a ``length`` up to ``capacity``) with ``sequence_id``, ``offset`` and ``certified``.

    ``certified`` says that the partition which packed the piece last needed no more sequences than its bound.
    """
    if capacity < 1:
        raise ValueError("a sequence holds at least one token")
    kinds = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many as lengths
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("a piece has between one token and a sequence")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    histogram = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        histogram[k] = n * (k < capacity)
    least, left = lower_bound(histogram, capacity), int(histogram.sum())
    done, still, closed, most = [whole], pieces.where(F.col("length") < capacity), 0, None
    for salt in range(ROUNDS if left else 0):
        tried = _repack(still.select(pieces.columns), kinds, capacity, left, salt)
        begins = F.col("offset") == 0
        row = tried.agg(F.count_if(begins & F.col("closed")).alias("closed"), F.count_if(begins).alias("all"), F.count_if(~F.col("closed")).alias("left")).collect()[0]
        if most is not None and closed + row["all"] >= most:
            drop(tried)  # what is open stays where the round before has put it
            break
        most, closed, left = closed + row["all"], closed + row["closed"], row["left"]
        done.append(tried.where("closed").drop("closed"))
        still = tried.where("NOT closed").drop("closed")
        if most <= least or not left:
            break
    if most is not None:
        done.append(still)
    return reduce(DataFrame.unionByName, done)


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """The number of sequences of packed pieces, and how many any packing of these pieces needs at least."""
    counts = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("begun")).collect()  # as many as lengths
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r.length] = r.n
    return sum(r.begun for r in counts), lower_bound(histogram, capacity)


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces, written: ``uid, doc_id, piece, start, length, ids_crc32`` and, with ``with_ids``, ``ids``."""

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        enc, uid = tokens.encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], enc.dtype).tobytes()
        for doc_id, text in rows:
            ids = np.frombuffer(enc.encode(text) + end, enc.dtype).astype("<u4")
            for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                own = ids[a:b]
                row = uid, doc_id, k, a, b - a, zlib.crc32(own.tobytes())
                yield (*row, own.tolist()) if with_ids else row
                uid += 1

    return written(map_rows(texts_of(docs, id_col, text_col), PIECE_SCHEMA + ", ids array<long>" * with_ids, pieces), "pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, with its place; ``with_ids`` adds its identifiers."""
    return best_fit(cut_documents(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), capacity).drop("uid")


def op11_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

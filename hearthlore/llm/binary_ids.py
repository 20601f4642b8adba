"""Operator 10: token identifiers as files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by ``doc_id``; each task encodes its texts and
emits segments, which Spark's own Parquet writer stores, so that commits survive lost
executors. A segment holds whole documents. Its image has, little-endian:

    "PFB1", u32 identifiers, u32 block length, u32 blocks
    u32 block starts (blocks + 1, in bytes from the payload's begin): the block index
    u32 block minimum, u8 width, u16 number of exceptions (arrays over the blocks)
    payload; a block: (value - minimum) in ``width`` bits each, low bits first,
    then the exceptions' positions (u16) and their full differences (u32)

The width holds the given percentile of a block's differences; what needs more bits is an
exception.

Defined results: a null text is empty and has the end identifier alone; an empty table
gives no rows; repeated identifiers are ordered by text; a null ``doc_id`` sorts first;
a document of any length is one run of blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows, new_path, texts_of, with_bases

SEGMENT_SCHEMA = "part int, part_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, image binary"
_HEAD = struct.Struct("<4sIII")


def _to_bits(rows: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of each number, row by row, low bits first."""
    n, block = rows.shape
    if w > 16 or block % 8:
        bits = np.unpackbits(rows.astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(n, block, 32)
        return np.packbits(bits[:, :, :w].reshape(n, -1), axis=1, bitorder="little")
    # eight numbers are w bytes: two words of four numbers each, put together to 128 bits
    v = (rows & np.uint32((1 << w) - 1)).astype("<u8").reshape(n, block // 8, 8)
    low, high = v[:, :, 0].copy(), v[:, :, 4].copy()
    for k in (1, 2, 3):
        low |= v[:, :, k] << np.uint64(k * w)
        high |= v[:, :, 4 + k] << np.uint64(k * w)
    both = np.zeros((n, block // 8, 2), "<u8")
    both[:, :, 0], both[:, :, 1] = (low, high) if w == 16 else (low | high << np.uint64(4 * w), high >> np.uint64(64 - 4 * w) if w else high)
    return both.view(np.uint8)[:, :, :w].reshape(n, -1)


def _from_bits(raw: np.ndarray, w: int, block: int) -> np.ndarray:
    """The numbers of ``_to_bits``."""
    n = len(raw)
    if w > 16 or block % 8:
        bits = np.zeros((n, block, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little")[:, : block * w].reshape(n, block, w)
        return np.packbits(bits.reshape(n, -1), axis=1, bitorder="little").view("<u4")
    both = np.zeros((n, block // 8, 16), np.uint8)
    both[:, :, :w] = raw.reshape(n, block // 8, w)
    low, high = (both.view("<u8")[:, :, k] for k in (0, 1))
    out = np.empty((n, block // 8, 8), np.uint32)
    for k in range(8):
        at = k * w
        own = low >> np.uint64(at) if at < 64 else high >> np.uint64(at - 64)
        out[:, :, k] = own | high << np.uint64(64 - at) if 64 - w < at < 64 else own
    out &= np.uint32((1 << w) - 1)
    return out.reshape(n, block)


def pack(values: np.ndarray, block: int = 256, percentile: float = 98.0) -> bytes:
    """Identifiers (below 2**32) as one segment image."""
    values = np.ascontiguousarray(values, np.uint32)
    n, blocks = len(values), -(-len(values) // block)
    lens = np.full(blocks, block)
    if blocks:
        lens[-1] = n - block * (blocks - 1)
    filled = np.concatenate([values, np.repeat(values[-1:], blocks * block - n)]).reshape(blocks, block)
    low = filled.min(1) if blocks else np.zeros(0, np.uint32)
    diff = filled - low[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    at = np.partition(diff, rank, 1)[:, rank] if blocks else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    over[-1:] &= np.arange(block) < lens[-1:][:, None]
    n_over = over.sum(1)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for r, k in zip(rows.tolist(), _to_bits(diff[rows], w)):
            packed[r] = k[: -(-int(lens[r]) * int(w) // 8)].tobytes()
    at, many = np.nonzero(over)[1].astype("<u2").tobytes(), diff[over].astype("<u4").tobytes()
    ends = np.cumsum(n_over).tolist()
    for r in np.flatnonzero(n_over).tolist():
        a, b = ends[r] - int(n_over[r]), ends[r]
        packed[r] += at[2 * a : 2 * b] + many[4 * a : 4 * b]
    starts = np.fromiter(accumulate(map(len, packed), initial=0), "<u4", blocks + 1)
    return b"".join(
        [_HEAD.pack(b"PFB1", n, block, blocks), starts.tobytes(), low.astype("<u4").tobytes(), width.tobytes(), n_over.astype("<u2").tobytes(), *packed]
    )


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The identifiers of an image; with ``first`` and ``last``, of those blocks alone."""
    magic, n, block, blocks = _HEAD.unpack_from(image)
    if magic != b"PFB1":
        raise ValueError("not a segment image")
    at = _HEAD.size
    starts = np.frombuffer(image, "<u4", blocks + 1, at).astype(np.int64)
    low = np.frombuffer(image, "<u4", blocks, at := at + 4 * (blocks + 1))
    width = np.frombuffer(image, np.uint8, blocks, at := at + 4 * blocks)
    n_over = np.frombuffer(image, "<u2", blocks, at := at + blocks)
    body = np.frombuffer(image, np.uint8, offset=at + 2 * blocks)
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    out = np.zeros((last - first, block), np.uint32)
    lens = np.full(blocks, block)
    if blocks:
        lens[-1] = n - block * (blocks - 1)
    for w in np.unique(width[first:last]).tolist():
        rows = first + np.flatnonzero(width[first:last] == w)
        size = -(-block * w // 8)
        raw = np.zeros((len(rows), size), np.uint8)
        for k, r in enumerate(rows.tolist()):
            have = -(-int(lens[r]) * w // 8)
            raw[k, :have] = body[starts[r] : starts[r] + have]
        out[rows - first] = _from_bits(raw, w, block)
    k = n_over[first:last].astype(np.int64)
    row = np.repeat(np.arange(last - first), k)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    tail = (starts[first + 1 : last + 1] - 6 * k)[row]
    number = lambda begin, size: np.stack([body[begin + i] for i in range(size)], 1).reshape(-1).view(f"<u{size}")
    if len(row):
        out[row, number(tail + 2 * nth, 2)] = number(tail + 2 * k[row] + 4 * nth, 4)
    out += low[first:last, None]
    return out.reshape(-1)[: (n if last == blocks else last * block) - first * block]


def write_segments(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    block: int = 256,
    percentile: float = 98.0,
    segment_ids: int = 1 << 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending ``doc_id`` order to ``path``."""

    def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), tokens.encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        lens: list[int] = []
        before = total = 0

        def emit() -> tuple:
            return part, before, total, ids, lens, pack(np.frombuffer(b"".join(held), enc.dtype), block, percentile)

        for doc_id, coded in enc.encode_rows(rows):
            ids.append(doc_id)
            held.append(coded + end)
            lens.append(len(held[-1]) // enc.dtype.itemsize)
            total += lens[-1]
            if total >= segment_ids:
                yield emit()
                ids, held, lens, total, before = [], [], [], 0, before + total
        if ids:
            yield emit()

    docs = texts_of(docs, id_col, text_col)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_rows(ordered, SEGMENT_SCHEMA, segments).write.parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    """The segments' table with ``base``: the identifiers in all segments before.

    """
    found = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    return with_bases(found, "part", "n_ids").withColumn("base", F.col("base") + F.col("part_start"))


def read_documents(spark, path: str, digest: bool = False) -> DataFrame:
    """Documents from the written files: ``doc_id, start, n_tokens`` and ``ids``, or with ``digest`` their ``ids_crc32``."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_ids, lens, image, base in rows:
            ids, at = unpack(image).astype("<u4"), 0
            for doc_id, n in zip(doc_ids, lens):
                own = ids[at : at + n]
                yield doc_id, base + at, n, zlib.crc32(own.tobytes()) if digest else own.tolist()
                at += n

    last = "ids_crc32 long" if digest else "ids array<long>"
    found = read_segments(spark, path).select("doc_ids", "doc_lens", "image", "base")
    return map_rows(found, f"doc_id long, start long, n_tokens long, {last}", each)


def op10_binary_ids(spark, sf_dir: str) -> DataFrame:
    """Encode, write and read back all documents; one row a document."""
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path, digest=True)

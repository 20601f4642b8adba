"""Operator 3: packing by concatenating and cutting.

Pass one encodes every text in scan order, adds the separator, and writes identifiers with
their start inside the partition; partition totals, one number a partition, give each
partition its global offset. Pass two cuts the endless run of identifiers into fixed
windows; a document that crosses a border yields one record on either side. No row moves
between tasks. Only the last window is padded.

Defined results: a null text is empty and has the separator alone; an empty table gives no
rows; repeated rows are packed as often as they occur; a document longer than a window
fills several; other columns are ignored. The order of the run is the order of the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows, new_path, texts_of, with_bases

CODED_SCHEMA = "part int, doc_id long, part_start long, n_ids long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_run(docs: DataFrame, path: str, tokenizer_path: str, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Pass one: write every document's identifiers and its start within its partition."""

    def coded(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, enc, at = TaskContext.get().partitionId(), tokens.encoder(tokenizer_path), 0
        end = np.array([separator], enc.dtype).tobytes()
        try:
            for doc_id, ids in enc.encode_rows(rows):
                ids += end
                n = len(ids) // enc.dtype.itemsize
                yield part, doc_id, at, n, ids
                at += n
        finally:
            enc.forget()  # later tasks of this worker, of whatever operator, need the memory

    map_rows(texts_of(docs, id_col, text_col), CODED_SCHEMA, coded).write.parquet(path)


def cut(base: int, n: int, window: int) -> Iterator[tuple[int, int]]:
    """Start and end, inside a document of ``n`` identifiers at global offset ``base``, of each window's piece."""
    at = 0
    while at < n:
        to = min(n, at + window - (base + at) % window)
        yield at, to
        at = to


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, separator: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece; ``with_ids`` adds its identifiers. Sequences can be put together by ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    path = new_path(spark, "packing")
    encode_run(docs, path, tokenizer_path, separator, id_col, text_col)
    found = spark.read.schema(CODED_SCHEMA).parquet(path)
    placed = with_bases(found, "part", "n_ids")

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, base, n, raw in rows:
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            for a, b in cut(base, n, window):
                own = ids[a:b]
                row = doc_id, a, b - a, zlib.crc32(own.tobytes()), n, (base + a) // window, (base + a) % window
                yield (*row, own.tolist()) if with_ids else row

    placed = placed.select("doc_id", (F.col("base") + F.col("part_start")).alias("at"), "n_ids", "ids")
    return map_rows(placed, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""), pieces)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 identifiers."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

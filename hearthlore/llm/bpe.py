"""Operator 5: byte-level BPE encoding and decoding over Arrow batches.

``encode`` merges with the tokenizers library and can give each identifier's character
span: token byte lengths add up to byte offsets, which a byte-to-character map turns into
characters; a character split over several identifiers lies in the span of each.
``decode`` reverses the byte table; bytes are put together before they are read as UTF-8,
so split characters come back whole.

Defined results: a null text is empty: no identifiers, no bytes; an empty table gives no
rows; repeated rows and identifiers stay; an unknown identifier raises; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import tokens
from .common import map_rows, texts_of

_tables: dict[str, "Decoder"] = {}


class Decoder:
    """Identifiers to bytes, by the tokenizer's own vocabulary."""

    def __init__(self, tokenizer):
        byte = {c: b for b, c in enumerate(tokens.byte_chars())}
        vocab = tokenizer.get_vocab()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            self.bytes[i] = shown.encode() if shown in special else bytes(byte[c] for c in shown)
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.shown = [str(i).encode() for i in range(len(self.bytes))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each identifier's characters."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char[starts], char[ends - 1] + 1


def decoder(path: str, pattern: str | None = None) -> Decoder:
    """This worker's decoder for a file."""
    if path not in _tables:
        _tables[path] = Decoder(tokens.encoder(path, pattern).tokenizer)
    return _tables[path]


def encode(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` and, with ``offsets``, ``starts`` and ``ends`` in characters."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc, dec = tokens.encoder(path, pattern), decoder(path, pattern)
        for doc_id, text in rows:
            ids = np.frombuffer(enc.encode(text), enc.dtype)
            yield (doc_id, ids.tolist(), *(x.tolist() for x in dec.spans(text, ids))) if offsets else (doc_id, ids.tolist())

    schema = "doc_id long, ids array<int>" + ", starts array<long>, ends array<long>" * offsets
    return map_rows(texts_of(docs, id_col, text_col), schema, each)


def decode(coded: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the bytes of each row's identifiers; null identifiers give no bytes."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        dec = decoder(path, pattern)
        for doc_id, ids in rows:
            yield doc_id, dec.decode(ids or [])

    return map_rows(coded.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), "doc_id long, decoded binary", each)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        enc, dec = tokens.encoder(path, pattern), decoder(path, pattern)
        for doc_id, text in rows:
            ids = np.frombuffer(enc.encode(text), enc.dtype).tolist()
            shown = hashlib.sha256(b",".join(map(dec.shown.__getitem__, ids))).hexdigest()
            yield doc_id, len(ids), shown, hashlib.sha256(dec.decode(ids)).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(texts_of(docs, id_col, text_col), schema, each)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents by the ranks of the multilingual file, encoded and decoded."""
    import public_tokenizers as p

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)

"""Operator 7: token counts by byte-pair merging, without identifiers.

A unit (a run of spaces with the word that follows it) is a linked list of characters and a
heap of adjacent pairs; the pair with the best score, the leftmost of equals, is merged
until none is left. The count is the number of symbols at the start less the merges; a
character outside the vocabulary counts as its bytes. No piece of the vocabulary has a
space mark behind another character or contains a line feed, so units are counted apart
and a worker remembers their counts. A model that isn't of this kind (another algorithm, a
normalizer, user-defined pieces, no byte fallback, no dummy prefix) is counted by its library.

Defined results: a null or empty text has no tokens; an empty table gives no rows; repeated
rows stay; the longest unit takes n log n steps; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows, texts_of
from .tokens import Missing

MARK = "▁"
_units = re.compile(" *[^ \n]+| +|\n").findall
_held: dict[str, "Counter"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield number, raw[at : at + size]
            at += size


def counts_as_assumed(proto: bytes) -> bool:
    """Whether a sentencepiece model merges pairs of the text as it stands, behind a dummy prefix, with bytes for unknown characters."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(proto):
        if number == 1:
            pieces.append(dict(_fields(value)).get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    merging = trainer.get(3, 1) == 2 and trainer.get(35, 0) == 1 and not trainer.get(24, 0)
    as_it_stands = not normalizer.get(2, b"") and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
    return merging and as_it_stands and not {4, 5} & set(pieces)  # neither user-defined nor unused ones


class Counter:
    """Counts as the sentencepiece library gives them for a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = None if counts_as_assumed(model.serialized_model_proto()) else model
        if self.library:
            return
        usual = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.scores = {model.id_to_piece(i): -model.get_score(i) for i in usual}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("pieces of this model reach across words; units can't be counted apart")
        self.words = Missing(lambda word: self._word(MARK + word))
        self.others = Missing(lambda unit: self.merge(unit.replace(" ", MARK)))

    def merge(self, unit: str) -> int:
        """The number of tokens of one unit."""
        scores, parts = self.scores, list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(scores[p], i, p) for i in range(n - 1) if (p := unit[i : i + 2]) in scores]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] is None or len(parts[i]) + len(parts[j]) != len(pair):
                continue  # one side has been merged with something else meanwhile
            parts[i], parts[j] = pair, None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + parts[k]) in scores:
                    heapq.heappush(heap, (scores[p], i, p))
            if (k := before[i]) >= 0 and (p := parts[k] + pair) in scores:
                heapq.heappush(heap, (scores[p], k, p))
        return count + sum(len(p.encode()) - 1 for p in parts if p and len(p) == 1 and p not in scores)

    def _word(self, word: str) -> int:
        first, *rest = word.split("\n")
        return self.merge(first) + sum(1 + self.others[x] for x in rest)

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        if self.library:
            return len(self.library.encode(text))
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            return sum(map(self.others.__getitem__, _units(" " + text)))
        return sum(map(self.words.__getitem__, text.split(" ")))


def counter(path: str) -> Counter:
    """This worker's counter for a model file."""
    if path not in _held:
        _held[path] = Counter(path)
    return _held[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row a document."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        count = counter(model_path).count
        for doc_id, text in rows:
            n = count(text)
            yield doc_id, len(text.encode()), n, n > limit

    return map_rows(texts_of(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", each)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents under the sentencepiece model."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

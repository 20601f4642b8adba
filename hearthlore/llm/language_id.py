"""Operator 1: language identification by compression.

A text is compressed with each language's raw-content zstandard dictionary, in pieces of
CHUNK bytes; the language whose dictionary gives the smallest output in all is chosen. A
dictionary only helps near a stream's start, so each piece is a stream of its own, and the
margin doesn't shrink as a text grows. Texts are compared by their
lower-cased letters (Unicode's, so numerals such as one half are none), so that markup, digits and junk symbols don't decide. A relative
margin below ``min_margin`` between the best and the second language rejects the decision
(column ``rejected``); the best guess is reported all the same.

The dictionaries are fitted on a bounded sample: per language SAMPLE_DOCS labelled
documents, chosen by a hash of their identifier, SAMPLE_CHARS characters of each, and
DICT_BYTES in all, for the MAX_LANGS most frequent labels. Prediction reads every whole text.

Defined results: a null text or one without letters is ``und`` with score 0, rejected;
ties go to the language with more labelled documents, then by name; rows without a label
teach nothing but are predicted; without any labelled row every text is ``und``; an empty
table gives no rows; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, returning, small_batches, texts_of

#: The bounds of the training sample, for each language.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 200, 600, 1 << 16
#: Bytes of letters that are one stream.
CHUNK = 256
#: The least margin. Of 4,000 labelled texts that the dictionaries didn't see, 2 rightly labelled ones of at least
#: 200 bytes of letters are below it (18 with pieces of 4,096 bytes and a margin of 0.02); of 100 texts of random
#: letters none of 400 words, 1 of 100 words and 34 of 20 words are above it.
LEVEL, MIN_MARGIN = 6, 0.0125
#: Languages that are learnt: the most frequent labels.
MAX_LANGS = 200
_letters = regex.compile(r"\p{L}+").findall


def letters_of(text: str) -> bytes:
    """A text's lower-cased words of letters."""
    return " ".join(_letters(text.lower())).encode()


def fold(id_col: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its identifier as text, modulo ``folds``; null identifiers are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Each language's dictionary content, the most frequent language first."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    rows = rows.where("l IS NOT NULL AND t IS NOT NULL")
    n = {r.l: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGS).collect()}
    rows = rows.where(F.col("l").isin(list(n)))
    heads = rows.select("l", "i", F.substring("t", 1, SAMPLE_CHARS).alias("t")).where("t <> ''")
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "t")
    sample = heads.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    parts: dict[str, list[bytes]] = {x: [] for x in n}
    for r in sample.orderBy("l", "k").collect():
        parts[r.l].append(letters_of(r.t))
    return [(x, b"\n".join(parts[x])[-DICT_BYTES:]) for x in sorted(n, key=lambda x: (-n[x], x))]


class Decider:
    """``(language, score, rejected)`` of a text."""

    def __init__(self, model: list[tuple[str, bytes]], min_margin: float):
        import zstandard

        self.min_margin, self.coders = min_margin, []
        for k, (lang, content) in enumerate(model):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append((k, lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))

    def __call__(self, text: str) -> tuple[str, float, bool]:
        own = letters_of(text)
        if not own or not self.coders:
            return "und", 0.0, True
        chunks = [own[at : at + CHUNK] for at in range(0, len(own), CHUNK)]
        sizes = sorted((sum(len(c.compress(x)) for x in chunks), k, lang) for k, lang, c in self.coders)
        score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][2], score, score < self.min_margin


def identify(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; the score is the relative margin of the best language."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        decide = Decider(model, min_margin)
        for doc_id, text in rows:
            yield doc_id, *decide(text)

    return map_rows(texts_of(docs, id_col, text_col), "doc_id long, lang_pred string, score double, rejected boolean", each)


def decided(docs: DataFrame, model: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decide = Decider(model, min_margin)
        for texts in batches:
            yield texts.map(lambda t: not decide(t or "")[2])

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from returning(each(batches))

    return small_batches(docs).where(keep(F.col(f"`{text_col}`")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Learn from four folds of the labelled documents, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")

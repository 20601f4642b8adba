"""From documents to packed training sequences.

Four stages, each an operator of ``hearthlore.llm``: language identification drops what it
rejects, the n-gram Jaccard join keeps one document of each group of near duplicates (the
smallest identifier), personal data is replaced by its kind in brackets, and the texts are
packed into windows of 2048 identifiers. All but the last return the columns of documents.

Defined results: null texts are rejected by the first stage; rows of one identifier are near
duplicates of each other, whatever their texts: the one of the smallest text stays, of equal
texts the one whose other columns, in the table's order, are smallest (nulls first); rows
without an identifier are linked with nothing and all stay; extra columns, whatever their
names, are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlore.llm import common, language_id, ngram_join, packing, pii


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; the dictionaries are learnt from the labels of ``docs``."""
    return language_id.decided(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, and all without an identifier."""
    found = common.written(ngram_join.join(docs), "components")
    kept = found.where("doc_id = component_id").select("doc_id")
    n, distinct = kept.agg(F.count("*"), F.countDistinct("doc_id")).collect()[0]
    kept = kept.distinct()
    out = docs.join(F.broadcast(kept) if distinct <= ngram_join.ROUTES else kept, "doc_id", "left_semi")
    out = smallest(out) if n > distinct else out
    return out.unionByName(docs.where("doc_id IS NULL"))


def smallest(docs: DataFrame) -> DataFrame:
    """One row of each identifier, that of the smallest text; other columns that have an order decide between equal texts."""
    names = [f"`{c}`" for c in docs.columns]
    ordered = [n for n, (_, kind) in zip(names, docs.dtypes) if "map<" not in kind and "variant" not in kind]
    kept = docs.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct("text", *ordered)).alias("kept"))
    return kept.select("kept.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, and their new lengths."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("ngram_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

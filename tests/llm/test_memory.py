"""What Python workers keep from one operator to the next counts for the executor."""

import pyarrow as pa
import pytest
from conftest import SF

public = pytest.importorskip("public_tokenizers")

from hearthlore.llm import common, packing, tokens  # noqa: E402


def test_workers_forget_units_after_packing(spark, docs):
    """After packing, no worker remembers a unit, in whatever task it is used again."""
    assert packing.pack_documents(docs.repartition(4), public.path("byte_bpe_50k.json")).count()

    def remembered(batches):
        list(batches)
        found = [len(m) + len(m.old) for e in tokens._held.values() for m in (e.pieces, e.whole, e.spaced)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(found), sum(found)], pa.int64())})

    found = [r.n for r in spark.range(64).repartition(16).mapInArrow(remembered, "n long").collect()]
    assert sum(found[::2]) and not sum(found[1::2])


def test_bases_start_no_python_workers(spark):
    """Partition totals go from the driver to the tasks without an RDD of Python rows; the bases are right, of none too."""
    found = spark.createDataFrame([(3, 5), (1, 7), (3, 1), (2, 4)], "part int, n long")
    placed = common.with_bases(found.where("part > 0"), "part", "n")
    assert sorted((r.part, r.n, r.base) for r in placed.collect()) == [(1, 7, 0), (2, 4, 7), (3, 1, 11), (3, 5, 11)]
    assert placed.schema["base"].dataType.simpleString() == "bigint" and placed.schema["part"].dataType.simpleString() == "int"
    assert common.with_bases(found.where("part > 9"), "part", "n").collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("CAST(doc_id % 3 AS INT) AS part", "n_chars AS n")
    assert "ExistingRDD" not in common.with_bases(docs, "part", "n")._jdf.queryExecution().toString()


def test_returning_hands_on_all_rows():
    assert list(common.returning(iter(range(5)))) == [0, 1, 2, 3, 4]

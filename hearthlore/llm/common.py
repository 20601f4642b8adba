"""What several operators of this subpackage share.

One setting of the session is made where the caller has none: ``small_batches`` says which.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows gathered before an output batch is handed back, and the bytes of payload that end a batch early.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows that Spark sends to a Python worker at once.
ARROW_ROWS = 1000
#: Partition totals that are broadcast.
BASES = 1_000_000


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (master ``local``) gets a temporary folder;
    any other raises, as its executors don't see each other's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        at = _local[0]
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this run that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, what: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, to be handed to Python workers ARROW_ROWS rows at a time, as texts can be long.

    Spark reads this when a result is computed, which may be after the operator has returned, so it
    is a setting of the session. A caller's own value of it stays as it is.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators on texts need, as ``doc_id`` and ``text``; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def with_bases(found: DataFrame, part: str, count: str) -> DataFrame:
    """``found`` with ``base``: the sum of ``count`` over all partitions of lower number.

    The driver adds up one total a written partition, never one a row. The totals travel to
    the tasks by broadcast up to BASES of them (16 MB), beyond by an ordinary join.
    """
    totals = sorted(found.groupBy(part).agg(F.sum(count).alias("n")).collect())
    bases = list(zip([p for p, _ in totals], accumulate((n for _, n in totals), initial=0)))
    # as an Arrow table the driver hands them over itself; a list would start Python workers of another kind on each executor
    schema = f"{part} int, base long"
    columns = list(zip(*bases)) or [(), ()]
    rows = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_schema(found.sparkSession, schema).types)], [part, "base"])
    before = found.sparkSession.createDataFrame(rows, schema)
    return found.join(F.broadcast(before) if len(bases) <= BASES else before, part)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in their group, and the group's size ``n``; no group needs to fit a task.

    Rows are ranged and sorted by group and order; a count for each partition and group, summed up
    over the partitions before, gives what stands in front. Equal rows may be dealt to several
    partitions. The rows are written twice: before the ranging, which reads them twice, and after it.
    """
    by = [group, *order, "tie"]
    ties = written(rows, "rows").withColumn("tie", F.monotonically_increasing_id())
    ranged = ties.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", row), "ranged")
    runs = ranged.groupBy(F.col(group).alias("run_group"), F.col("part").alias("run_part")).agg(F.count("*").alias("own"), F.min("row").alias("first"))
    w = Window.partitionBy("run_group")  # as many rows as a group has partitions
    before = F.coalesce(F.sum("own").over(w.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("shift", before - F.col("first")).withColumn("n", F.sum("own").over(w)).drop("own", "first")
    found = ranged.join(runs, (F.col("part") == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_group")))
    return found.withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift", "run_group", "run_part")


def map_rows(df: DataFrame, schema: str, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``each`` maps one partition's rows (tuples) to rows; both sides travel as bounded Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns))

        yield from returning(batches_of(each(rows()), arrow))

    arrow = arrow_schema(df.sparkSession, schema)
    return small_batches(df).mapInArrow(run, schema)


def returning(out: Iterator) -> Iterator:
    """``out``; at its end this worker hands unused memory back to the machine.

    Spark uses Python workers again, from stage to stage, and what their allocators keep counts for the executor.
    """
    try:
        yield from out
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most BATCH_ROWS rows or about BATCH_BYTES bytes."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

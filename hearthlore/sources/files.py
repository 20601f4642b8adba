"""Files as tables: manifests, artifacts, listings and JSON metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a sums file as ``value``."""
    return spark.read.text(path)


def _relative(root: str):
    return F.regexp_replace("path", r"^.*\Q" + root.rstrip("/").removeprefix("file://") + r"\E/", "")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative) and ``content`` of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(_relative(root).alias("path"), "content")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative) and ``length`` of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(_relative(root).alias("path"), "length")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with its nested schema; text that isn't JSON gives a row of nulls."""
    return spark.read.option("multiLine", True).json(path)

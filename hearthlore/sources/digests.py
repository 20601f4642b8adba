"""Files of any size as rows of path, length and digest, hashed piece by piece.

``binaryFile`` loads a file as one value, which ends at 2 GB. This source reads pieces of a few
megabytes, so a task needs no more memory for a checkpoint of 100 GB than for a text. Files are
listed once, on the driver; small ones share a task up to ``taskBytes``, a larger one has a task
of its own, since a digest is one run over a file's bytes. Paths may be local to all machines
(``/mnt/...``, ``file:``) or of a store that Arrow can open (``s3:``, ``gs:``, ``hdfs:``).

``spark.read.format("file_digests").option("pieceBytes", 1 << 20).load(root)`` gives ``path``
(below the root), ``length`` and ``digest`` (lowercase SHA-256); a root that is a file has one
row, named by the file; an empty folder has none; files that go away meanwhile fail the task.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once, and of files that share a task.
PIECE, TASK = 8 << 20, 128 << 20


def _open(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in root and not root.startswith("file:"):
        return LocalFileSystem(), root
    return FileSystem.from_uri("file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root)


@dataclass
class Files(InputPartition):
    """Paths in the file system, their names below the root, and their lengths when they were listed."""

    files: list[tuple[str, str, int]]

    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(None)
        self.files = files


def dealt(files: list[tuple[str, str, int]], task_bytes: int) -> list[Files]:
    """Files in tasks: no two share one if they are longer together than ``task_bytes``."""
    out, held, size = [], [], 0
    for f in sorted(files):
        if held and size + f[2] > task_bytes:
            out.append(Files(held))
            held, size = [], 0
        held.append(f)
        size += f[2]
    return [*out, Files(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("file_digests has to be given a path")
        self.root = options["path"].rstrip("/") or "/"
        self.piece, self.task = (int(options.get(k, v)) for k, v in (("pieceBytes", PIECE), ("taskBytes", TASK)))
        if self.piece < 1 or self.task < 1:
            raise ValueError("pieceBytes and taskBytes have to be above 0")

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _open(self.root)
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File]
        name = lambda f: posixpath.relpath(f.path, root) if f.path != root else posixpath.basename(root)
        return dealt([(f.path, name(f), f.size) for f in found], self.task) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        fs, _ = _open(self.root)
        buffer = memoryview(bytearray(self.piece))
        for path, name, listed in partition.files:
            digest, length = hashlib.sha256(), 0
            with fs.open_input_file(path) as f:
                while n := f.readinto(buffer):
                    digest.update(buffer[:n])
                    length += n
            if length != listed:
                raise OSError(f"{path} had {listed} bytes when it was listed and has {length} now")
            yield name, length, digest.hexdigest()


class FileDigests(DataSource):
    """The source ``file_digests``."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length long, digest string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)  # whose names have no case


def file_digests(spark: SparkSession, root: str, piece_bytes: int = PIECE, task_bytes: int = TASK) -> DataFrame:
    """``path, length, digest`` of all files below a folder."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("pieceBytes", piece_bytes).option("taskBytes", task_bytes).load(root)

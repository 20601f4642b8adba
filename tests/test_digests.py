"""Files hashed in pieces."""

import hashlib
import os

import pytest

from hearthlore.operators import artifacts
from hearthlore.sources import digests


def test_pieces_and_tasks(spark, tmp_path):
    sizes = {"a": 0, "b.bin": 1, "sub/c": 99, "sub/d d": 100, "sub/deep/é": 101, "z": 1000}
    want = []
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        data = os.urandom(n)
        (tmp_path / name).write_bytes(data)
        want.append((name, n, hashlib.sha256(data).hexdigest()))
    for piece, task in ((1, 1), (100, 150), (7, 10**6), (1 << 20, 1 << 30)):
        for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
            got = digests.file_digests(spark, root, piece, task)
            assert sorted(map(tuple, got.collect())) == sorted(want)
    assert digests.file_digests(spark, str(tmp_path), 100, 150).rdd.getNumPartitions() > 2
    assert [(r.path, r.length) for r in digests.file_digests(spark, str(tmp_path / "z")).collect()] == [("z", 1000)]
    (tmp_path / "none").mkdir()
    assert digests.file_digests(spark, str(tmp_path / "none")).collect() == []
    for wrong, options in ((tmp_path / "absent", (1, 1)), (tmp_path, (0, 1))):
        with pytest.raises(Exception, match="absent|above 0"):
            digests.file_digests(spark, str(wrong), *options).collect()


def test_deal():
    files = [(str(i), str(i), n) for i, n in enumerate([5, 5, 5, 100, 1, 1])]
    assert [[n for *_, n in p.files] for p in digests.dealt(files, 10)] == [[5, 5], [5], [100], [1, 1]]
    assert digests.dealt([], 10) == []


def test_sql(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    spark.dataSource.register(digests.FileDigests)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW sums USING file_digests OPTIONS (path '{tmp_path}', pieceBytes '2')")
    assert [r.digest for r in spark.sql("SELECT digest FROM sums WHERE length = 3").collect()] == [hashlib.sha256(b"abc").hexdigest()]


def test_more_than_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB, which no row can hold."""
    n = 3 << 30
    with open(tmp_path / "big.pt", "wb") as f:
        f.truncate(n)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(n >> 24):
        digest.update(zeros)
    manifest = spark.createDataFrame([(digest.hexdigest(), "big.pt", False), ("0" * 64, "big.pt", False)], "digest string, rel string, malformed boolean")
    got = artifacts.integrity_verify(manifest, digests.file_digests(spark, str(tmp_path)))
    assert sorted(r.status for r in got.collect()) == ["FAIL", "OK"]

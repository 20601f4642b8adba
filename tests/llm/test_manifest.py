"""The dataset manifest against a plain tree, its SQL, and random shapes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from conftest import EDGES, SF
from pyspark.sql import functions as F

from hearthlore.llm import manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def mark(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fanout=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain(rows, fanout=3):
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` from ``(doc_id, text, lang, source, n_chars)``."""
    by = {}
    for i, text, lang, source, n in rows:
        fields = lambda t: H(mark(i), mark(source), mark(lang), mark(n), mark(t))  # noqa: E731, B023
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None
        by.setdefault(source, []).append((i, fields(text), fields(text.replace("\n", "")) if hit else fields(text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels_of([leaf for _, leaf, _ in by[s]], fanout)
    top = levels_of([trees[s][-1][0] for s in order], fanout)
    for k, s in enumerate(order):
        for at, (i, leaf, now) in enumerate(by[s]):
            proof, folded = "", now
            for levels, p in ((trees[s], at), (top, k)):
                for nodes in levels[:-1]:
                    first = p - p % fanout
                    left, right = "".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])
                    proof, folded, p = proof + left + right, H(left, folded, right), p // fanout
            yield i, leaf, trees[s][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]


KEY = lambda r: tuple(str(v) for v in r)
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def got_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=KEY)


def test_op12(spark, docs):
    got = manifest.op12_manifest(spark, SF)
    rows = got_of(got)
    assert rows == sorted(plain([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]), key=KEY)
    assert {v for *_, v in rows} == {True, False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(manifest.OP12_SQL)
    assert want.columns == NAMES and sorted(want.fetchall(), key=KEY) == rows


def test_op12_edges(spark, empty):
    rows = [(i, t, None if k % 3 else "en", (None, "", "-", "é", "s")[k % 5], None if k % 2 else k) for k, (i, t) in enumerate(EDGES)]
    rows += [(6, "same\nrow", "x", "hot", 1)] * 9 + [(None, "a\nb", "x", "hot", 1), (2**62, "\n", None, None, -5)]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", grp int, leaf string, `a.b` string")
    for height in (1, 2, 7):
        assert got_of(manifest.documents_manifest(frame, height=height)) == sorted(plain(rows), key=KEY)
    assert manifest.documents_manifest(empty).collect() == []
    (lone,) = manifest.documents_manifest(frame.where("doc_id = 8")).collect()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == H("") and lone.verified
    with pytest.raises(ValueError):
        manifest.documents_manifest(frame, fanout=1)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_any_number_of_blocks(spark, fanout):
    """Groups of all sizes, some with last subtrees that lack blocks, in small blocks, so that several rounds are swapped."""
    rng = random.Random(fanout)
    sizes = [*range(1, 12), 26, 27, 28, 55, 81, 82, 109, 163, 200]
    rows = [(i, f"t\n{rng.random()}", "x", f"g{n:03}", 1) for n in sizes for i in rng.sample(range(10**6), n)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got_of(manifest.documents_manifest(frame, fanout, 1)) == sorted(plain(rows, fanout), key=KEY)


def test_proofs_fold_to_the_root(spark, docs):
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), manifest.leaf("doc_id", "text").alias("leaf")).withColumn("now", F.col("leaf"))
    got = manifest.dataset_manifest(rows, height=2, with_proof=True).collect()
    assert len(got) == docs.count() and len({r.root for r in got}) == 1
    assert all(r.verified and manifest.fold(r.leaf, r.proof) == r.root for r in got)


def test_the_exchange_alone(spark):
    """Every block ends with the root and with its own siblings, though none was told from above."""
    n = 100
    blocks = spark.createDataFrame([("g", i, n, H(str(i))) for i in range(n)], "grp string, block long, n_blocks long, root string")
    up = {r.block: r for r in manifest.butterfly(blocks).collect()}
    levels = levels_of([H(str(i)) for i in range(n)])
    assert {r.subroot for r in up.values()} == {levels[-1][0]}
    for i, r in up.items():
        assert [(x.l, x.r) for x in r.above] == manifest.path(levels, i, 3)

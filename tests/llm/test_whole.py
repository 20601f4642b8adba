"""Results that have to hold for long, repeated or unidentified rows too."""

import random

import numpy as np
import pytest
from conftest import EDGES, SF
from test_ngram_join import KEY, brute

from hearthlore.llm import common, language_id, ngram_join


def test_margin_at_any_length(spark, docs):
    rng, texts = random.Random(5), []
    for lang in ("en", "de"):
        words = " ".join(r.text for r in docs.where(f"lang = '{lang}' AND n_chars > 200").collect()).split()
        texts += [(lang, " ".join(rng.choices(words, k=n))) for n in (200, 20_000, 400_000)]
    assert max(len(t) for _, t in texts) > 2_000_000
    texts += [(None, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200 if k else 100_000))) for k in range(50)]
    decide = language_id.Decider(language_id.fit(docs), language_id.MIN_MARGIN)
    for lang, text in texts:
        found, margin, rejected = decide(text)
        assert rejected == (lang is None) and lang in (None, found), (lang, found, margin, len(text))


def test_rows_without_identifier_stay(spark, docs):
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clean = docs.where("lang = 'en' AND n_chars > 500").orderBy("doc_id").limit(5).collect()
    rows = [(i, t, "en", "x", 1) for i, t in EDGES] + [(None, r.text, "en", "x", 1) for r in clean for _ in range(2)]
    now = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.written(stage(spark, now, SF), name)
        assert now.where("doc_id IS NULL AND length(text) > 400").count() == 10, name
        if name == "ngram_join":
            assert now.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    unidentified = now.where("doc_id IS NULL")
    assert stage(spark, now, SF).where("doc_id IS NULL").agg({"length": "sum"}).collect() == stage(spark, unidentified, SF).agg({"length": "sum"}).collect()


def test_repeated_identifiers_link_all_their_texts(spark):
    x, y, z, u, v = (" ".join(f"{c}{k}" for k in range(12)) for c in "xyzuv")
    rows = [(1, x), (2, y), (3, z), (9, x), (9, y), (9, z), (13, u), (15, u), (15, v)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(frame).collect()), key=KEY)
    assert got == sorted(brute(rows), key=KEY)
    assert {i: c for i, _, c in got} == {1: 1, 2: 1, 3: 1, 9: 1, 13: 13, 15: 13}


def test_short_texts_that_share_shingles(spark):
    words = [f"c{k}" for k in range(10)]
    sizes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    rows = [(100 * n + k, " ".join(words[:n] + [f"x{n}y{k}"] * (k > 0))) for n in sizes for k in range(6)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(rows), key=KEY)


def test_short_sets_give_no_single_signatures():
    # many different sets of 5 and 6 that share a shingle: no list gathers them by it
    rng, shared = np.random.default_rng(3), np.uint64(0)
    sets = [np.unique(np.append(rng.integers(1, 1 << 64, n - 1, dtype=np.uint64), shared)) for n in (5, 6) for _ in range(500)]
    level = np.ones(ngram_join.SKETCH, np.uint8)
    found = [ngram_join.signatures(x, level) for x in sets]
    assert not any(len(f[0][0]) or len(f[1][0]) for f in found)
    keys = np.concatenate([f[2] for f in found])
    assert len(np.unique(keys)) == len(keys)

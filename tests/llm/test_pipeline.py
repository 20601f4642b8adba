"""The pipeline's stages, each against brute force on its own input."""

import re

import pytest
from conftest import SF
from test_ngram_join import brute
from test_pii import plain

public = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from hearthlore.llm import common  # noqa: E402


def test_stages(spark, docs, empty):
    now, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.written(stage(spark, now, SF), name)
        if name != "packing":
            assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
            old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in now.collect()}
            assert now.count() == len(new)
        if name == "language_id":
            assert all(new[i] == old[i] for i in new)
            assert all(not re.search(r"[^\W\d_]{4}", old[i].text) or len(old[i].text) < 100 for i in old.keys() - new.keys())
        if name == "ngram_join":
            assert new.keys() == {i for i, _, c in brute([(i, r.text) for i, r in sorted(old.items())]) if i == c}
        if name == "pii":
            assert new.keys() == old.keys() and not any(plain(r.text) for r in new.values())
            assert all(new[i].text == old[i].text for i in new if not re.search("[0-9@]", old[i].text))
            assert all(r.n_chars == len(r.text) for r in new.values())
            texts = {i: r.text for i, r in new.items()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    got = now.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r[1] for r in got} == want
    assert corpus_pipeline.run(spark, SF).count() == now.count()


def test_empty(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_repeated_identifiers_keep_the_smallest_text(spark):
    """Forty rows of one identifier with different texts, dealt in several ways; extra columns of clashing names go along."""
    text = lambda i, k: " ".join(f"w{i}x{j}" for j in range(8)) + f" t{k:02}"
    rows = [(9, text(9, k), "en", "s", k, "z", {"a": k}, k) for k in range(40)] + [(8, text(8, 0), lang, "s", 1, "z", None, 7) for lang in ("fr", None, "de")] + [(None, text(7, k), "en", "s", k, "z", None, 1) for k in range(2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, m map<string,int>, `a.b` int"
    found = set()
    for parts in (1, 3, 7):
        for order in ("n_chars", "text"):
            frame = spark.createDataFrame(rows, schema).repartition(parts, order)
            got = corpus_pipeline.drop_near_duplicates(spark, frame, SF)
            assert got.columns == frame.columns
            found.add(tuple(sorted((str(tuple(r)) for r in got.collect()))))
    assert found == {tuple(sorted(str(r) for r in [rows[0], (8, text(8, 0), None, "s", 1, "z", None, 7), *rows[-2:]]))}

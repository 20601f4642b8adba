"""Operators on tokens against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import EDGES, SF

public = pytest.importorskip("public_tokenizers")

from hearthlore.llm import binary_ids, bpe, common, packing, token_counts, tokens  # noqa: E402

JSON = public.path("byte_bpe_50k.json")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_segment_images():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 50, 60_000, 2**32 - 1):
            v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
            v[: n // 9] //= 7
            for p in (50, 98, 100):
                image = binary_ids.pack(v, 256, p)
                assert (binary_ids.unpack(image) == v).all()
                assert (binary_ids.unpack(image, 1, 3) == v[256:768]).all()


def test_op10(spark, rows):
    got = sorted(map(tuple, binary_ids.op10_binary_ids(spark, SF).collect()))
    start, want = 0, []
    for (i, _), ids in zip(rows, library_ids(t for _, t in rows)):
        ids = [*ids, 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_op10_edges(spark, edges, empty):
    path = common.new_path(spark, "t")
    binary_ids.write_segments(edges, path, JSON, segment_ids=100)
    got = binary_ids.read_documents(spark, path).collect()
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (i, _), ids, r in zip(order, library_ids(t for _, t in order), sorted(got, key=lambda r: r.start)):
        assert (r.doc_id, r.start, r.ids) == (i, start, [*ids, 2])
        start += len(ids) + 1
    path = common.new_path(spark, "t")
    binary_ids.write_segments(empty, path, JSON)
    assert binary_ids.read_documents(spark, path).collect() == []


def check_packing(pieces, texts, window):
    texts = list(texts)
    pieces = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in pieces:  # gapless, and full but for the last
        assert p.sequence_id * window + p.offset == at and p.offset + p.length <= window
        at += p.length
    docs, whole = [], []
    for p in pieces:
        if p.start == 0:
            whole = []
        assert p.start == len(whole)
        whole += p.ids
        assert p.ids_crc32 == crc(p.ids)
        if len(whole) == p.doc_tokens:
            docs.append((p.doc_id, whole))
    key = lambda d: (d[0] is not None, d[0] or 0, d[1])
    assert sorted(docs, key=key) == sorted([(i, [*ids, 1]) for (i, _), ids in zip(texts, library_ids(t for _, t in texts))], key=key)


def test_op3(spark, docs, rows, edges, empty):
    check_packing(packing.pack_documents(docs, JSON, with_ids=True).collect(), rows, 2048)
    check_packing(packing.pack_documents(edges, JSON, 64, with_ids=True).collect(), EDGES, 64)
    assert packing.pack_documents(empty, JSON).collect() == []
    assert packing.op3_packing(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_op5(spark, rows, edges, empty):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})

    def want(pairs):
        for i, t in pairs:
            ids = enc.encode_ordinary(t or "")
            yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, bpe.op5_byte_bpe(spark, SF).collect())) == sorted(want(rows))
    assert sorted(map(tuple, bpe.round_trip(edges, RANKS, public.PATTERN).collect()), key=key) == sorted(want(EDGES), key=key)
    assert bpe.round_trip(empty, RANKS, public.PATTERN).collect() == []
    coded = bpe.encode(edges, RANKS, public.PATTERN, offsets=True)
    text = {i: t or "" for i, t in EDGES if i != 5}
    for r in coded.collect():
        if r.doc_id in text:
            t, pieces = text[r.doc_id], [enc.decode_single_token_bytes(i) for i in r.ids]
            assert len(r.starts) == len(r.ids) and (not r.ids or r.ends[-1] == len(t))
            assert all(p in t[a:b].encode() for p, a, b in zip(pieces, r.starts, r.ends))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, RANKS, public.PATTERN).collect()}
    assert all(back[i] == t.encode() for i, t in text.items())


def test_op7(spark, rows, edges, empty):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def want(pairs):
        for i, t in pairs:
            n = len(model.encode(t or ""))
            yield i, len((t or "").encode()), n, n > 4096

    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, token_counts.op7_token_counts(spark, SF).collect())) == sorted(want(rows))
    assert sorted(map(tuple, token_counts.token_counts(edges, path).collect()), key=key) == sorted(want(EDGES), key=key)
    assert token_counts.token_counts(empty, path).collect() == []


def test_op7_random_texts():
    import random

    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model, count, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path), random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "①", "ab", "==", "\r", "\t", "日", "\0", "▁", ";\r", "😀"]) for _ in range(rng.randrange(12)))
        assert count.count(t) == len(model.encode(t)), t


def space_texts(n, seed):
    """Texts rich in runs of every character that counts as white space."""
    import random
    import re

    spaces = [c for c in map(chr, range(0x3001)) if re.match(f"[{tokens.SPACE}]", c)]
    assert len(spaces) == 25
    words, rng = ["a", "the", "Para", "indent", "é", "日本", "1", "22", "'s", "...", "x.", "(", "don't", "<|endoftext|>"], random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(spaces if rng.random() < 0.5 else [" ", "\n"]) * rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(1, 12)))


def test_runs_of_any_white_space():
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    library, enc = Tokenizer.from_file(JSON), tokens.encoder(JSON)
    ranks = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})
    own = tokens.encoder(RANKS, public.PATTERN)
    path = public.path("piece_bpe_32k.model")
    model, count = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)
    for k, t in enumerate(["para\n\xa0\xa0indent", "a\r\nb", "a\n\t", *space_texts(50_000, 9)]):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t
        if k % 2:
            assert np.frombuffer(own.encode(t), own.dtype).tolist() == ranks.encode_ordinary(t), t
        else:
            assert count.count(t) == len(model.encode(t)), t


def test_packing_of_mixed_white_space(spark):
    rows = [(i, t) for i, t in enumerate(["para\n\xa0\xa0indent", *space_texts(500, 4)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(packing.pack_documents(frame, JSON, 64, with_ids=True).collect(), rows, 64)
    path = common.new_path(spark, "t")
    binary_ids.write_segments(frame, path, JSON)
    assert [r.ids for r in sorted(binary_ids.read_documents(spark, path).collect(), key=lambda r: r.doc_id)] == [[*ids, 2] for ids in library_ids(t for _, t in rows)]


def marked_texts(n, seed):
    """Texts of single spaces, of words with marks, digits, apostrophes and characters of other kinds around them."""
    import random

    stems = ["", "a", "the", "Été", "naïve", "x2", "7", "日本", "e\u0301", "it's", "o'", "\0", "\u200b", "ͰͲ", "ǅ", "ª", "²", "a\tb", "a.b", "(see", "\u0378", "<|endoftext", "𝐀", "x" * 70]
    marks, rng = ["", "", ".", ",", "...", "###", "'", "'s", ".'s", "'.", "_", "…", "»", ".»", "».", "|>", "%\t", "\x7f", "\x85", "é.", "1,"], random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(stems) + rng.choice(marks) + rng.choice(["", " ", " ", " ", "\n"]) for _ in range(rng.randrange(9)))


def test_texts_encoded_together(monkeypatch):
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(JSON)
    wide.add_tokens([f"<<{k}>>" for k in range(20_000)])
    for tok, n in ((Tokenizer.from_file(JSON), 30_000), (tokens.from_ranks(RANKS, public.PATTERN), 5000), (wide, 100), (Tokenizer.from_file(public.path("word_bpe_49k.json")), 100)):
        enc = tokens.Encoder(tok)
        assert enc.dtype.itemsize == (4 if tok is wide else 2)
        texts = ["", " ", "\n", "a", "a ", " .", "word " * 30_000, *marked_texts(n, 5), *space_texts(n // 3, 6)]
        want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
        for size in (1, 1000, 1 << 21):
            monkeypatch.setattr(tokens, "TOGETHER", size)
            some = slice(0, 2000 if size == 1 else None)
            got = list(enc.encode_rows(enumerate(texts[some])))
            assert [k for k, _ in got] == list(range(len(got)))
            for text, ids, (_, coded) in zip(texts[some], want[some], got, strict=True):
                assert np.frombuffer(coded, enc.dtype).tolist() == ids, text
        assert list(enc.encode_rows([])) == [] and enc.encode_all(["", ""]) == [b"", b""]


def test_distinct_words_of_texts_are_looked_up_once():
    class Counted(tokens.Spaced):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    enc = tokens.Encoder(tokens.from_json(JSON))
    enc.spaced = Counted(enc._after_space, enc.model.tokenize, enc.code)
    words = [f"{a}{b}" for a in ("stem", "été") for b in "abcdefghij"]
    texts = [" ".join([".", *(w + m for w in words for m in ("", ".", ",", "###", "%%%"))])] * 50
    rows = [(k, t) for k, t in enumerate(texts)]
    want = enc.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert all(np.frombuffer(coded, enc.dtype).tolist() == want for _, coded in enc.encode_rows(rows))
    assert enc.spaced.asked == len(words)  # one text at a time asks for each of its 100 words, at least 5,000 times in all


def test_other_tokenizers_go_through_the_library(tmp_path):
    import tiktoken
    from tokenizers import Tokenizer, normalizers

    texts = ["in 123456 (see) it's", "Hello  The World\n\nx", "", "é\xa0\xa0日本"]
    for change in ("normalizer", "prefix", "words"):
        t = Tokenizer.from_file(JSON if change != "words" else public.path("word_bpe_49k.json"))
        if change == "normalizer":
            t.normalizer = normalizers.Lowercase()
        elif change == "prefix":
            t.pre_tokenizer.add_prefix_space = True
        enc = tokens.Encoder(t)
        assert not enc.by_units
        assert [np.frombuffer(enc.encode(x), enc.dtype).tolist() for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    pattern = r"\p{N}{1,3}|[^\p{N}]{1,4}"
    enc, want = tokens.encoder(RANKS, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})
    assert not enc.by_units and tokens.encoder(RANKS, public.PATTERN).by_units and tokens.encoder(JSON).by_units
    assert [np.frombuffer(enc.encode(x), enc.dtype).tolist() for x in texts] == [want.encode_ordinary(x) for x in texts]


def test_other_models_go_through_the_library(tmp_path):
    import sentencepiece

    raw = open(public.path("piece_bpe_32k.model"), "rb").read()
    texts = ["Hello  The   World ", " x\n", "", "日 ①"]
    # behind the model's own fields, a repeated message's fields are merged into it: a user-defined piece; extra white space removed
    for more in (b"\x0a" + bytes([2 + 4 + 5 + 2]) + b"\x0a\x04 The" + b"\x15\0\0\0\0" + b"\x18\x04", b"\x1a\x02\x20\x01"):
        path = tmp_path / f"{len(more)}.model"
        path.write_bytes(raw + more)
        model, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), token_counts.Counter(str(path))
        assert own.library and [own.count(t) for t in texts] == [len(model.encode(t)) for t in texts]
    assert token_counts.counter(public.path("piece_bpe_32k.model")).library is None

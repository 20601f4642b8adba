"""Operator 8: scores of a Katz backoff language model.

Tokens are words with A-Z lower-cased, then one end. With c the training counts, an n-gram
seen after its context h has probability d(c) c / c(h), d being the Good-Turing discount of
counts up to K (1 above) of its order; any other token gets alpha(h) times its probability
under the context without its first word, and so on down to the unigrams, which are
discounted the same way and leave their rest to the unknown token. alpha(h) is the mass that
discounting left, over the lower order's mass of what wasn't seen after h, so each context's
probabilities add up to one. A context without training counts gives the lower order's
probability. Where nothing of a context can be discounted, its total grows by one, and the one
is what is left. Where the count-of-counts give no discount between 0 and 1 for a count r, it
is 1 - 0.5 / r. ``order`` is 2 unless asked otherwise.

Counts are kept in partitioned tables, and a block of documents (about BLOCK_BYTES of text)
asks them only for its distinct words and n-grams:

1. a block numbers its words and sends each word's count to the word's bucket (a range of
   hashes); the bucket adds up and answers with global identifiers and counts;
2. for each order above, the block sends its distinct n-grams (identifier of the context,
   identifier of the word) to their buckets; these add up, write the n-gram table, and answer
   with counts, with what alpha(h) needs, and below the last order with the n-grams'
   identifiers, which are the contexts of the next order;
3. count-of-counts, one row a bucket, give the discounts; the block evaluates its tokens.

Words and n-grams are packed and summed in a block before any shuffle, so a frequent one is
sent once a block. The number of buckets follows from the input's bytes, so a bucket's size
doesn't. A context with more than SPLIT training tokens is dealt over several buckets by its
words; what these know of it is added up by context, and joined to the blocks that ask.
Hashes of 64 bits stand for words.

Defined results: a null or empty text is one end token; an empty table gives no rows; rows of
one identifier are scored each; a null identifier is trained on; without training documents
every token is unknown and has probability one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, new_path, remove, small_batches, texts_of
from .words import blocks, mix, word_hashes

K, BLOCK_BYTES = 5, 4 << 20
#: Bytes of text for each bucket, and training tokens of a context for each bucket that it is dealt to.
BUCKET_BYTES, SPLIT = 16 << 20, 1 << 19
UNKNOWN, START = 0, 1
END = np.uint64(0xE7D5C0DE0E0F1A55)
_R = [f"n{r}" for r in range(1, K + 2)]
STATS = ", ".join(f"{n} long" for n in [*_R, "distinct", "total"])


_coders: dict = {}


def squeeze(a: np.ndarray) -> bytes:
    """An array of counts or numbers, by byte planes of the narrowest width, compressed."""
    import zstandard

    if a.dtype.kind != "f":
        top = int(a.max()) if len(a) else 0
        a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    if "up" not in _coders:
        _coders["up"] = zstandard.ZstdCompressor(level=1)
    return a.dtype.str[1:].encode() + _coders["up"].compress(planes.tobytes())


def expand(b: bytes) -> np.ndarray:
    """The array of ``squeeze``; whole numbers as 64 bits."""
    import zstandard

    dtype = np.dtype("<" + b[:2].decode())
    if "down" not in _coders:
        _coders["down"] = zstandard.ZstdDecompressor()
    raw = _coders["down"].decompress(b[2:]) if len(b) > 2 else b""
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)
    return a if dtype.kind == "f" else a.astype(np.int64)


def _stats(counts: np.ndarray) -> list[int]:
    """Count-of-counts, distinct and total of the counts above 0."""
    seen = counts[counts > 0]
    return [*(int((seen == r).sum()) for r in range(1, K + 2)), len(seen), int(seen.sum())]


class Discounts:
    """Katz's Good-Turing discounts from count-of-counts ``n[1] .. n[K + 1]``."""

    def __init__(self, n: list[int]):
        self.lost = np.zeros(K + 1)  # of a count of r, how much discounting takes
        common = (K + 1) * n[K] / n[0] if n[0] else 1.0
        for r in range(1, K + 1):
            d = 0.0
            if common < 1 and n[r - 1]:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            if not 0 < d < 1:
                d = 1 - 0.5 / r  # the count-of-counts say nothing here
            self.lost[r] = r * (1 - d)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c - np.where(c <= K, self.lost[np.minimum(c, K)], 0.0)

    def totals(self, total: np.ndarray, by_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominator and mass left, from totals and the numbers of items with counts 1 to K."""
        lost = by_count @ self.lost[1:]
        over = np.where(lost > 0, total, total + 1)
        return over, np.where(lost > 0, lost / np.maximum(over, 1), 1 / over)


class Unigrams:
    """Discounted unigram probabilities by count; count 0 is the unknown token."""

    def __init__(self, stats: list[int]):
        self.n, self.v = stats[-1], stats[-2]
        self.d = Discounts(stats)
        over, left = self.d.totals(np.array([self.n]), np.array([stats[:K]], np.float64))
        self.over, self.left = float(over[0]), float(left[0])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d(c) / self.over, self.left)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: ``kind`` T rows (a block's documents and token numbers) and U rows (its words' hashes and counts by bucket)."""
    schema = "kind string, p long, bucket int, doc_ids array<long>, lens array<int>, held array<boolean>, a binary, b binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        lens: list[int] = []
        hashes: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            words, seq = np.unique(np.concatenate(hashes), return_inverse=True)
            train = np.repeat(~np.array(held, bool), lens)
            counts = np.bincount(seq[train], minlength=len(words))
            rows = [("T", p, None, ids, lens, held, squeeze(seq), None)]
            bucket = _bucket(words, buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                rows.append(("U", p, k, None, None, None, words[part].astype("<u8").tobytes(), squeeze(counts[part])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

        for b in batches:
            own_ids, own_held = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, last, offsets, data in blocks(b.column(1)):
                h, at = word_hashes(offsets, data)
                n = np.diff(at)
                hashes.append(np.insert(h, at[1:], END))
                ids += own_ids[first:last]
                held += own_held[first:last]
                lens += (n + 1).tolist()
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
                    ids, held, lens, hashes, size, p = [], [], [], [], 0, p + 1
        if ids:
            yield out()

    return small_batches(docs).mapInArrow(run, schema)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of sorted hashes."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _words(sent: DataFrame, buckets: int) -> DataFrame:
    """Bucket side of step 1: R rows (identifiers and counts for each block) and one S row of count-of-counts a bucket."""
    schema = f"kind string, p long, bucket int, a binary, b binary, {STATS}"
    arrow = arrow_schema(sent.sparkSession, schema)

    def add(group: pa.Table) -> pa.Table:
        ps, k = group.column("p").to_pylist(), group.column("bucket")[0].as_py()
        hashes = [np.frombuffer(x, "<u8") for x in group.column("a").to_pylist()]
        counts = np.concatenate([expand(x) for x in group.column("b").to_pylist()])
        words, inv = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.zeros(len(words), np.int64)
        np.add.at(c, inv, counts)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(words))
        number = np.where(c > 0, 2 + rank * buckets + k, UNKNOWN)
        rows, at = [], 0
        for p, h in zip(ps, hashes):
            own = inv[at : at + len(h)]
            rows.append(("R", p, k, squeeze(number[own]), squeeze(c[own]), *[None] * (K + 3)))
            at += len(h)
        rows.append(("S", None, k, None, None, *_stats(c)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return sent.groupBy("bucket").applyInArrow(add, schema)


class Block:
    """A block's documents and, for each token, what the orders below have answered."""

    def __init__(self, block: pa.Table, words: list[dict], unigrams: Unigrams, buckets: int):
        row = block.to_pylist()[0]
        self.ids, self.lens, self.held = row["doc_ids"], np.array(row["lens"]), np.array(row["held"], bool)
        self.buckets = buckets
        seq = expand(row["a"])
        words = sorted(words, key=lambda r: r["bucket"])
        number, count = (np.concatenate([expand(r[c]) for r in words]) for c in "ab")
        self.word, self.unigram = number[seq], count[seq]
        self.starts = np.cumsum(self.lens) - self.lens
        self.p = unigrams(self.unigram)
        self.documents = int(self.unigram[self.starts[0] + self.lens[0] - 1])  # an end for each training document
        self.lower = self.unigram
        self._contexts(self.word, self.unigram)

    def _contexts(self, number: np.ndarray, count: np.ndarray) -> None:
        """Contexts of the next order, from the identifiers and counts of what ends at each token; the distinct n-grams and their buckets."""
        context, support = np.roll(number, 1), np.roll(count, 1)
        context[self.starts], support[self.starts] = START, self.documents
        self.known = context != UNKNOWN
        self.contexts, firsts, rank = np.unique(context[self.known], return_index=True, return_inverse=True)
        words, place = np.unique(self.word[self.known], return_inverse=True)
        pairs, self.first, self.inverse = np.unique(rank << 32 | place, return_index=True, return_inverse=True)
        self.of_context, self.of_word = pairs >> 32, words[pairs & 0xFFFFFFFF]
        self.shards = 1 + np.minimum(support[self.known][firsts] // SPLIT, self.buckets - 1)
        shard = mix(self.of_word.astype(np.uint64)) % self.shards[self.of_context].astype(np.uint64)
        bucket = ((mix(self.contexts.astype(np.uint64))[self.of_context] % np.uint64(self.buckets) + shard) % np.uint64(self.buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(self.buckets + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each bucket with the positions of its n-grams and those where a context begins."""
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            part = self.order[self.cuts[k] : self.cuts[k + 1]]
            yield k, part, np.flatnonzero(np.diff(self.of_context[part], prepend=-1))

    def answered(self, replies: dict[int, dict], hot: dict[int, tuple], discounts: Discounts) -> None:
        """Evaluate one order; then the contexts are those of the next."""
        n = len(self.of_word)
        c, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        facts = np.zeros((len(self.contexts), K + 2))
        for k, part, begins in self.parts():
            r = replies[k]
            c[part] = expand(r["a"])
            own = self.of_context[part[begins]]
            facts[own, : K + 1] = expand(r["b"]).reshape(K + 1, -1).T
            facts[own, K + 1] = expand(r["m"])
            if r["g"] is not None:
                number[part] = expand(r["g"])
        for i in np.flatnonzero(self.shards > 1).tolist():
            facts[i] = hot[int(self.contexts[i])]
        over, left = discounts.totals(facts[:, 0], facts[:, 1 : K + 1])
        trained = facts[:, 0] > 0
        alpha = np.where(trained, left / np.where(trained, 1 - facts[:, K + 1], 1), 1.0)
        x, at = self.inverse, self.of_context[self.inverse]
        self.p[self.known] = np.where(c[x] > 0, discounts(c[x]) / over[at], alpha[at] * self.p[self.known])
        self.lower = self.p
        of_token, counted = np.full(len(self.word), UNKNOWN), np.zeros(len(self.word), np.int64)
        of_token[self.known], counted[self.known] = number[x], c[x]
        self._contexts(of_token, counted)


def _answered(left: pa.Table, right: list[dict], unigrams: Unigrams, discounts: list[Discounts], buckets: int) -> Block:
    """A block after the orders that ``discounts`` has."""
    b = Block(left, [r for r in right if r["kind"] == "W"], unigrams, buckets)
    for k, d in enumerate(discounts, 2):
        own = [r for r in right if r["level"] == k]
        hot = {r["context"]: r["facts"] for r in own if r["kind"] == "F"}
        b.answered({r["bucket"]: r for r in own if r["kind"] == "R"}, hot, d)
    return b


def _sent(blocks_: DataFrame, answers: DataFrame, unigrams: Unigrams, discounts: list[Discounts], buckets: int) -> DataFrame:
    """A block's distinct n-grams of the next order by bucket; ``split`` flags contexts that other buckets have too."""
    schema = "p long, bucket int, contexts binary, runs binary, words binary, counts binary, lower binary, split binary"
    arrow = arrow_schema(blocks_.sparkSession, schema)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        b, p = _answered(left, right.to_pylist(), unigrams, discounts, buckets), left.column("p")[0].as_py()
        train = np.repeat(~b.held, b.lens)[b.known]
        counts = np.bincount(b.inverse[train], minlength=len(b.of_word))
        lower = b.lower[b.known][b.first]
        rows = []
        for k, part, begins in b.parts():
            own = b.of_context[part[begins]]
            runs = np.diff(np.append(begins, len(part)))
            rows.append((p, k, *map(squeeze, (np.diff(b.contexts[own], prepend=0), runs, b.of_word[part], counts[part], lower[part], b.shards[own] > 1))))
        cols = zip(*rows) if rows else [[]] * len(arrow.types)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, arrow.types)], schema=arrow)

    return blocks_.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(send, schema)


def _ngrams(sent: DataFrame, unigrams: Unigrams, level: int, numbered: bool, buckets: int) -> DataFrame:
    """Bucket side: R rows (answers), B rows (the n-gram table) and one S row of count-of-counts; of contexts that other buckets
    have too, P rows (what this one has) and Q rows (who asks).

    An answer has the counts of the block's n-grams, and for its contexts the total, the numbers
    of followers with counts 1 to K, and their mass at the lower order.
    """
    schema = f"kind string, p long, bucket int, a binary, b binary, m binary, g binary, context long, facts array<double>, {STATS}"
    arrow = arrow_schema(sent.sparkSession, schema)

    def add(group: pa.Table) -> pa.Table:
        k, rows = group.column("bucket")[0].as_py(), group.to_pylist()
        contexts = [np.cumsum(expand(r["contexts"])) for r in rows]
        owner, of = np.unique(np.concatenate(contexts), return_inverse=True)
        words, place = np.unique(np.concatenate([expand(r["words"]) for r in rows]), return_inverse=True)
        each = np.repeat(of, np.concatenate([expand(r["runs"]) for r in rows]))
        table, first, inv = np.unique(each << 32 | place, return_index=True, return_inverse=True)
        del place
        c = np.bincount(inv, np.concatenate([expand(r["counts"]) for r in rows]), len(table)).astype(np.int64)
        seen, at = c > 0, table >> 32
        lower = np.concatenate([expand(r["lower"]) for r in rows])[first]
        per = lambda mask, what: np.bincount(at[mask], weights=what, minlength=len(owner))
        by = [per(seen, c[seen]), *(per(c == r, None) for r in range(1, K + 1))]
        facts = np.column_stack(by).astype(np.int64)
        mass = per(seen, (unigrams(lower) if level == 2 else lower)[seen])
        number = np.where(seen, 2 + np.cumsum(seen) * buckets + k, UNKNOWN) if numbered else None
        out, pos, begin = [], 0, 0
        none = [None] * (K + 3)
        for r, own in zip(rows, contexts):
            n = int(expand(r["runs"]).sum())
            mine, who = inv[pos : pos + n], of[begin : begin + len(own)]
            out.append(("R", r["p"], k, squeeze(c[mine]), squeeze(facts[who].T.reshape(-1)), squeeze(mass[who]), squeeze(number[mine]) if numbered else None, None, None, *none))
            pos, begin = pos + n, begin + len(own)
        split = np.zeros(len(owner), bool)
        flags = [expand(r["split"]) > 0 for r in rows]
        split[of] = np.concatenate(flags)
        out += [("Q", r["p"], k, *[None] * 4, int(c), None, *none) for r, own, f in zip(rows, contexts, flags) for c in own[f]]
        out += [("P", None, k, *[None] * 4, int(owner[i]), [*map(float, facts[i]), float(mass[i])], *none) for i in np.flatnonzero(split).tolist()]
        runs = np.bincount(at[seen], minlength=len(owner))
        out.append(("B", None, k, squeeze(np.diff(owner, prepend=0)), squeeze(c[seen]), squeeze(words[table[seen] & 0xFFFFFFFF]), squeeze(runs), None, None, *none))
        out.append(("S", None, k, *[None] * 6, *_stats(c)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), arrow.types)], schema=arrow)

    return sent.groupBy("bucket").applyInArrow(add, schema)


def _scored(blocks_: DataFrame, answers: DataFrame, unigrams: Unigrams, discounts: list[Discounts], buckets: int) -> DataFrame:
    """Each document's figures."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = arrow_schema(blocks_.sparkSession, schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _answered(left, right.to_pylist(), unigrams, discounts, buckets)
        add = lambda v: np.add.reduceat(v, b.starts)
        base = np.log10((b.unigram + 1) / (unigrams.n + unigrams.v + 1))
        n = len(b.ids)
        cols = [b.ids, b.held.tolist(), b.lens.tolist(), add((b.unigram > 0).astype(np.int64)).tolist(), [unigrams.n] * n, add(base).tolist(), add(np.log10(b.p)).tolist()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types)], schema=arrow)

    return blocks_.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(score, schema)


ANSWER = ["kind", "level", "p", "bucket", "a", "b", "m", "g", "context", "facts"]


def score(docs: DataFrame, held_out: Column, order: int = 2, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that aren't held out and score all: figures of each document."""
    if order < 1:
        raise ValueError("order is 1 at least")
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col).withColumn("held", F.coalesce(held_out, F.lit(False)))
    buckets = buckets or 1 + (docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // BUCKET_BYTES

    def kept(df: DataFrame, what: str):
        path = new_path(spark, what)
        df.write.partitionBy("kind").parquet(path)
        whole = spark.read.schema(df.schema).parquet(path)
        return path, lambda kind: whole.where(F.col("kind") == kind)

    def total(stats: DataFrame) -> list[int]:
        names = [*_R, "distinct", "total"]
        return [int(x or 0) for x in stats.agg(*[F.sum(n) for n in names]).collect()[0]]

    def answers_of(df: DataFrame, kind: str, level: int) -> DataFrame:
        df = df.withColumns({"kind": F.lit(kind), "level": F.lit(level)})
        return df.selectExpr(*[c if c in df.columns else f"CAST(NULL AS {t}) AS {c}" for c, t in zip(ANSWER, "string int bigint int binary binary binary binary bigint array<double>".split())])

    path, first = kept(_blocks(docs, buckets), "katz-blocks")
    texts = first("T").select("p", "doc_ids", "lens", "held", "a")
    _, words = kept(_words(first("U").select("p", "bucket", "a", "b"), buckets), "katz-words")
    unigrams, discounts = Unigrams(total(words("S"))), []
    remove(spark, f"{path}/kind=U")
    answers = answers_of(words("R").select("p", "bucket", "a", "b"), "W", 1)
    for level in range(2, order + 1):
        sent = _sent(texts, answers, unigrams, discounts, buckets)
        _, grams = kept(_ngrams(sent, unigrams, level, level < order, buckets), "katz-ngrams")
        discounts = [*discounts, Discounts(total(grams("S")))]
        summed = [F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(K + 2)]
        hot = grams("P").groupBy("context").agg(*summed).select("context", F.array(*[f"f{i}" for i in range(K + 2)]).alias("facts"))
        asked = grams("Q").select("p", "context").distinct().join(hot, "context")
        answers = answers.unionByName(answers_of(grams("R").select("p", "bucket", "a", "b", "m", "g"), "R", level)).unionByName(answers_of(asked, "F", level))
    return _scored(texts, answers, unigrams, discounts, buckets)


def op8_katz(spark, sf_dir: str) -> DataFrame:
    """All documents' scores; one fold of seven is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)

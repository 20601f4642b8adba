"""Operator 6: the documents linked by a Jaccard similarity of their word shingles.

Signatures are token-combination prefixes. A document of n shingles shares at least
ceil(0.8 n) with any linked one, so it can miss at most p - 1 of its own, p = n//5 + 1.
Shingles are ordered by level, then by hash; level 0 are the rare ones:

* p rare ones: they are the signatures, single shingles;
* else all rare ones are, and the prefix is extended into the levels above, whose shingles
  are dealt by hash into sub-classes; any two shingles of one sub-class inside the prefix are
  a signature. The prefix ends where rare ones plus, over the sub-classes, members less one
  reach p units. A linked document that shared no signature would lack p of these shingles.

A signature carries the unit at which the prefix completes it. Two documents of n and m
shingles need an overlap of a = ceil(4 (n + m) / 9), so the prefixes that end at n - a + 1 and
m - a + 1 units share a signature already (the same proof, for the one that ends first): a
pair meets only in a signature that is early enough for both sizes. Sets of like size that
have a ninth of their own shingles or more, and so can't be linked, don't meet in a passage
that they share, however many they are, as what is frequent comes last.

The number of sub-classes follows from a size class (powers of 4), and a document that may
be linked to one of the next size class gives that class's signatures too. Of two linked
sets below 8 shingles that aren't equal, the larger is the smaller one and one more shingle
(4 to 6 and 5 to 7): the smaller gives its hash, the larger its hash without each shingle, and
equal hashes are pairs to verify, at most 7 a set, however many sets share a shingle.

Levels come from counts of all documents' shingles in SKETCH counters of fixed size: 0 up to
well above the mean, then one more for each doubling. Collisions only raise a level; the
order is the same for all documents, so results don't depend on it. As data grows, what
the counters tell apart is what stands out from their load; lists are streamed in chunks of
CHUNK members, so none is gathered whatever its length.

Equal sets are one class (size and a 96-bit hash), which each task emits once. Lists with the
same members are one list, with a weight. In each list the document that meets most others is
the hub, and each document is verified against the hub with which it shares most. Then what is
left in a list outside its largest component meets the list's documents of other components,
by early enough signatures alone: in the smaller set they are within its first ninth, so rows
behind that are joined only with such early ones, and only with sets of like size. These pairs
are verified. Verification compares the sets of whole texts: hubs are salted, and
members stream past their hub. A list of more than CHUNK members is dealt to several tasks wherever
its members are joined: each member to one part, what belongs to the list to all parts.

Defined results: null and empty texts and texts without words have 0 shingles and are their
own component; fewer words than five are one shingle; repeated rows are reported each; rows
of one identifier count as linked; a null identifier has component null; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, drop, map_rows, returning, small_batches, texts_of, written
from .components import components
from .words import blocks, mix, shingle_sets

#: Counters of the sketch, and of one block that travels.
SKETCH, SKETCH_BLOCK = 1 << 24, 1 << 14
#: A counter up to the mean, four deviations and this many is of level 0; the highest level.
LEAST, TOP = 8, 15
#: Sets that a task remembers as emitted, members of a list in one row or part, members that share one copy of their hub, routes or long lists that are broadcast.
SEEN, CHUNK, MEMBERS, ROUTES = 200_000, 1024, 256, 1_000_000
#: Kinds of signatures that are emitted.
SINGLE, COMBINED, WHOLE, LESS_ONE = range(4)
_U = np.uint64


def class_of(own: np.ndarray) -> bytes:
    """Size (big-endian) and hash of a set: equal for equal sets alone."""
    return len(own).to_bytes(4, "big") + hashlib.blake2b(own.tobytes(), digest_size=12).digest()


def _size_class(n: int) -> int:
    k = 0
    while n >= 8 * 4**k:
        k += 1
    return k


Signed = tuple[np.ndarray, np.ndarray]


def signatures(own: np.ndarray, level: np.ndarray) -> tuple[Signed, Signed, np.ndarray]:
    """A set's single and combined signatures with their units, and its short ones; ``level`` has a level for each counter of the sketch.

    Short ones, of sets below 8 shingles, are the whole set's hash and those of the set without each shingle.
    """
    n = len(own)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if not n:
        return none, none, none[0]
    p = n // 5 + 1
    kinds = {_size_class(n), _size_class(n * 5 // 4)}
    single, combined, short = none, [none], none[0]
    if 0 in kinds:
        mixed = mix(own ^ _U(0x5851F42D4C957F2D))
        whole = mixed.sum(keepdims=True)
        short = np.concatenate([mix(whole + _U(n)), mix(whole - mixed + _U(n - 1))])
    if kinds - {0}:
        of = level[(own & _U(SKETCH - 1)).astype(np.int64)]
        rare = own[of == 0][:p]
        single = rare, np.arange(1, len(rare) + 1, dtype=np.int32)
        if len(rare) < p:
            above = np.flatnonzero(of)
            common = own[above[np.argsort(of[above], kind="stable")]]
            combined += [_combinations(common, len(rare), p - len(rare), kind) for kind in sorted(kinds - {0})]
    return single, tuple(map(np.concatenate, zip(*combined))), short


def _combinations(common: np.ndarray, before: int, need: int, kind: int) -> Signed:
    group = (common >> _U(24)) % _U(max(1, 2 * 4 ** (kind - 1)))
    _, firsts = np.unique(group, return_index=True)
    again = np.ones(len(common), bool)
    again[firsts] = False
    reach = np.cumsum(again)
    if not len(reach) or reach[-1] < need:
        raise AssertionError("a prefix can't be extended far enough")
    end = int(np.searchsorted(reach, need)) + 1
    order = np.argsort(group[:end], kind="stable")
    g, t, unit = group[:end][order], common[:end][order], (before + reach[:end][order]).astype(np.int32)
    out, units, d = [], [], 1
    while True:
        same = g[d:] == g[:-d]
        if not same.any():
            break
        out.append(mix(mix(t[:-d][same] + _U(kind)) ^ (t[d:][same] * _U(0x9FB21C651E98DF25))))
        units.append(unit[d:][same])
        d += 1
    return np.concatenate(out), np.concatenate(units)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for b in batches:
        ids = b.column(0).to_pylist()
        for first, last, offsets, data in blocks(b.column(1)):
            yield from zip(ids[first:last], shingle_sets(offsets, data))


def _profile(docs: DataFrame) -> DataFrame:
    """Each document's class and size, and each task's counters, in one pass."""
    schema = "doc_id long, cls binary, n_shingles long, block int, counts binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(SKETCH, np.uint16), [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(held) & _U(SKETCH - 1), return_counts=True)
            at = at.astype(np.int64)
            counts[at] = np.minimum(counts[at] + n, 65535)

        for b in batches:
            out = []
            for doc_id, own in _sets([b]):
                out.append((doc_id, class_of(own), len(own), None, None))
                held.append(own)
                size += len(own)
                if size > 1 << 18:
                    add()
                    held, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
        if held:
            add()
        parts = counts.reshape(-1, SKETCH_BLOCK)
        for first in range(0, len(parts), 64):
            rows = [(None, None, None, k, zlib.compress(parts[k].astype("<u2").tobytes(), 1)) for k in range(first, min(first + 64, len(parts))) if parts[k].any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return small_batches(docs).mapInArrow(lambda batches: returning(run(batches)), schema)


def _levels(profile: DataFrame) -> np.ndarray:
    """The level of each counter: SKETCH small numbers, whatever the input's size."""
    mean = (profile.agg(F.sum("n_shingles")).collect()[0][0] or 0) / SKETCH
    limit = mean + 4 * mean**0.5 + LEAST

    def leveled(total: np.ndarray) -> bytes:
        own = np.where(total > limit, np.clip(np.ceil(np.log2(np.maximum(total, 1) / limit)), 1, TOP), 0)
        return zlib.compress(own.astype(np.uint8).tobytes(), 1)

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, total = None, None
        for block, counts in rows:
            own = np.frombuffer(zlib.decompress(counts), "<u2").astype(np.int64)
            if block != at and total is not None:
                yield at, leveled(total)
                total = None
            total, at = own if total is None else total + own, block
        if total is not None:
            yield at, leveled(total)

    parts = profile.where("block IS NOT NULL").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint8)
    for block, own in map_rows(parts, "block int, own binary", add).collect():
        out[block] = np.frombuffer(zlib.decompress(own), np.uint8)
    return out.reshape(-1)


def _emitted(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """``key, cls, kind, unit`` of all signatures; a task emits a class once. Kinds are the constants above."""
    schema = "key long, cls binary, kind int, unit int"
    arrow = arrow_schema(docs.sparkSession, schema)
    packed = zlib.compress(level.tobytes())

    def batch(held: list[tuple[np.ndarray, np.ndarray, bytes, int]]) -> pa.RecordBatch:
        keys, units = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        sizes = [len(h[0]) for h in held]
        cls = np.repeat(np.array([np.frombuffer(h[2], np.uint8) for h in held]), sizes, 0)
        kinds = np.repeat(np.array([h[3] for h in held], np.int32), sizes)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), _binary(cls), pa.array(kinds), pa.array(units)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_level = np.frombuffer(zlib.decompress(packed, bufsize=SKETCH), np.uint8)
        seen: set[bytes] = set()
        held, size = [], 0
        for _, own in _sets(batches):
            cls = class_of(own)
            if not len(own) or cls in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(cls)
            single, combined, short = signatures(own, own_level)
            n, zeros = len(own), np.zeros(len(short), np.int32)
            whole, less_one = slice(0, int(4 <= n < 7)), slice(1, None if n > 4 else 1)
            for keys, units, kind in ((*single, SINGLE), (*combined, COMBINED), (short[whole], zeros[whole], WHOLE), (short[less_one], zeros[less_one], LESS_ONE)):
                if len(keys):
                    held.append((keys, units, cls, kind))
                    size += len(keys)
            if size >= 50_000:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return small_batches(docs).mapInArrow(lambda batches: returning(run(batches)), schema)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as one binary column."""
    ends = np.arange(0, 16 * len(rows) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _lists(singles: DataFrame) -> DataFrame:
    """``list, cls, unit, weight`` of rare signatures that at least two classes have: equal lists once, with how many they are.

    Of lists with the same members the one that comes first in the order has the smallest units
    of all members. Lists of more than CHUNK members are passed on in chunks, each list by itself.
    """
    schema = "list binary, chunk long, members array<binary>, units array<int>, weight long"
    arrow = arrow_schema(singles.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cls, units = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int32)
        cut = 0  # chunks of the first list held that have been passed on

        def part(a: int, b: int, chunk: int) -> tuple:
            return b"L" + keys[a].tobytes(), chunk, [x.tobytes() for x in cls[a:b]], units[a:b].tolist(), 1

        for b in chain(batches, [None]):
            if b is not None:
                raw = b.column(1)
                ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
                raw = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                keys = np.concatenate([keys, b.column(0).to_numpy()])
                cls = np.concatenate([cls, raw.view(np.uint64).reshape(-1, 2)])
                units = np.concatenate([units, b.column(2).to_numpy()])
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]).any(1)
                keys, cls, units = keys[fresh], cls[fresh], units[fresh]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(keys))
            whole = len(starts) - (b is not None and len(starts) > 0)  # the last list may go on
            long = ends[: len(starts)] - starts > CHUNK
            long[:1] |= cut > 0
            out: list[tuple] = []
            for k in np.flatnonzero(long[:whole]).tolist():
                out += [part(x, min(x + CHUNK, int(ends[k])), i) for i, x in enumerate(range(int(starts[k]), int(ends[k]), CHUNK), 0 if k else cut)]
            spans: dict[bytes, list] = {}
            for k in np.flatnonzero(~long[:whole] & (ends[:whole] - starts[:whole] >= 2)).tolist():
                x, y = int(starts[k]), int(ends[k])
                own = spans.setdefault(hashlib.blake2b(cls[x:y].tobytes(), digest_size=16).digest(), [x, y, units[x:y].tolist(), 0])
                own[2:] = min(own[2], units[x:y].tolist()), own[3] + 1
            out += [(name, 0, [m.tobytes() for m in cls[x:y]], u, n) for name, (x, y, u, n) in spans.items()]
            cut = 0 if whole else cut
            tail = int(starts[whole]) if whole < len(starts) else len(keys)
            while len(keys) - tail > CHUNK:
                out.append(part(tail, tail + CHUNK, cut))
                tail, cut = tail + CHUNK, cut + 1
            keys, cls, units = keys[tail:], cls[tail:], units[tail:]
            for x in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[x : x + 1000]), arrow.types)], schema=arrow)

    ordered = singles.select("key", "cls", "unit").repartition("key").sortWithinPartitions("key", "cls")
    lists = ordered.mapInArrow(lambda batches: returning(run(batches)), schema).groupBy("list", "chunk").agg(F.first("members").alias("members"), F.min("units").alias("units"), F.sum("weight").alias("weight"))
    return lists.select("list", F.explode(F.arrays_zip("members", "units")).alias("x"), "weight").select("list", F.col("x.members").alias("cls"), F.col("x.units").alias("unit"), "weight")


def _possible(n: str, m: str, weight: str) -> str:
    """SQL: whether sets of ``n`` and ``m`` shingles that share so many signatures can be linked.

    Take the set whose prefix ends first. Each of its shingles that the other lacks costs one
    of the p units that its prefix has (a rare shingle, or one member of a sub-class beyond the
    first); what remains is shared, and k shared members of a sub-class are at least k - 1
    shared signatures. So signatures and shingles behind the prefix reach the needed overlap.
    """
    behind = f"greatest({n} - {n} div 5, {m} - {m} div 5) - 1"
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) AND 9 * ({weight} + {behind}) >= 4 * ({n} + {m})"


def verified(docs: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """Those of ``pairs`` (``hub``, ``id``) whose whole texts' sets are similar enough, as ``a, b``, written."""
    spark = docs.sparkSession
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int"))
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(sizes, "hub").select(F.col("id").alias("doc_id"), "hub", (F.col("salt") % F.col("parts")).alias("salt"), F.lit(1).alias("side"))
    hubs = sizes.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("side"))
    routes = written(members.unionByName(hubs), "routes")
    small = routes.count() <= ROUTES
    sent = docs.join(F.broadcast(routes) if small else routes, "doc_id").select("doc_id", "text", "hub", "salt", "side")
    sent = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    schema = "a long, b long"
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for b in batches:
            out = []
            keys = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            for (hub, salt, side), (doc_id, found) in zip(keys, _sets([b])):
                if (hub, salt) != group:
                    group, own = (hub, salt), []
                if side == 0:
                    own.append(found)  # more than one only where rows repeat an identifier
                elif any(100 * (k := len(np.intersect1d(x, found, True))) >= percent * (len(x) + len(found) - k) for x in own):
                    out.append((hub, doc_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    links = written(small_batches(sent).mapInArrow(lambda batches: returning(run(batches)), schema), "links")
    drop(routes)
    return links


class Parts:
    """The parts, of about CHUNK members, that long lists are dealt to as ``salt``; others have part 0 alone.

    Long lists are at most one in CHUNK rows; up to ROUTES of them are broadcast, beyond they are joined.
    """

    def __init__(self, lists: DataFrame):
        parts = F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")
        self.long = written(lists.groupBy("list").agg(parts).where("parts > 1"), "long")
        self.small = self.long.count() <= ROUTES

    def _joined(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.long) if self.small else self.long, "list", "left")

    def one(self, members: DataFrame) -> DataFrame:
        """Each member (``list``, ``id``) in one part."""
        return self._joined(members).withColumn("salt", F.expr("CAST(pmod(xxhash64(id), coalesce(parts, 1)) AS INT)")).drop("parts")

    def all(self, rows: DataFrame) -> DataFrame:
        """Each row in all parts of its ``list``."""
        return self._joined(rows).withColumn("salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")


def sides(members: DataFrame, parts: Parts) -> list[tuple[DataFrame, DataFrame]]:
    """Who meets whom of ``list, salt, id, n, unit, component, largest``: by ``list, salt, band``, smaller sets and larger ones.

    Of two sets that can be linked the smaller one, of n shingles, has its early units among
    the first n - ceil(8 n / 9) + 1, so a row behind those meets nothing as the smaller: late rows
    never meet late rows. Bands are powers of 5/4 of the size, and the larger set is in the bands
    of its own size and of four fifths of it. Who is outside the list's largest component meets the
    rest, those inside don't meet each other; it goes to all parts of the list, the rest to one.
    """
    band = lambda n: F.log(n) / F.log(F.lit(1.25))
    small = members.where("unit <= n - ((8 * n + 8) div 9 - 1)").withColumn("band", F.floor(band(F.col("n"))))
    large = members.withColumn("band", F.explode(F.sequence(F.floor(band(0.8 * F.col("n")) - 1e-9), F.floor(band(F.col("n")) + 1e-9))))
    outside = F.col("component") != F.col("largest")
    spread = lambda df: parts.all(df.where(outside).drop("salt"))
    return [(spread(small), large), (small.where(~outside), spread(large))]


def meetings(lists: DataFrame, label: DataFrame, parts: Parts | None = None) -> DataFrame:
    """Pairs ``hub, id`` of a list's members (``list, id, n, unit``) that ``label`` (``id, component``) has in different components, written.

    They meet only in signatures that are early enough for both, see ``sides``.
    """
    known = lists.join(label, "id", "left").select("list", "id", "n", "unit", F.coalesce("component", "id").alias("component"))
    shares = known.groupBy("list", "component").agg(F.count("*").alias("k"))
    largest = shares.groupBy("list").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("several"))
    parts = parts or Parts(lists)
    rest = written(parts.one(known).join(parts.all(largest.where("several > 1").drop("several")), ["list", "salt"]), "open")
    need = "(4 * (s.n + l.n) + 8) div 9 - 1"
    fits = f"""s.list = l.list AND s.salt = l.salt AND s.band = l.band AND s.component <> l.component
        AND 5 * s.n >= 4 * l.n AND s.unit <= s.n - ({need}) AND l.unit <= l.n - ({need}) AND """
    # sets of one size meet once, from the one that is outside, or has the smaller identifier if both are
    once = ["(s.n < l.n OR s.n = l.n AND (l.component = l.largest OR s.id < l.id))", "s.n < l.n"]
    found = [x.alias("s").join(y.alias("l"), F.expr(fits + c)) for (x, y), c in zip(sides(rest, parts), once)]
    pairs = [df.select(F.least("s.id", "l.id").alias("hub"), F.greatest("s.id", "l.id").alias("id")) for df in found]
    out = written(pairs[0].unionByName(pairs[1]).distinct(), "met")
    drop(rest)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs = texts_of(docs, id_col, text_col)
    profile = written(_profile(docs), "profile")
    own = profile.where("block IS NULL").select("doc_id", "cls", "n_shingles")
    nodes = own.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
    emitted = written(_emitted(docs.where("doc_id IS NOT NULL"), _levels(profile)), "signatures")
    combined = emitted.where(F.col("kind") == COMBINED).groupBy("key", "cls").agg(F.min("unit").alias("unit"))
    combined = combined.select(F.col("key").cast("string").cast("binary").alias("list"), "cls", "unit", F.lit(1).cast("long").alias("weight"))
    lists = _lists(emitted.where(F.col("kind") == SINGLE)).unionByName(combined)
    lists = written(lists.join(nodes, "cls").select("list", "id", "n", "unit", "weight"), "lists")

    # the document that meets most others is the likeliest middle of a group
    parts = Parts(lists)
    sizes = parts.all(lists.groupBy("list").agg(F.count("*").alias("m")))
    met_by = parts.one(lists).join(sizes, ["list", "salt"]).groupBy("id").agg(F.sum(F.expr("(m - 1) * weight")).alias("met"))
    plain, lists = lists, written(lists.join(met_by, "id"), "lists")
    drop(plain)

    middle = F.max_by(F.struct("id", "n"), F.struct("met", -F.col("id"))).alias("hub")
    hubs = parts.all(lists.groupBy("list").agg(middle))
    stars = parts.one(lists).join(hubs, ["list", "salt"]).where("id <> hub.id").groupBy("id", "n", "hub").agg(F.sum("weight").alias("weight"))
    stars = stars.where(_possible("n", "hub.n", "weight")).select("id", F.col("hub.id").alias("hub"), "weight")
    first = written(stars.groupBy("id").agg(F.max_by("hub", F.struct("weight", -F.col("hub"))).alias("hub")), "stars")
    of_kind = lambda kind, name: emitted.where(F.col("kind") == kind).join(nodes, "cls").select("key", F.col("id").alias(name))
    short = of_kind(WHOLE, "hub").join(of_kind(LESS_ONE, "id"), "key").select("id", "hub").distinct()
    links = verified(docs, first.unionByName(short).distinct())
    label = written(components(links), "labels")
    drop(emitted)

    met = meetings(lists, label, parts)
    tried = first.select(F.least("hub", "id").alias("hub"), F.greatest("hub", "id").alias("id"))
    pairs = written(met.join(tried, ["hub", "id"], "left_anti"), "pairs")
    more = verified(docs, pairs)
    drop(lists, parts.long, first, label, met, pairs)

    # rows that repeat an identifier with another set are linked by it
    by_id = own.where("n_shingles > 0").join(nodes, "cls").select(F.col("doc_id").alias("i"), F.col("id").alias("b"))
    several = by_id.groupBy("i").agg(F.min("b").alias("a"), F.max("b").alias("c")).where("a < c").select("i", "a")
    by_id = by_id.join(several, "i").where("a < b").select("a", "b").distinct()
    label = components(links.unionByName(more).unionByName(by_id))
    drop(links, more)
    final = nodes.select("cls", "id").join(label, "id", "left").select("cls", F.coalesce("component", "id").alias("component_id"))
    linked = own.where("n_shingles > 0").join(final, "cls", "left").select("doc_id", "n_shingles", "component_id")
    empty = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))  # all of one class, which links nothing
    return linked.unionByName(empty).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Operator 12: a Merkle manifest of a dataset, its upper proofs gained by a butterfly exchange.

Rows are leaves. Inside each group (a source) they stand in order of their key; every
``fanout`` consecutive nodes hash to one, a last run of fewer, even of one, too, until one is
left: the group's root. The groups' roots, in order of the groups, are the leaves of one more
such tree, whose root stands for the dataset.

Leaves get their places by a range partitioning: one row count a partition and group, summed
up, gives what stands before. ``fanout ** height`` leaves of a group are a block, aligned with
the tree, which one task raises alone. Then blocks swap their subtree roots: in round ``r``
those whose numbers differ in the ``r``-th digit (to the base ``fanout``) alone meet in one
group of at most ``fanout`` rows, and each hashes the parent for itself. So after each round
every block knows its next ancestor and the siblings on the way, and none has to be told from
above. Behind a last subtree with fewer blocks, these blocks serve the missing ones' partners
as well. Rows that travel in a round are at most ``fanout`` times the blocks, and no group grows.

Defined results: a null column's mark is ``-``; a null group or key comes first; rows with equal
group and key are ordered by leaf, so that equal rows are interchangeable; a row without key is
never tampered with; a lone leaf is its group's root, a lone group's root the dataset's; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, placed, written

#: Rounds between two written tables of blocks.
CUT = 6


def field(c: str | Column) -> Column:
    """A value as a leaf has it: its length in UTF-8 bytes, a colon and itself; ``-`` for null."""
    text = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    """The hash of a row's columns."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def raised(leaves: list[str], fanout: int, levels: int | None = None) -> list[list[str]]:
    """The levels of a tree from its leaves up: as many as asked, or until one node is left."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([_hash("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return out


def path(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf's ancestors in their runs, from the leaf up."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(own: str, siblings: list[tuple[str, str]]) -> str:
    """The root above a leaf, from its siblings."""
    for left, right in siblings:
        own = _hash(left + own + right)
    return own


def _blocks(leaves: DataFrame, carried: str | None, fanout: int, height: int) -> DataFrame:
    """One row a block of ``fanout ** height`` leaves, written: its leaves in order and its subtree's root."""
    size = fanout**height
    kept = ["pos", "key", "leaf", *([carried] if carried else [])]
    rows = placed(leaves, "grp", ["key", "leaf"]).groupBy("grp", "n", F.expr(f"pos div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("rows"))
    arrays = rows.select("grp", "n", "block", *[F.col(f"rows.{c}").alias(c) for c in kept[1:]])
    kinds = dict(arrays.dtypes)

    def raise_each(batch: Iterator[tuple]) -> Iterator[tuple]:
        for grp, n, block, keys, leaves, *more in batch:
            yield grp, n, block, keys, leaves, *more, raised(leaves, fanout, None if n <= size else height)[-1][0]

    schema = ", ".join(f"{c} {kinds[c]}" for c in arrays.columns) + ", root string"
    return written(map_rows(arrays, schema, raise_each), "blocks")


def butterfly(blocks: DataFrame, fanout: int = 3) -> DataFrame:
    """``grp, block, subroot, above`` from ``grp, block, n_blocks, root``: the group's root and each block's siblings, left and right, level by level."""
    now = blocks.select("grp", "block", "n_blocks", F.col("root").alias("cur"), F.array().cast("array<struct<l:string,r:string>>").alias("above"))
    most = blocks.agg(F.max("n_blocks")).collect()[0][0] or 0
    width, rounds = 1, 0
    while width < most:
        sent = now.selectExpr(
            "*", f"block div {width} % {fanout} AS digit", f"block % {width} AS lane", f"block div {width * fanout} AS meeting",
            f"least({width}, n_blocks - block div {width} * {width}) AS there",
        )
        # the blocks of a last, smaller subtree stand in for those that it lacks
        lanes = F.expr(f"CASE WHEN there < {width} AND digit > 0 THEN sequence(lane, {width - 1}L, there) ELSE array(lane) END")
        sent = sent.select("*", F.explode(lanes).alias("to"))
        own = F.col("to") == F.col("lane")
        member = F.struct("digit", own.alias("own"), "block", "n_blocks", "cur", F.when(own, F.col("above")).alias("above"))
        met = sent.groupBy("grp", "meeting", "to").agg(F.array_sort(F.collect_list(member)).alias("met"))
        joined = lambda keep: f"array_join(transform(filter(met, y -> {keep}), y -> y.cur), '')"
        grown = f"""transform(filter(met, x -> x.own), x -> struct(x.block AS block, x.n_blocks AS n_blocks,
            CASE WHEN x.n_blocks > {width} THEN sha2({joined("true")}, 256) ELSE x.cur END AS cur,
            CASE WHEN x.n_blocks > {width} THEN concat(x.above, array(struct({joined("y.digit < x.digit")} AS l, {joined("y.digit > x.digit")} AS r))) ELSE x.above END AS above))"""
        now = met.select("grp", F.expr(f"inline({grown})"))
        width, rounds = width * fanout, rounds + 1
        if rounds % CUT == 0:
            now = written(now, "swapped")
    return written(now.select("grp", "block", F.col("cur").alias("subroot"), "above"), "upper")


def tree(leaves: DataFrame, carried: str | None = None, fanout: int = 3, height: int = 7) -> tuple[DataFrame, DataFrame]:
    """Blocks with what stands above them, and ``grp, subroot`` of each group, from ``grp, key, leaf`` and a ``carried`` column."""
    if fanout < 2 or height < 1:
        raise ValueError("a tree needs a fanout of at least 2 and blocks of at least one level")
    blocks = _blocks(leaves, carried, fanout, height)
    ends = blocks.select("grp", "block", F.expr(f"(n - 1) div {fanout**height} + 1").alias("n_blocks"), "root")
    upper = butterfly(ends, fanout)
    subroots = upper.where("block = 0").select("grp", "subroot")
    up = upper.withColumnsRenamed({"grp": "up_grp", "block": "up_block"})
    whole = blocks.join(up, F.col("block").eqNullSafe(F.col("up_block")) & F.col("grp").eqNullSafe(F.col("up_grp")))
    return whole.drop("up_grp", "up_block", "root"), subroots


def _with_paths(whole: DataFrame, key_kind: str, fanout: int, height: int) -> DataFrame:
    """``key, root, above`` of each leaf, from blocks: all levels' siblings."""

    def each(batch: Iterator[tuple]) -> Iterator[tuple]:
        for n, keys, leaves, subroot, above in batch:
            levels = raised(leaves, fanout, None if n <= fanout**height else height)
            up = [(x["l"], x["r"]) for x in above]
            for i, key in enumerate(keys):
                yield key, subroot, [{"l": a, "r": b} for a, b in path(levels, i, fanout) + up]

    return map_rows(whole.select("n", "key", "leaf", "subroot", "above"), f"key {key_kind}, root string, above array<struct<l:string,r:string>>", each)


def dataset_manifest(rows: DataFrame, fanout: int = 3, height: int = 7, with_proof: bool = False) -> DataFrame:
    """Each leaf's proof, and the root refolded from what the row is now.

    ``rows`` has ``grp`` (string), ``key``, ``leaf`` and ``now``: the leaf hashed again, as at a later
    check. Gives ``grp, key, leaf, subroot, root, proof_sha256, folded_root, verified`` and, with
    ``with_proof``, ``proof``: from the leaf up, what stands left and right in each run.
    """
    rows = rows.select("grp", "key", "leaf", "now")
    kind = dict(rows.dtypes)["key"]
    whole, subroots = tree(rows, "now", fanout, height)
    top, _ = tree(subroots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf")), None, fanout, height)
    top = _with_paths(top, "string", fanout, height).withColumnsRenamed({"key": "top_key", "above": "top_above"})
    whole = whole.join(top, F.col("grp").eqNullSafe(F.col("top_key")))

    def each(batch: Iterator[tuple]) -> Iterator[tuple]:
        for grp, n, keys, leaves, nows, subroot, root, above in batch:
            levels = raised(leaves, fanout, None if n <= fanout**height else height)
            up = [(x["l"], x["r"]) for x in above]
            for i, (key, own, now) in enumerate(zip(keys, leaves, nows)):
                proof = path(levels, i, fanout) + up
                folded = fold(now, proof)
                row = grp, key, own, subroot, root, _hash("".join(a + b for a, b in proof)), folded, folded == root
                yield (*row, [{"l": a, "r": b} for a, b in proof]) if with_proof else row

    schema = f"grp string, key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof array<struct<l:string,r:string>>" if with_proof else ""
    blocks = whole.select("grp", "n", "key", "leaf", "now", "subroot", "root", F.concat("above", "top_above").alias("above"))
    return map_rows(blocks, schema, each)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents_manifest(docs: DataFrame, fanout: int = 3, height: int = 7) -> DataFrame:
    """``docs`` under the manifest, one row a document; where 2 divides the identifier's crc32 its text has lost its line feeds."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = leaf("doc_id", "source", "lang", "n_chars", F.translate("text", "\n", ""))
    whole = leaf(*FIELDS)
    now = F.when(hit & F.col("text").contains("\n"), tampered)
    rows = docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").alias("key"), whole.alias("leaf"), now.alias("now"))
    return dataset_manifest(rows.withColumn("now", F.coalesce("now", "leaf")), fanout, height).withColumnRenamed("key", "doc_id").drop("grp")


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents' proofs, and which of them still verify."""
    return documents_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_FIELD = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
_NUMBER = "coalesce(CAST(length(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    parts = [_NUMBER.format("doc_id"), _FIELD.format("source"), _FIELD.format("lang"), _NUMBER.format("n_chars"), _FIELD.format(text)]
    return f"sha256({' || '.join(parts)})"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda k: CAST((ascii(ch) >> k) & 1 AS BIGINT))))"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


#: Both trees by recursion; a row's way up is a join with the siblings of its ancestors.
OP12_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS now
  FROM documents
), placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base
), low(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, any_value(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY source, pos // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM low WHERE n = 1
), high(lvl, pos, h, n) AS (
  SELECT 0, place, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY pos // 3
), beside AS (
  SELECT source, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
    || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS lr
  FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos)
), above AS (
  SELECT lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
    || coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS lr
  FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)
), ways AS (
  SELECT id, lvl AS k, lr FROM placed p JOIN beside b ON p.source IS NOT DISTINCT FROM b.source AND b.pos = p.pos // CAST(3 ** b.lvl AS BIGINT)
  UNION ALL
  SELECT id, 1000 + lvl, lr FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN above a ON a.pos = s.place // CAST(3 ** a.lvl AS BIGINT)
), way AS (
  SELECT id, list(lr ORDER BY k) AS lrs FROM ways GROUP BY id
), folded AS (
  SELECT p.*, subroot, root, sha256(coalesce(replace(array_to_string(lrs, ''), '|', ''), '')) AS proof_sha256,
    list_reduce(list_prepend(now, coalesce(lrs, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT h AS root FROM high WHERE n = 1) LEFT JOIN way USING (id)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

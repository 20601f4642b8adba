"""Manifests, artifacts and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip


def manifest_scan(lines: DataFrame) -> DataFrame:
    """``digest, rel, malformed`` of each line that isn't blank; a line without two fields is malformed."""
    v = strip(F.col("value"))
    pattern = r"^(\S+)\s+(.+)$"
    part = lambda i: F.nullif(F.regexp_extract(v, pattern, i), F.lit(""))
    return lines.where(v != "").select(F.lower(part(1)).alias("digest"), strip(part(2)).alias("rel"), (~v.rlike(pattern)).alias("malformed"))


def content_digests(artifacts: DataFrame) -> DataFrame:
    """``path, length, digest`` of a table of ``path`` and ``content``; files are hashed by ``sources.digests`` without one."""
    content = F.col("content").cast("binary")
    return artifacts.select("path", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("digest"))


def integrity_verify(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """``rel, status`` of each well-formed manifest row: OK, FAIL or MISSING, from ``path, digest`` of what there is."""
    sums = digests.select(F.col("path").alias("rel"), F.col("digest").alias("found"))
    rows = manifest.where("NOT malformed").join(sums, "rel", "left")
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("digest"), "OK").otherwise("FAIL")
    return rows.select("rel", status.alias("status"))


def integrity_summary(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Counts by status and whether all is well: no malformed line and only OK rows; an empty manifest passes."""
    bad = manifest.where("malformed").agg(F.count("*").alias("n")).select(F.lit("MALFORMED").alias("status"), "n")
    by = integrity_verify(manifest, digests).groupBy("status").agg(F.count("*").alias("n")).unionByName(bad)
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"n_{s.lower()}")
    out = by.agg(*map(n, ("OK", "FAIL", "MISSING", "MALFORMED")))
    return out.withColumn("passed", F.expr("n_fail + n_missing + n_malformed = 0"))


def bundle_discover(listing: DataFrame) -> DataFrame:
    """``start, root, status`` for each start of a listing (``start, path``): itself, its one child, or its one grandchild."""
    parts = F.split("path", "/")
    depths = listing.select("start", parts.alias("p"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("depth")).where("size(p) > depth + 1")
    at = depths.select(
        "start", "depth", F.expr("array_join(slice(p, 1, depth), '/')").alias("root"),
        F.expr("p[depth] = 'model'").alias("m"), F.expr("array_join(slice(p, depth + 1, size(p)), '/')").eqNullSafe(rules.TOKENIZER_PATH).alias("t"),
    )
    roots = at.groupBy("start", "depth", "root").agg(F.bool_or("m").alias("m"), F.bool_or("t").alias("t"))
    found = roots.groupBy("start").agg(
        *[F.count(F.when(F.expr(f"m AND t AND depth = {d}"), 1)).alias(f"n{d}") for d in range(3)],
        *[F.min(F.when(F.expr(f"m AND t AND depth = {d}"), F.col("root"))).alias(f"r{d}") for d in range(3)],
    )
    status = F.expr("CASE WHEN n0 > 0 THEN 'self' WHEN n1 = 1 THEN 'child' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'grandchild' ELSE 'not_found' END")
    every = listing.select("start").distinct().join(found, "start", "left")
    root = F.expr("CASE status WHEN 'self' THEN r0 WHEN 'child' THEN r1 WHEN 'grandchild' THEN r2 END")
    return every.fillna(0, ["n0", "n1", "n2"]).withColumn("status", status).select("start", root.alias("root"), "status")


def declared_paths(manifests: DataFrame) -> DataFrame:
    """``bundle, declared_path`` from ``bundle, manifest``: the checkpoint that a manifest names; one that isn't JSON names none."""
    named = F.try_variant_get(F.try_parse_json("manifest"), "$.production_checkpoint_archive_path", "string")
    return manifests.select("bundle", F.nullif(named, F.lit("")).alias("declared_path"))


def checkpoint_select(files: DataFrame, preferred: list[str] = rules.PREFERRED_MODELS) -> DataFrame:
    """``bundle, path, how`` from ``bundle, path, override_path, declared_path``: override, declared, preferred, the only model file.

    ``preferred`` has no release's own file name; put it first where there is one.
    """
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col("path"))
    model = F.when(F.col("path").rlike(r"^model/[^/]+\.pt$"), F.col("path"))
    found = files.groupBy("bundle").agg(
        F.max("override_path").alias("o"), F.bool_or(F.expr("path = override_path")).alias("o_there"),
        F.max("declared_path").alias("d"), F.bool_or(F.expr("path = declared_path")).alias("d_there"),
        F.min_by("path", F.when(rank > 0, rank)).alias("p"), F.count_distinct(model).alias("n"), F.min(model).alias("only"),
    )
    how = F.expr(
        "CASE WHEN o IS NOT NULL THEN CASE WHEN o_there THEN 'override' ELSE 'override_missing' END WHEN d_there THEN 'declared' "
        "WHEN p IS NOT NULL THEN 'preferred' WHEN n = 1 THEN 'only' ELSE 'ambiguous' END"
    )
    path = F.expr("CASE how WHEN 'override' THEN o WHEN 'declared' THEN d WHEN 'preferred' THEN p WHEN 'only' THEN only END")
    return found.withColumn("how", how).select("bundle", path.alias("path"), "how")


def tokenizer_select(files: DataFrame) -> DataFrame:
    """``bundle, path``: the tokenizer at its one preferred place, or null."""
    return files.groupBy("bundle").agg(F.max(F.when(F.col("path") == rules.TOKENIZER_PATH, F.col("path"))).alias("path"))


def marker_check(required: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Required tokens that a vocabulary lacks."""
    return required.join(vocabulary, "token", "left_anti")

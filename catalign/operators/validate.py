"""Constraint checks; each returns a table of violations, empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P
from .lookup import resolve_mapping, unique_owner
from .summary import union_all


def validate_catalog(assets: DataFrame, evidence: DataFrame, asset: str, game: str, expected_game: str,
                     schema_version: Column | None = None, expected_version: int = 1,
                     rank: str = "rank", least: int = 2) -> DataFrame:
    """(rule, subject): foreign game, duplicate id, verified hash with two owners, wrong schema.

    Candidate hashes may collide; only verified ones are exclusive.
    """
    wrong = assets.filter(~F.col(game).eqNullSafe(F.lit(expected_game))).select(
        F.lit("game_mismatch").alias("rule"), F.col(asset).cast("string").alias("subject"))
    twice = assets.groupBy(asset).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(
        F.lit("duplicate_id").alias("rule"), F.col(asset).cast("string").alias("subject"))
    owners = unique_owner(evidence.filter(F.col(rank) >= least), ["hash"], asset).filter(~F.col("only")).select(
        F.lit("conflicting_hash").alias("rule"), F.col("hash").cast("string").alias("subject"))
    checks = [wrong, twice, owners]
    if schema_version is not None:
        checks.append(assets.filter(schema_version != expected_version).select(
            F.lit("schema_version").alias("rule"), F.col(asset).cast("string").alias("subject")))
    return union_all(checks)


def plan_mapping(evidence: DataFrame, hash_: str, path: str, rank: str = "rank", least: int = 2) -> DataFrame:
    """Verified hashes only; one hash to one path, otherwise a conflict that maps nothing."""
    known = unique_owner(evidence.filter(F.col(rank) >= least), [hash_], path)
    return known.select(
        hash_, F.when(F.col("only"), F.col("owner")).alias("path"),
        F.when(F.col("only"), "mapped").otherwise("conflict").alias("state"))


def bad_relative_image(path: Column, ext: str = "png") -> Column:
    """Output paths must be relative, without empty or parent parts, and images."""
    p = P.forward(path)
    return (p == "") | p.rlike(r"(^|/)(\.\.)?(/|$)") | ~F.endswith(F.lower(p), F.lit("." + ext))


def validate_mapping(mapping: DataFrame, files: DataFrame, hash_="hash", name="name", path="path",
                     roots: DataFrame | None = None, expected_roots: int = 1, image_ext: str | None = None) -> DataFrame:
    """(rule, subject): key is no hash, value resolves to no file or to several, wrong number of roots.

    With ``image_ext`` names must be relative paths of such images, too; the subject of ``bad_path`` is the name.
    """
    from ..functions.hashes import is_runtime_hash

    bad_key = mapping.filter(~is_runtime_hash(hash_)).select(
        F.lit("bad_hash").alias("rule"), F.col(hash_).alias("subject")).distinct()
    resolved = resolve_mapping(mapping.filter(is_runtime_hash(hash_)), files, hash_, name, path)
    loose = resolved.filter(F.col("n_files") != 1).select(
        F.when(F.col("n_files") == 0, "no_file").otherwise("several_files").alias("rule"),
        F.col(hash_).alias("subject"))
    out = bad_key.unionByName(loose)
    if image_ext is not None:
        out = out.unionByName(mapping.filter(bad_relative_image(name, image_ext)).select(
            F.lit("bad_path").alias("rule"), F.col(name).alias("subject")).distinct())
    if roots is not None:
        out = out.unionByName(roots.agg(F.count("*").alias("n")).filter(F.col("n") != expected_roots).select(
            F.lit("root_documents").alias("rule"), F.col("n").cast("string").alias("subject")))
    return out

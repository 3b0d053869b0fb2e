"""Duplicate removal and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P
from .ranking import first_per_group, number_and_total


def dedupe_assets(assets: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """First row per identity key, with the number of rows it stands for.

    Carry identity and metadata columns only; content stays behind its digest.
    """
    keep = [c for c in assets.columns if c not in keys]
    return (
        assets.groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), F.struct(*order_by)).alias("_row"), F.count("*").alias("copies"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in keep], "copies")
    )


def merged_values(assets: DataFrame, kept: DataFrame, keys: list[str], value: str,
                  exclude_kept: bool = False) -> DataFrame:
    """What the dropped copies contribute: one row per (key, distinct value).

    A relation and not an array, because a group of copies has no size limit.
    With ``exclude_kept`` the kept row's own value is left out, which gives the
    alternate sources.
    """
    distinct = assets.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").select(*keys, value).distinct()
    if not exclude_kept:
        return distinct
    own = kept.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_own"))
    same = reduce(lambda a, b: a & b, [distinct[k].eqNullSafe(own[f"_k_{k}"]) for k in keys])
    return distinct.join(own, same).filter(~F.col(value).eqNullSafe(F.col("_own"))).select(*keys, value)


def union_roots(frames: list[DataFrame], order_by: list[str], path="path") -> DataFrame:
    """Union of several roots, each path once: the first root that has it, then the first row in order."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return first_per_group(out, [path], ["_frame", *order_by]).drop("_frame")


def carry_forward(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win; old rows with unclaimed keys stay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def union_nested(frames: list[DataFrame], owner: list[str], identity: str, order_by: list[str]) -> DataFrame:
    """Merge nested records of an owner by canonical identity; first appearance is kept."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return first_per_group(out, [*owner, identity], ["_frame", *order_by]).drop("_frame")


def leaf_files(files: DataFrame, members: DataFrame, path="path", parent="parent") -> DataFrame:
    """Files that are not themselves containers of other files."""
    return files.join(members.select(F.col(parent).alias(path)).distinct(), path, "left_anti")


def leaves_below(files: DataFrame, kind: str, path="path") -> DataFrame:
    """Files with a container of ``kind`` above them that have no member of their own; paths spell out all containers.

    The predicate on the path comes first: what lies below such a container is below it with all its members, so only
    these files are compared with the folders of one another.
    """
    below = files.filter(P.has_ancestor_kind(path, kind))
    folders = below.select(P.path_key(P.folder(path)).alias("_folder")).distinct()
    return below.join(folders, P.path_key(path) == F.col("_folder"), "left_anti")


def missing_names(refs: DataFrame, decoded: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Referenced names that were never decoded, once per ``keys``; compared on ``on``."""
    on = on or keys
    return refs.select(*keys).join(decoded.select(*on), on, "left_anti").distinct()


def last_write_wins(members: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Duplicate path: the last payload at the first position; every write counts."""
    return members.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_last"),
        F.min(F.struct(*order)).alias("_first"),
        F.count("*").alias("writes"),
    ).select(
        *keys,
        *[F.col("_first")[c].alias(f"first_{c}") for c in order],
        *[F.col("_last")[c].alias(c) for c in payload],
        "writes",
    )


def paginate(df: DataFrame, by: list[str], order: list[str], size: int, **hot) -> DataFrame:
    """Page number and cell of each row inside its category."""
    numbered = number_and_total(df, by, order, number="_n", **hot)
    at = F.col("_n") - 1
    return numbered.withColumns(
        {"page": F.floor(at / size).cast("bigint") + 1, "cell": F.pmod(at, F.lit(size)).cast("bigint")}
    ).drop("_n")


def segment_layout(levels: DataFrame, group: list[str], order: list[str], size: str, **hot) -> DataFrame:
    """Exclusive running offset of each level inside its group, and the end."""
    out = number_and_total(levels, group, order, number=None, totals={"end": size}, **hot)
    return out.withColumn("offset", F.col("end") - F.col(size))


def pick_slot(bindings: DataFrame, material: list[str], slot: str, enabled: str, order: list[str],
              slots: list[int]) -> DataFrame:
    """One binding per (material, slot): the first enabled one, else the first."""
    rows = bindings.filter(F.col(slot).isin(slots)).withColumn("_off", ~F.col(enabled))
    return first_per_group(rows, [*material, slot], ["_off", *order]).drop("_off")


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def ordered_output(df: DataFrame, keys: list[str]) -> DataFrame:
    """Globally sorted rows; for the sink only."""
    return df.orderBy(*keys)

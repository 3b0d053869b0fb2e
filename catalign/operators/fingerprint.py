"""Privacy-safe fingerprint of a catalogue and its comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .summary import histogram, long_counts

DESCRIPTOR_FIELDS = [
    "candidate_hash", "category", "format", "height", "material_binding_count", "mip", "parser_used",
    "verified_hashes", "width",
]


def descriptor(assets: DataFrame) -> Column:
    """Compact JSON of the nine public fields; no path, name or content."""
    have = set(assets.columns)

    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    def number(name, default):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(default).cast("bigint")) if name in have \
            else F.lit(default).cast("bigint")

    hashes = F.col("verified_hashes") if "verified_hashes" in have else F.array().cast("array<string>")
    fields = {
        "candidate_hash": F.upper(text("candidate_hash")),
        "category": text("category"),
        "format": number("format", -1),
        "height": number("height", 0),
        "material_binding_count": number("material_binding_count", 0),
        "mip": number("mip", 0),
        "parser_used": text("parser_used"),
        "verified_hashes": F.array_sort(F.transform(
            F.coalesce(hashes, F.array().cast("array<string>")), lambda h: F.upper(h))),
        "width": number("width", 0),
    }
    return F.to_json(F.struct(*[fields[n].alias(n) for n in DESCRIPTOR_FIELDS]), {"ignoreNullFields": "false"})


def catalog_digest(rows: DataFrame, value: str, widths: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """Order-independent SHA-256 of a multiset of strings.

    Equal strings are counted first. Each distinct (string, count) gives a
    digest; digests are then folded level by level, sorted inside the groups
    that share a digest prefix. Groups stay small because digests are uniform,
    so no task ever sees the whole catalogue.
    """
    d = (
        rows.groupBy(value).agg(F.count("*").alias("_n"))
        .select(F.sha2(F.concat_ws("|", F.col(value), F.col("_n").cast("string")), 256).alias("digest"))
    )
    for width in widths:
        d = d.groupBy(F.substring("digest", 1, width).alias("_p") if width else F.lit("").alias("_p")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("_fold")
        ).select(F.concat("_p", "_fold").alias("digest"))
    return d


def fingerprint(assets: DataFrame, sections: dict[str, Column], summaries: dict[str, DataFrame] | None = None,
                bound: str = "material_binding_count", identity: dict[str, str] | None = None) -> DataFrame:
    """(section, key, value) rows: identity, scalars, histograms, digest, selected counters."""
    # Scalars, histograms and digest all read this narrow table, and whatever
    # lies behind the assets is read once.
    slim = cut(assets.select(
        (F.coalesce(F.col("candidate_hash"), F.lit("")) != "").alias("_hashed"),
        F.size(F.coalesce(F.col("verified_hashes"), F.array().cast("array<string>"))).alias("_verified"),
        (F.coalesce(F.col(bound), F.lit(0)) > 0).alias("_bound"),
        descriptor(assets).alias("_json"), *[e.cast("string").alias(f"_s_{name}") for name, e in sections.items()]))
    totals = slim.agg(
        F.count("*").alias("asset_count"),
        F.count_if("_hashed").alias("candidate_hash_count"),
        F.coalesce(F.sum("_verified"), F.lit(0)).alias("verified_runtime_hash_count"),
        F.count_if("_bound").alias("material_bound_assets"),
    )
    counts = long_counts("scalar", totals).unionByName(
        histogram(slim, {name: F.col(f"_s_{name}") for name in sections}))
    for name, table in (summaries or {}).items():
        counts = counts.unionByName(long_counts(name, table))
    digest = catalog_digest(slim, "_json").select(
        F.lit("scalar").alias("section"), F.lit("asset_descriptor_sha256").alias("key"), F.col("digest").alias("value")
    )
    out = counts.select("section", "key", F.col("n").cast("string").alias("value")).unionByName(digest)
    header = [("identity", k, v) for k, v in (identity or {}).items()]
    if header:
        out = out.unionByName(assets.sparkSession.createDataFrame(header, out.schema))
    return out


def diff_fingerprints(expected: DataFrame, actual: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """Unequal entries as (section, key, expected, actual); empty means a match."""
    if sections:
        expected = expected.filter(F.col("section").isin(sections))
        actual = actual.filter(F.col("section").isin(sections))
    e = expected.select("section", "key", F.col("value").alias("expected"))
    a = actual.select("section", "key", F.col("value").alias("actual"))
    return e.join(a, ["section", "key"], "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))

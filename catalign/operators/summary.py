"""Counts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import content as C, values as V
from ..session import cut
from .dedupe import most_common
from .ranking import top_per_group


def histogram(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """Counts per value of several expressions in one pass: (section, key, n)."""
    named = df.select(*[e.cast("string").alias(name) for name, e in sections.items()])
    sets = [[F.col(name)] for name in sections]
    bits = F.grouping_id(*[F.col(n) for n in sections])
    full = (1 << len(sections)) - 1
    label, key = None, None
    for i, name in enumerate(sections):
        hit = F.col("_gid") == (full ^ (1 << (len(sections) - 1 - i)))
        label = F.when(hit, name) if label is None else label.when(hit, name)
        key = F.when(hit, F.col(name)) if key is None else key.when(hit, F.col(name))
    grouped = named.groupingSets(sets, *[F.col(n) for n in sections]).agg(
        F.count("*").alias("n"), bits.alias("_gid")
    )
    return grouped.select(label.alias("section"), key.alias("key"), "n")


def long_counts(section: str, totals: DataFrame) -> DataFrame:
    """A one-row table of counters as rows (section, key, n)."""
    cols = totals.columns
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).cast("bigint").alias("n")) for c in cols
    ])).alias("p")
    return totals.select(pairs).select(F.lit(section).alias("section"), "p.key", "p.n")


def inventory_summary(files: DataFrame, flags: dict[str, Column], ext="ext", content="content",
                      top: int = V.MAGIC_TOP, binary: bool = True) -> DataFrame:
    """File flags, extension counts and the most common leading magics."""
    # Content is read once; the three reports below read what is left of it.
    slim = cut(files.select(
        F.coalesce(F.col(ext), F.lit("(none)")).alias("ext"),
        C.magic_label(content, binary).alias("magic"),
        *[e.alias(name) for name, e in flags.items()],
    ))
    totals = slim.agg(F.count("*").alias("files"), *[F.count_if(name).alias(name) for name in flags])
    exts = slim.groupBy(F.col("ext").alias("key")).agg(F.count("*").alias("n"))
    magics = most_common(slim, "magic", top).withColumnRenamed("magic", "key")
    return (
        long_counts("flags", totals)
        .unionByName(exts.withColumn("section", F.lit("extension")))
        .unionByName(magics.withColumn("section", F.lit("magic")))
    )


def run_summary(rows: DataFrame, by: list[str], counters: dict[str, Column]) -> DataFrame:
    """Conditional sums per format or extension in one aggregation."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[e.alias(k) for k, e in counters.items()])


def status_rollup(rows: DataFrame, status: str, known: list[str]) -> DataFrame:
    """How many rows are in each of the known states, zeros included."""
    return rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in known])


def archive_report(members: DataFrame, archive: str, order: list, size: str, known: Column,
                   sample: list[str], k: int = 20) -> DataFrame:
    """Per archive: member count, bytes, known members and the first k members."""
    totals = members.groupBy(archive).agg(
        F.count("*").alias("members"), F.sum(size).alias("bytes"), F.count_if(known).alias("known_members"),
    )
    head = top_per_group(members, [archive], order, k, "_n").groupBy(archive).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", *sample))),
            lambda m: F.concat_ws(":", *[m[c].cast("string") for c in sample]),
        ).alias("head")
    )
    return totals.join(head, archive, "left").withColumn("head", F.array_join("head", ","))


def coverage_totals(payloads: DataFrame, kind: str, counters: dict[str, dict[str, Column]]) -> DataFrame:
    """Declared / parsed / unsupported counters per payload type, one row in all."""
    aggs = []
    for code, group in counters.items():
        for name, e in group.items():
            aggs.append(F.sum(F.when((F.col(kind) == code) & e, 1).otherwise(0)).alias(f"{code.lower()}_{name}"))
    return payloads.agg(F.count("*").alias("payloads"), *aggs)


def usage_snapshot(decided: DataFrame, limits: dict[str, int], scope: list[str] | None = None) -> DataFrame:
    """What admitted archives use, beside the limits."""
    ok = F.col("admitted")
    rows = decided.groupBy(*(scope or []))
    return rows.agg(
        F.count_if(ok).alias("archives"),
        F.coalesce(F.sum(F.when(ok, F.col("members"))), F.lit(0)).alias("members_used"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes_used"),
        F.coalesce(F.max(F.when(ok, F.col("depth"))), F.lit(0)).alias("max_depth_seen"),
    ).withColumns({k: F.lit(v).cast("bigint") for k, v in limits.items() if k in ("max_members", "max_expanded_bytes")})


def evidence_report(matches: DataFrame, status="status", agrees="agrees") -> DataFrame:
    """Counts per outcome of a match run, and the verdict on exact samples."""
    exact = F.col(status) == "verified"
    totals = matches.agg(
        F.count("*").alias("found"),
        *[F.count_if(F.col(status) == s).alias(n) for s, n in [
            ("verified", "matched_exact"), ("candidate", "similar"), ("ambiguous", "ambiguous"),
            ("unmatched", "unmatched")]],
        F.count_if(exact & F.col(agrees)).alias("agreeing"),
        F.count_if(exact & ~F.col(agrees)).alias("disagreeing"),
    )
    return totals.withColumn("verdict", verdict("agreeing", "disagreeing"))


def verdict(agreeing, disagreeing) -> Column:
    """PASS needs agreement and no disagreement; no samples is its own outcome."""
    return (
        F.when(F.col(disagreeing) > 0, "FAIL").when(F.col(agreeing) > 0, "PASS").otherwise("NO_EXACT_SAMPLES")
    )


def coverage_complete(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("issues")).withColumn("complete", F.col("issues") == 0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

"""Hash evidence as a relation (asset, hash, rank, …) and changes to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V


def merge_evidence(evidence: DataFrame, keys: list[str], rank: str, order_by: list[str]) -> DataFrame:
    """Per (asset, hash) the highest confidence; ties keep the earliest row.

    Only the strongest row of each map task is shuffled, and the merge is
    commutative, associative and idempotent.
    """
    rest = [c for c in evidence.columns if c not in keys]
    best = F.struct((-F.col(rank)).alias("_down"), *order_by)
    return evidence.groupBy(*keys).agg(F.min_by(F.struct(*rest), best).alias("_row")).select(
        *keys, *[F.col("_row")[c].alias(c) for c in rest])


def confirm(evidence: DataFrame, decisions: DataFrame, keys: list[str], status="status",
            method="user_confirmed_visual_candidate", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promote pending candidates named by the decisions.

    Returns the evidence, the decisions that are errors, and the log. An error is
    ``unknown_asset`` when the first key names none (of ``known``, or else of the
    evidence) and ``no_pending`` when the asset has no pending row of that hash.
    The log has the promoted rows as they were, with scores and file where there
    are any, under the new method.
    """
    wanted = decisions.select(*keys).distinct()
    pending = F.col(status) == "candidate"
    marked = evidence.join(wanted.withColumn("_yes", F.lit(True)), keys, "left")
    promote = pending & F.coalesce("_yes", F.lit(False))
    out = marked.withColumns({
        "method": F.when(promote, method).otherwise(F.col("method")),
        status: F.when(promote, "verified").otherwise(F.col(status)),
    }).drop("_yes")
    named = (evidence if known is None else known).select(keys[0]).distinct().withColumn("_known", F.lit(True))
    errors = wanted.join(evidence.filter(pending).select(*keys).distinct(), keys, "left_anti").join(
        named, keys[0], "left").select(*keys, F.when(F.col("_known"), "no_pending").otherwise("unknown_asset").alias("error"))
    log = evidence.filter(pending).join(wanted, keys, "left_semi").withColumnRenamed("method", "candidate_method").withColumn(
        "method", F.lit(method))
    return out, errors, log


def apply_evidence(evidence: DataFrame, matches: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Fold match results into the evidence: one row per (asset, hash).

    Verified stays or becomes verified and removes the pending row of the same
    hash; a similar match replaces an earlier pending one. Never downgrades.
    """
    both = evidence.withColumn("_new", F.lit(0)).unionByName(matches.withColumn("_new", F.lit(1)))
    rest = [c for c in evidence.columns if c not in keys]
    verified = F.col("status") == "verified"
    # Verified first, oldest verified kept; otherwise the newest candidate.
    pick = F.struct(
        F.when(verified, 0).otherwise(1).alias("_a"),
        F.when(verified, F.col("_new")).otherwise(-F.col("_new")).alias("_b"), *order_by)
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), pick).alias("_row"), F.count("*").alias("log_rows")).select(
        *keys, *[F.col("_row")[c].alias(c) for c in rest], "log_rows")


def rescan_evidence(stored: DataFrame, incoming: DataFrame, keys: list[str], rank: str, order_by: list[str]) -> DataFrame:
    """Evidence after a rescan: per key the strongest row of both sides, the stored one if they are equal. Nothing is downgraded."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return merge_evidence(both, keys, rank, ["_new", *order_by]).drop("_new")


def is_verified(rank="rank"):
    return F.col(rank) >= V.VERIFIED_RANK
